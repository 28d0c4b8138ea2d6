"""The pattern language.

Patterns are read code unit by code unit.  Open groups are kept on a stack of
frames; a frame collects the finished branches and the items of the current
one, so nesting costs no Python recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from textmesh.plans import expr as E
from textmesh.plans import symbols as S
from textmesh.plans.errors import EmptyPattern, InvalidPattern, PatternNestingTooDeep

#: Fixed values of the language.
MAX_COUNT = 1000
MAX_DEPTH = 256
LITERAL_ESCAPES = frozenset(map(ord, "\\.*+?[]()|^$-{}"))
CLASS_ESCAPES = frozenset(map(ord, "\\][-^"))
CONTROLS = {ord("n"): 0x0A, ord("t"): 0x09, ord("r"): 0x0D, ord("f"): 0x0C}
SETS = {ord("d"): S.DIGIT, ord("w"): S.WORD, ord("s"): S.SPACE}
NEGATED = {ord("D"): S.DIGIT, ord("W"): S.WORD, ord("S"): S.SPACE}
ASSERTIONS = {ord("b"): E.WORD_BOUNDARY, ord("B"): E.NOT_WORD_BOUNDARY}
_QUANTIFIERS = frozenset(map(ord, "?*+{"))
_C = {c: ord(c) for c in "()|[].\\^$?*+{}:-,is"}


@dataclass(frozen=True)
class Parsed:
    pattern_id: int
    tree: tuple
    text: str


def units_of(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


@dataclass
class _Frame:
    start: int
    branches: list = field(default_factory=list)
    items: list = field(default_factory=list)

    def close(self, branch_open: bool):
        """The frame's expression; a last branch after `|` that never began is
        dropped."""
        done = self.branches + ([E.sequence(self.items)] if branch_open else [])
        return E.alternation(done)


class _Reader:
    def __init__(self, pattern_id: int, units: list[int], fold: bool):
        self.id, self.u, self.fold, self.at = pattern_id, units, fold, 0

    def bad(self, lo: int, hi: int) -> InvalidPattern:
        return InvalidPattern(self.id, lo, min(hi, len(self.u)))

    def peek(self, k: int = 0) -> int:
        return self.u[self.at + k] if self.at + k < len(self.u) else -1

    def flags(self) -> None:
        """`(?i)`, `(?s)` and their mixtures, at the very beginning only."""
        if self.u[:2] != [_C["("], _C["?"]]:
            return
        end = 2
        while end < len(self.u) and self.u[end] in (_C["i"], _C["s"]):
            end += 1
        if end > 2 and end < len(self.u) and self.u[end] == _C[")"]:
            self.fold = self.fold or _C["i"] in self.u[2:end]
            self.at = end + 1

    def literal(self, unit: int):
        return E.symbols(S.fold_literal(unit) if self.fold else ((unit, unit),))

    def escape(self):
        lo = self.at
        self.at += 2
        if lo + 1 >= len(self.u):
            raise self.bad(lo, lo + 1)
        c = self.u[lo + 1]
        if c in LITERAL_ESCAPES:
            return self.literal(c)
        if c in CONTROLS:
            return E.symbols(((CONTROLS[c], CONTROLS[c]),))
        if c in SETS:
            return E.symbols(SETS[c])
        if c in NEGATED:
            return E.symbols(S.complement(NEGATED[c]))
        if c in ASSERTIONS:
            return E.assertion(ASSERTIONS[c])
        raise self.bad(lo, lo + 2)

    def char_class(self):
        """Members are read as `a`, `a-b` or an escape; `]` always ends."""
        lo = self.at
        self.at += 1
        negated = self.peek() == _C["^"]
        self.at += negated
        parts: list[S.Ranges] = []
        while (c := self.peek()) != _C["]"]:
            if c < 0:
                raise self.bad(lo, self.at)
            if c == _C["-"]:
                self.at += 1
                raise self.bad(self.at - 1, self.at)
            first_at = self.at
            first = self.member()
            if isinstance(first, tuple):
                parts.append(first)
                continue
            if self.peek() != _C["-"]:
                parts.append(S.fold_member(first) if self.fold else ((first, first),))
                continue
            self.at += 1
            c = self.peek()
            if c < 0:
                raise self.bad(lo, self.at)
            if c == _C["]"]:
                raise self.bad(lo, self.at + 1)
            if c == _C["-"]:
                self.at += 1
                raise self.bad(self.at - 1, self.at)
            last = self.member()
            if isinstance(last, tuple):
                raise self.bad(lo, self.at)
            got = None if last < first else S.fold_range(first, last) if self.fold else ((first, last),)
            if got is None:
                raise self.bad(first_at, self.at)
            parts.append(got)
        self.at += 1
        members = S.union(*parts)
        return E.symbols(S.complement(members) if negated else members)

    def member(self) -> int | S.Ranges:
        lo = self.at
        c = self.u[lo]
        if c != _C["\\"]:
            self.at += 1
            return c
        if lo + 1 >= len(self.u):
            raise self.bad(lo, lo + 1)
        self.at += 2
        c = self.u[lo + 1]
        if c in CLASS_ESCAPES:
            return c
        if c in CONTROLS:
            return CONTROLS[c]
        if c in SETS:
            return SETS[c]
        raise self.bad(lo, lo + 2)

    def number(self, quantifier: int) -> int:
        lo, value = self.at, 0
        while 0x30 <= self.peek() <= 0x39:
            value = min(value * 10 + self.peek() - 0x30, MAX_COUNT + 1)
            self.at += 1
        if self.at == lo or value > MAX_COUNT:
            raise self.bad(quantifier, max(self.at, lo + 1))
        return value

    def quantified(self, item):
        lo, c = self.at, self.peek()
        if c not in _QUANTIFIERS:
            return item
        self.at += 1
        if c != _C["{"]:
            least, most = {_C["?"]: (0, 1), _C["*"]: (0, None), _C["+"]: (1, None)}[c]
        else:
            least = most = self.number(lo)
            if self.peek() == _C[","]:
                self.at += 1
                most = None if self.peek() == _C["}"] else self.number(lo)
            if self.peek() != _C["}"]:
                raise self.bad(lo, self.at)
            self.at += 1
            if most is not None and (most < least or most == 0):
                raise self.bad(lo, self.at)
        if self.peek() in _QUANTIFIERS:
            raise self.bad(lo, self.at + 1)
        return E.repeat(item, least, most)

    def read(self):
        stack = [_Frame(-1)]
        after_bar = False  # a `|` was just read
        while True:
            c, top = self.peek(), stack[-1]
            if c < 0:
                if len(stack) > 1:
                    raise self.bad(top.start, len(self.u))
                return top.close(not after_bar)
            if c == _C[")"]:
                if len(stack) == 1:
                    raise self.bad(self.at, self.at + 1)
                stack.pop()
                self.at += 1
                item = top.close(not after_bar)
            elif c == _C["|"]:
                top.branches.append(E.sequence(top.items))
                top.items = []
                self.at += 1
                after_bar = True
                continue
            elif c == _C["("]:
                lo = self.at
                self.at += 1
                if self.peek() == _C["?"]:
                    self.at += 1
                    if self.peek() != _C[":"]:
                        raise self.bad(lo, self.at)
                    self.at += 1
                if self.peek() != _C[")"]:
                    if len(stack) > MAX_DEPTH:
                        raise PatternNestingTooDeep(self.id, MAX_DEPTH)
                    stack.append(_Frame(lo))
                    after_bar = False
                    continue
                self.at += 1
                item = E.NEVER
            elif c in _QUANTIFIERS:
                raise self.bad(self.at, self.at + 1)
            elif c == _C["\\"]:
                item = self.escape()
            elif c == _C["["]:
                item = self.char_class()
            else:
                self.at += 1
                item = E.symbols(S.ANY) if c == _C["."] else E.assertion(E.LINE_START) if c == _C["^"] else E.assertion(E.LINE_END) if c == _C["$"] else self.literal(c)
            stack[-1].items.append(self.quantified(item))
            after_bar = False


def parse(pattern_id: int, text: str, case_insensitive: bool = False) -> Parsed:
    units = units_of(text)
    if not units:
        raise EmptyPattern(pattern_id)
    reader = _Reader(pattern_id, units, case_insensitive)
    reader.flags()
    tree = reader.read()
    if E.nullable(tree) and E.least_consumed(tree) == 0 and not E.can_consume(tree):
        raise InvalidPattern(pattern_id, 0, len(units))
    return Parsed(pattern_id, tree, text)
