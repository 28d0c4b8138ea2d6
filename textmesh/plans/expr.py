"""Expression trees, kept simplified, and static facts about them.

A tree is a tuple: ("never",), ("empty",), ("assert", kind), ("set", ranges),
("seq", items), ("alt", items) or ("rep", item, least, most or None).
"""

from __future__ import annotations

from functools import lru_cache

from textmesh.plans.symbols import Ranges

NEVER, EMPTY = ("never",), ("empty",)
LINE_START, LINE_END, WORD_BOUNDARY, NOT_WORD_BOUNDARY = "line_start", "line_end", "word_boundary", "non_word_boundary"
#: Code units of a prefix that are kept.
PREFIX = 32
UNBOUNDED = float("inf")


def assertion(kind: str):
    return ("assert", kind)


def symbols(s: Ranges):
    return ("set", s)


def sequence(items):
    flat = [y for x in items for y in (x[1] if x[0] == "seq" else (x,)) if y != EMPTY]
    if NEVER in flat:
        return NEVER
    return EMPTY if not flat else flat[0] if len(flat) == 1 else ("seq", tuple(flat))


def alternation(items):
    flat = [y for x in items for y in (x[1] if x[0] == "alt" else (x,)) if y != NEVER]
    return NEVER if not flat else flat[0] if len(flat) == 1 else ("alt", tuple(flat))


def repeat(item, least: int, most: int | None):
    if item == EMPTY or (item == NEVER and least == 0):
        return EMPTY
    if item == NEVER:
        return NEVER
    return item if (least, most) == (1, 1) else ("rep", item, least, most)


def children(e) -> tuple:
    return e[1] if e[0] in ("seq", "alt") else (e[1],) if e[0] == "rep" else ()


@lru_cache(maxsize=100_000)
def nullable(e) -> bool:
    kind = e[0]
    if kind in ("empty", "assert"):
        return True
    if kind == "seq":
        return all(map(nullable, e[1]))
    if kind == "alt":
        return any(map(nullable, e[1]))
    return kind == "rep" and (e[2] == 0 or nullable(e[1]))


@lru_cache(maxsize=100_000)
def least_consumed(e) -> int | None:
    """None: it can't match."""
    kind = e[0]
    if kind == "never" or e == ("set", ()):
        return None
    if kind in ("empty", "assert"):
        return 0
    if kind == "set":
        return 1
    if kind == "seq":
        parts = [least_consumed(x) for x in e[1]]
        return None if None in parts else sum(parts)
    if kind == "alt":
        return min((n for x in e[1] if (n := least_consumed(x)) is not None), default=None)
    if e[2] == 0:
        return 0
    n = least_consumed(e[1])
    return None if n is None else n * e[2]


@lru_cache(maxsize=100_000)
def most_consumed(e) -> float | None:
    """None: it can't match; UNBOUNDED: no limit."""
    kind = e[0]
    if kind == "never" or e == ("set", ()):
        return None
    if kind in ("empty", "assert"):
        return 0
    if kind == "set":
        return 1
    if kind == "seq":
        total = 0.0
        for x in e[1]:
            n = most_consumed(x)
            if n is None or n == UNBOUNDED:
                return n
            total += n
        return total
    if kind == "alt":
        return max((n for x in e[1] if (n := most_consumed(x)) is not None), default=None)
    n = most_consumed(e[1])
    if n is None or n == 0:
        return n
    return UNBOUNDED if e[3] is None else n * e[3]


@lru_cache(maxsize=100_000)
def can_consume(e) -> bool:
    kind = e[0]
    if kind == "set":
        return bool(e[1])
    if kind == "seq":
        return all(x[0] != "never" for x in e[1]) and any(map(can_consume, e[1]))
    return any(map(can_consume, children(e)))


@lru_cache(maxsize=100_000)
def assertions(e) -> frozenset:
    return frozenset([e[1]]) if e[0] == "assert" else frozenset().union(*map(assertions, children(e)))


def nodes(e) -> int:
    return 1 + sum(map(nodes, children(e)))


def ascii_only(e) -> bool:
    return all(hi < 128 for _, hi in e[1]) if e[0] == "set" else all(map(ascii_only, children(e)))


def _single(e) -> bool:
    return e[0] == "set" and len(e[1]) == 1 and e[1][0][0] == e[1][0][1]


def common(a: tuple, b: tuple) -> tuple:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def prefix(e, through_assertions: bool) -> tuple[tuple[int, ...], bool]:
    """(units that every match begins with, whether they are the whole match).
    Assertions consume nothing; they end a filter's prefix, but not the
    prefix that diagnostics report."""
    kind = e[0]
    if kind == "empty":
        return (), True
    if kind == "assert":
        return (), through_assertions
    if _single(e):
        return (e[1][0][0],), True
    if kind == "alt":
        parts = [prefix(x, through_assertions) for x in e[1]]
        units = parts[0][0]
        for other, _ in parts[1:]:
            units = common(units, other)
        return units, all(x and u == parts[0][0] for u, x in parts)
    if kind == "rep" and e[2]:
        items, exact = [e[1]] * min(e[2], PREFIX + 1), e[2] == e[3]
    elif kind == "seq":
        items, exact = e[1], True
    else:
        return (), False
    units: tuple[int, ...] = ()
    for k, item in enumerate(items):
        got, whole = prefix(item, through_assertions)
        units += got
        if not whole or len(units) > PREFIX or (len(units) == PREFIX and k + 1 < len(items)):
            return units[:PREFIX], False
    return units, exact
