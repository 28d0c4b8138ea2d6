"""Builder and matcher."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

from textmesh.plans import expr as E
from textmesh.plans.automaton import MAX_POSITIONS, Automaton
from textmesh.plans.dialect import Parsed, parse
from textmesh.plans.errors import DuplicatePatternId, InvalidPatternId, InvalidWorkerCount, NoPatterns, PatternError

CASE_INSENSITIVE = 1
#: Patterns whose necessary prefixes may become one row filter.
FILTER_PATTERNS = 64


@dataclass
class MatcherBuilder:
    """Collects patterns; ids are unique integers from 0 to 2**32 - 1."""

    patterns: list[Parsed] = field(default_factory=list)
    ids: set = field(default_factory=set)
    budget: int | None = None
    workers: int = 1
    prefilter: bool = True
    literal_prefilter: bool = True
    cohorts: bool = True

    def add(self, pattern_id: int, pattern: str, flags: int = 0) -> MatcherBuilder:
        """A rejected pattern raises, and leaves the builder as it was."""
        if isinstance(pattern_id, bool) or not isinstance(pattern_id, int) or not 0 <= pattern_id < 1 << 32:
            raise InvalidPatternId(pattern_id)
        if pattern_id in self.ids:
            raise DuplicatePatternId(pattern_id)
        self.patterns.append(parse(pattern_id, pattern, bool(flags & CASE_INSENSITIVE)))
        self.ids.add(pattern_id)
        return self

    def add_all(self, rows, on_reject: str = "raise") -> MatcherBuilder:
        """rows: (pattern_id, pattern[, case_insensitive])."""
        for pattern_id, pattern, *fold in rows:
            try:
                self.add(pattern_id, pattern, CASE_INSENSITIVE if fold and fold[0] else 0)
            except PatternError:
                if on_reject != "skip":
                    raise
        return self

    def from_dataframe(self, df, on_reject: str = "raise") -> MatcherBuilder:
        """Columns pattern_id, pattern and, if present, case_insensitive and
        ordinal; the patterns are the side that is broadcast."""
        rows = df.orderBy("ordinal" if "ordinal" in df.columns else "pattern_id").collect()
        fold = "case_insensitive" in df.columns
        return self.add_all([(r.pattern_id, r.pattern, fold and r.case_insensitive) for r in rows], on_reject)

    def state_cache_budget(self, n: int) -> MatcherBuilder:
        """States that are kept; 0 keeps none; without a call as many as a table
        of fixed size has room for.  Results don't depend on it."""
        self.budget = n
        return self

    def worker_count(self, n: int) -> MatcherBuilder:
        """Parts that the patterns are dealt into, in order of registration."""
        self.workers = n
        return self

    def prefilter_enabled(self, on: bool) -> MatcherBuilder:
        """Off: every place of every text is tried."""
        self.prefilter = on
        return self

    def literal_prefilter_enabled(self, on: bool) -> MatcherBuilder:
        """Off: no texts are left out for lack of a necessary literal."""
        self.literal_prefilter = on
        return self

    def cohort_compilation_enabled(self, on: bool) -> MatcherBuilder:
        """Off: patterns with and without assertions share an automaton."""
        self.cohorts = on
        return self

    def build(self) -> Matcher:
        if not self.patterns:
            raise NoPatterns
        if self.workers < 1:
            raise InvalidWorkerCount
        return Matcher(list(self.patterns), self.budget, self.workers, self.prefilter, literal_prefilter=self.literal_prefilter, cohorts=self.cohorts)


class Matcher:
    """Compiled patterns; immutable but for the automata's tables of states,
    which aren't pickled.  Neither are the patterns, which no scan needs."""

    def __init__(self, patterns: list[Parsed], budget: int | None = None, workers: int = 1, prefilter: bool = True, limit: int = MAX_POSITIONS, literal_prefilter: bool = True, cohorts: bool = True):
        self.patterns, self.prefilter, self.workers = patterns, prefilter, workers
        self.literal_prefilter, self.cohorts = literal_prefilter, cohorts
        self.budget = budget
        self.ids = np.array([p.pattern_id for p in patterns], np.int64)
        parts = min(workers, len(patterns))
        cuts = [len(patterns) * i // parts for i in range(parts + 1)]
        self.automata: list[Automaton] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # patterns with assertions have an automaton of their own
            kind = [bool(E.assertions(p.tree)) and cohorts for p in patterns[a:b]]
            for with_facts in (False, True):
                own = [(k, patterns[k].tree) for k in range(a, b) if kind[k - a] == with_facts]
                if own:
                    self.automata.append(Automaton(own, None if budget is None else budget // parts, limit))
                    self.automata[-1].filter_starts = prefilter
        self.fingerprint = hashlib.sha256(repr([(p.pattern_id, p.tree) for p in patterns]).encode()).hexdigest()
        self.key = (self.fingerprint, budget, workers, prefilter, cohorts)

    def __getstate__(self):
        return self.__dict__ | {"patterns": []}

    def restrict(self, ids) -> Matcher:
        """The matcher of some of the patterns."""
        wanted = set(ids)
        return Matcher([p for p in self.patterns if p.pattern_id in wanted], self.budget, self.workers, self.prefilter, literal_prefilter=self.literal_prefilter, cohorts=self.cohorts)

    def events(self, units: np.ndarray, rows: np.ndarray, lo: int = 0, hi: int | None = None):
        """(start, ordinal, end) in order of start and ordinal."""
        got = [a.scan(units, rows, lo, hi) for a in self.automata]
        if len(got) == 1:
            return got[0]
        start, ordinal, end = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ordinal, start))
        return start[order], ordinal[order], end[order]

    def find(self, text: str | list[int]) -> list[tuple[int, int, int]]:
        """(pattern_id, start, end) in one text or list of code units, sorted."""
        raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2") if isinstance(text, str) else np.array(text, np.uint16)
        start, ordinal, end = self.events(raw, np.array([0, len(raw)]))
        return sorted(zip(self.ids[ordinal].tolist(), start.tolist(), end.tolist(), strict=True))

    def necessary_literals(self) -> list[str] | None:
        """Strings of which a text with an event has at least one; None if some
        pattern has none, or they are too many."""
        out = set()
        for p in self.patterns:
            units, _ = E.prefix(p.tree, False)
            while units and 0xD800 <= units[-1] < 0xDC00:
                units = units[:-1]
            if not units:
                return None
            try:
                out.add(b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le"))
            except UnicodeDecodeError:
                return None
        short = sorted(out, key=len)
        kept: list[str] = []
        for s in short:
            if not any(k in s for k in kept):
                kept.append(s)
        return sorted(kept) if len(kept) <= FILTER_PATTERNS else None
