"""A matcher for many patterns with assertions that share a prefix.

If all patterns with assertions begin, after leading assertions, with the same
five ASCII characters, only places with these characters need be tried.  The
caller says what happens to texts for which that doesn't pay: refuse them, or
scan them in the general way; a report tells for each text what was done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textmesh.functions import utf16_batch
from textmesh.operators.scan import bounded
from textmesh.plans import expr as E
from textmesh.plans.matcher import Matcher, MatcherBuilder

#: Fixed values of the policy and names of its reasons.
MIN_PATTERNS = 256
PREFIX_UNITS = 5
MIN_UNITS = 1 << 20
SAMPLE_UNITS = 1 << 16

REQUIRE_SPECIALIZED, ALLOW_EXACT_FALLBACK = "require_specialized", "allow_exact_fallback"


class Ineligible(ValueError):
    """kind: no_assertion_bearing_patterns, too_few_assertion_bearing_patterns
    (with found and minimum) or no_shared_five_unit_ascii_prefix."""

    def __init__(self, kind: str, found: int | None = None):
        super().__init__(kind if found is None else f"{kind}: {found} of {MIN_PATTERNS}")
        self.kind, self.found, self.minimum = kind, found, MIN_PATTERNS


def after_assertions(tree) -> tuple[int, ...]:
    """Units that every match begins with, leading assertions apart."""
    units, _ = E.prefix(tree, True)
    return units


class PrefixMatcherBuilder(MatcherBuilder):
    def build(self) -> PrefixMatcher:
        return PrefixMatcher(super().build())


class PrefixMatcher:
    def __init__(self, matcher: Matcher, min_units: int = MIN_UNITS):
        bearing = [p for p in matcher.patterns if E.assertions(p.tree)]
        if not bearing:
            raise Ineligible("no_assertion_bearing_patterns")
        if len(bearing) < MIN_PATTERNS:
            raise Ineligible("too_few_assertion_bearing_patterns", len(bearing))
        shared = after_assertions(bearing[0].tree)
        for p in bearing[1:]:
            shared = E.common(shared, after_assertions(p.tree))
        shared = shared[:PREFIX_UNITS]
        if len(shared) < PREFIX_UNITS or not all(0 < u < 128 for u in shared):
            raise Ineligible("no_shared_five_unit_ascii_prefix")
        self.matcher, self.min_units = matcher, min_units
        self.acceleration, self.literal_acceleration = matcher.prefilter, matcher.literal_prefilter
        self.assertion_patterns, self.prefix = len(bearing), "".join(map(chr, shared))

    def candidates(self, units: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(units), bool)
        n = len(units) - PREFIX_UNITS + 1
        if n > 0:
            mask[:n] = True
            for k, c in enumerate(self.prefix):
                mask[:n] &= units[k : n + k] == ord(c)
        return mask

    def decide(self, units: np.ndarray) -> tuple[str | None, np.ndarray | None]:
        """(reason why the text is scanned in the general way, or else None;
        the candidates)."""
        if not self.acceleration:
            return "acceleration_disabled", None
        if not self.literal_acceleration:
            return "literal_acceleration_disabled", None
        if len(units) < self.min_units:
            return "input_too_short", None
        mask = self.candidates(units)
        sample = mask[:SAMPLE_UNITS]
        if 2 * int(np.count_nonzero(sample)) >= len(sample):
            return "candidate_sample_too_dense", None
        return None, mask

    def scan_text(self, units: np.ndarray, policy: str):
        """(start, ordinal, end), or None if the policy refuses the text."""
        reason, mask = self.decide(units)
        rows = np.array([0, len(units)])
        if reason:
            return None if policy == REQUIRE_SPECIALIZED else self.matcher.events(units, rows)
        got = [a.scan(units, rows, only=mask if a.facts else None) for a in self.matcher.automata]
        start, ordinal, end = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ordinal, start))
        return start[order], ordinal[order], end[order]


#: What a report has of each row besides its keys.
REPORT = "struct<backend: string, specialized: boolean, reason: string, input_units: bigint, minimum_units: bigint, candidates: bigint, candidate_bytes: bigint>"
EVENTS = "array<struct<pattern_id: bigint, start: bigint, end: bigint>>"


def _texts(column: pa.Array):
    units, rows = utf16_batch(column)
    return (units[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True))


def scan_with_policy(df: DataFrame, matcher: PrefixMatcher, policy: str, column: str = "text", keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, report).  The report has the keys, policy, static eligibility
    (assertion patterns and shared prefix), backend (`refused`, `exact` or
    `assertion_prefix`), whether it is the specialised one, the reason if not,
    lengths, candidates and the bytes of their bitmap (one bit for each unit).
    It looks for candidates only, so neither side repeats the other's scan."""
    if policy not in (REQUIRE_SPECIALIZED, ALLOW_EXACT_FALLBACK):
        raise ValueError(f"unknown policy {policy!r}")
    keys = [c for c in df.columns if c != column] if keys is None else keys
    shared = df.sparkSession.sparkContext.broadcast(matcher)

    @arrow_udf(EVENTS)
    def find(col: pa.Array) -> pa.Array:
        m = shared.value
        size, ids, starts, ends = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for units in _texts(col):
            got = m.scan_text(units, policy)
            size.append(0 if got is None else len(got[0]))
            if size[-1]:
                starts.append(got[0])
                ids.append(m.matcher.ids[got[1]])
                ends.append(got[2])
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ids, starts, ends)], names=["pattern_id", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), items)

    @arrow_udf(REPORT)
    def tell(col: pa.Array) -> pa.Array:
        m, rows = shared.value, []
        for units in _texts(col):
            reason, mask = m.decide(units)
            backend = "assertion_prefix" if reason is None else "refused" if policy == REQUIRE_SPECIALIZED else "exact"
            n = 0 if mask is None else int(np.count_nonzero(mask))
            rows.append({"backend": backend, "specialized": reason is None, "reason": reason, "input_units": len(units), "minimum_units": m.min_units, "candidates": n, "candidate_bytes": 0 if mask is None else -(-len(units) // 8)})
        kinds = [("backend", pa.string()), ("specialized", pa.bool_()), ("reason", pa.string()), *((c, pa.int64()) for c in ("input_units", "minimum_units", "candidates", "candidate_bytes"))]
        return pa.array(rows, pa.struct(kinds))

    events = bounded(df).select(*keys, F.inline(find(F.col(column))))
    report = df.select(*keys, tell(F.col(column)).alias("__r"))
    return events, report.select(*keys, F.lit(policy).alias("policy"), F.lit(matcher.assertion_patterns).alias("assertion_patterns"), F.lit(matcher.prefix).alias("shared_prefix"), "__r.*")
