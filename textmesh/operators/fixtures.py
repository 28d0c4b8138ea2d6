"""Semantic cases against expected results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmesh.plans.errors import PatternError
from textmesh.plans.matcher import MatcherBuilder


def run_case(patterns, units) -> tuple[str, list[tuple[int, int, int]]]:
    """(status, sorted events) of one case; a rejected pattern rejects it."""
    builder = MatcherBuilder()
    try:
        for pattern_id, source in patterns:
            builder.add(pattern_id, b"".join(u.to_bytes(2, "little") for u in source).decode("utf-16-le"))
    except PatternError:
        return "rejected", []
    return "matched", builder.build().find(list(units))


def run_cases(cases: DataFrame) -> DataFrame:
    """case_id, family, status and sorted events of each fixture row; every
    case has patterns of its own, so they are compiled where the row is."""

    def run(it):
        for batch in it:
            rows = batch.to_pylist()
            got = [run_case([(p["pattern_id"], p["utf16"]) for p in r["patterns"]], r["input_utf16"]) for r in rows]
            events = pa.array([[{"pattern_id": i, "start": a, "end": b} for i, a, b in e] for _, e in got], pa.list_(pa.struct([("pattern_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in got], pa.string()), events], names=["case_id", "family", "status", "events"])

    schema = "case_id string, family string, status string, events array<struct<pattern_id: bigint, start: bigint, end: bigint>>"
    return cases.select("case_id", "compatibility_tier", "patterns", "input_utf16").mapInArrow(run, schema)


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id and what differs, for each case that isn't the same on both
    sides: `missing`, `unexpected` or `different`."""
    a = actual.select("case_id", F.struct("status", "events").alias("a"))
    e = expected.select("case_id", F.struct("status", "events").alias("e"))
    j = a.join(e, "case_id", "full_outer")
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("e")), "different")
    return j.select("case_id", verdict.alias("problem")).where("problem is not null")


def totals(actual: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Cases, matched, rejected and events of each family, and of all; with
    the expected results also how many cases were compared, and differ."""
    sums = [F.count("*").alias("cases"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("events")]
    if expected is not None:
        want = expected.select("case_id", F.struct("status", "events").alias("__want"))
        actual = actual.join(want, "case_id", "left")
        differs = ~F.col("__want").eqNullSafe(F.struct("status", "events"))
        sums += [F.count("__want").alias("comparisons"), F.count_if(F.col("__want").isNotNull() & differs).alias("differences")]
    return actual.rollup("family").agg(*sums)
