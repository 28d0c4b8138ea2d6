"""Relational operators over events: counts, digests, selection, comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmesh.operators.scan import without_overlap


def pattern_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("pattern_id").agg(F.count("*").alias("n"))


def matched_ids(events: DataFrame) -> DataFrame:
    return events.select("pattern_id").distinct()


def leftmost_longest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The events of each text and pattern that a scan from the left would
    take without overlap.  Events stream past in order of start, and only the
    last end that was taken is held.  Where the texts are at hand,
    `scan.scan_leftmost` needs no shuffle."""
    by = [*keys, "pattern_id"]
    kind = events.select(*by, "start", "end").schema

    def run(it):
        held, last = None, 0  # the group of the last batch's last row, and its last end
        for batch in it:
            if not batch.num_rows:
                continue
            start, end = (batch.column(len(by) + k).to_numpy() for k in range(2))
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in range(len(by)):
                col = batch.column(k)
                new[1:] |= ~pc.fill_null(pc.equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(col[1:]), pc.is_null(col[:-1])).to_numpy(zero_copy_only=False)
            group = np.cumsum(new)
            first = [batch.column(k)[0].as_py() for k in range(len(by))]
            free = (group > 1) | (start >= last) if held == first else np.ones(len(start), bool)
            at = np.flatnonzero(free)
            at = at[without_overlap(group[at], start[at], end[at])]
            held = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(len(by))]
            mine = at[group[at] == group[-1]]
            last = int(end[mine[-1]]) if len(mine) else last
            yield batch.take(pa.array(at))

    ordered = events.select(*by, "start", "end").repartition(*by).sortWithinPartitions(*by, "start", "end")
    return ordered.mapInArrow(run, kind)


def first_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each text and pattern."""
    w = Window.partitionBy(*keys, "pattern_id").orderBy("start", "end")
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def same_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the number of events that one of two multisets lacks."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differences"))


def event_hashes(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a, 64 bits, over the id (4 bytes), start and end (8 bytes each),
    little-endian."""
    h = np.full(len(ids), 0xCBF29CE484222325, np.uint64)
    for values, width in ((ids, 4), (starts, 8), (ends, 8)):
        v = values.astype(np.uint64)
        for k in range(width):
            h = (h ^ ((v >> np.uint64(8 * k)) & np.uint64(0xFF))) * np.uint64(0x100000001B3)
    return h


def digest(events: DataFrame) -> DataFrame:
    """One row (n, digest): an order-independent digest of (pattern_id, start,
    end): wrapping sum, xor of hashes rotated by id, wrapping sum of squares.
    Tasks reduce their own events; sums are exact decimals modulo 2**64."""

    def run(it):
        n, total, xor, squares = 0, 0, 0, 0
        for batch in it:
            ids, starts, ends = (batch.column(k).to_numpy() for k in range(3))
            h = event_hashes(ids, starts, ends)
            turn = (ids % 64).astype(np.uint64)
            n += len(h)
            total += int(h.sum(dtype=np.uint64))
            squares += int((h * h).sum(dtype=np.uint64))
            turned = (h << turn) | np.where(turn > 0, h >> (np.uint64(64) - np.maximum(turn, np.uint64(1))), np.uint64(0))
            xor ^= int(np.bitwise_xor.reduce(turned)) if len(h) else 0
        mask = (1 << 64) - 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([str(total & mask)]), pa.array([np.uint64(xor).view(np.int64).item()]), pa.array([str(squares & mask)])], names=["n", "total", "x", "squares"])

    parts = events.select(*(F.col(c).cast("long").alias(c) for c in ("pattern_id", "start", "end"))).mapInArrow(run, "n long, total string, x long, squares string")
    wrap = lambda c: F.lower(F.lpad(F.conv((F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) % F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.concat(F.lit("multiset64:"), wrap("total"), F.lit(":"), F.lower(F.lpad(F.hex(F.coalesce(F.bit_xor("x"), F.lit(0))), 16, "0")), F.lit(":"), wrap("squares")).alias("digest"))


def _fold(h: int, pattern_id: int, start: int, end: int) -> int:
    for byte in pattern_id.to_bytes(4, "little") + start.to_bytes(8, "little") + end.to_bytes(8, "little"):
        h = ((h ^ byte) * 0x100000001B3) & ((1 << 64) - 1)
    return h


def ordered_digest(events: list[tuple[int, int, int]]) -> str:
    """FNV-1a over events in the given order."""
    h = 0xCBF29CE484222325
    for e in events:
        h = _fold(h, *e)
    return f"{h:016x}"


def ordered_digests(events: DataFrame, keys: list[str]) -> DataFrame:
    """The ordered digest of each text's events, in order of pattern and start.
    Events stream past in this order; only the hash so far is held."""
    kind = events.select(*keys).schema
    names = [*keys, "digest"]

    def run(it):
        now, h = None, 0
        for batch in it:
            out = []
            for *key, pattern_id, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, f"{h:016x}"))
                    now, h = key, 0xCBF29CE484222325
                h = _fold(h, pattern_id, start, end)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, f"{h:016x}")], names=names)

    ordered = events.select(*keys, "pattern_id", "start", "end").repartition(*keys).sortWithinPartitions(*keys, "pattern_id", "start", "end")
    return ordered.mapInArrow(run, kind.add("digest", "string"))


#: Rows up to which a group is ordered as a whole by `upper_median`.
SMALL_GROUP = 10_000


def upper_median(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The upper middle of each group's sorted numbers (null ones don't count).

    Approximate percentiles bracket the middle of a large group, so that only
    what lies between them is ordered; what lies below is counted."""
    keys = keys or []
    held, v, bottom, top, total = "__held", F.col(value), "__bottom", "__top", "__total"
    rows = df.where(v.isNotNull()).select(*keys, v)
    near = F.percentile_approx(value, F.array(F.lit(0.49), F.lit(0.51)), F.lit(10_000))
    bracket = rows.groupBy(*keys).agg(F.count("*").alias(total), F.min(v).alias("__min"), F.max(v).alias("__max"), near.alias("__near"))
    small = F.col(total) <= SMALL_GROUP
    bracket = bracket.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), total, F.when(small, F.col("__min")).otherwise(F.col("__near")[0]).alias(bottom), F.when(small, F.col("__max")).otherwise(F.col("__near")[1]).alias(top))
    if keys:
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & rows[k].eqNullSafe(F.col(f"__k{i}"))
        met = rows.join(bracket, same).drop(*(f"__k{i}" for i in range(len(keys))))
    else:
        n, lo, hi = bracket.first()
        met = rows.withColumns({total: F.lit(n).cast("long"), bottom: F.lit(lo), top: F.lit(hi)})
    kind = rows.schema[value].dataType
    each = met.where(v <= F.col(top)).groupBy(*keys, F.when(v >= F.col(bottom), v).cast(kind).alias("median")).agg(F.count("*").alias(held), F.max(total).alias(total))
    upto = F.sum(held).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("median").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.floor(F.col(total) / 2) + 1
    return each.withColumn("__upto", upto).where(F.col("median").isNotNull() & (F.col("__upto") >= rank) & (F.col("__upto") - F.col(held) < rank)).select(*keys, "median")
