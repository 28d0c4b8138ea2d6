"""PatternScan: (patterns, texts) -> events, as narrow DataFrame operations.

The matcher is broadcast and evaluated by an Arrow UDF over one column, so
filters on the other columns and column pruning still reach the scan below,
and nothing is shuffled.  A row is a complete text; null gives no events.
Events leave the worker in arrays of a step's rows, not of a record batch's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from textmesh.functions import utf16_batch
from textmesh.plans import expr as E
from textmesh.plans.automaton import COUNTERS, PEAKS
from textmesh.plans.matcher import Matcher

EVENTS = "array<struct<pattern_id: bigint, start: bigint, end: bigint>>"
COUNTS = "array<struct<pattern_id: bigint, n: bigint>>"
EXTENTS = "array<struct<pattern_id: bigint, n: bigint, units: bigint>>"
#: Code units that one step of a batch scans, whose events are held together; a longer text goes alone.
STEP_UNITS = 1 << 20
#: Bytes of a record batch that Spark hands to Python at most; a longer text goes alone.
BATCH_BYTES = 8 << 20
#: Cells (text, pattern) of a step that are counted in one array.
CELLS = 1 << 22
#: Chains of events that overlap, of which fewer are followed one by one.
FEW = 64


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose record batches have `BATCH_BYTES` at most, as a
    batch's texts are held together."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def _share(df_or_spark, matcher: Matcher):
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.sparkContext.broadcast(matcher)


#: Matchers of a Python worker by their keys, the last used last: queries with
#: the same patterns go on with the states that were made before.
_KNOWN: dict = {}
KNOWN = 4


def _local(shared) -> Matcher:
    m = shared.value
    got = _KNOWN.pop(m.key, m)
    _KNOWN[m.key] = got
    while len(_KNOWN) > KNOWN:
        _KNOWN.pop(next(iter(_KNOWN)))
    return got


def _steps(column: pa.Array):
    """(units, row offsets) of the column, in steps of bounded size."""
    units, rows = utf16_batch(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + STEP_UNITS, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, units[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo]
        lo = hi


def _lists(kind: list[str], size: list, *columns) -> pa.ListArray:
    """One list of structs for each row, from parts of sizes and columns."""
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(cat(size)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(cat(x), pa.int64()) for x in columns], names=kind))


def _step_events(matcher: Matcher, column: pa.Array, choose=None):
    """Of each step: its units, its row offsets, the events of each row, and of
    each event ordinal, start and end.  choose: the places of the events
    (ordinal, start, end) to keep."""
    for lo, hi, units, rows in _steps(column):
        start, ordinal, end = matcher.events(units, rows)
        if choose is not None:
            at = choose(ordinal, start, end)
            start, ordinal, end = start[at], ordinal[at], end[at]
        row = np.searchsorted(rows, start, side="right") - 1
        yield units, rows, np.bincount(row, minlength=hi - lo), ordinal, start - rows[row], end - rows[row]


def _event_lists(matcher: Matcher, column: pa.Array, choose=None):
    for _, _, size, ordinal, start, end in _step_events(matcher, column, choose):
        yield _lists(["pattern_id", "start", "end"], [size], [matcher.ids[ordinal]], [start], [end])


def _by_id(matcher: Matcher):
    by_id = np.argsort(matcher.ids)
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    return matcher.ids[by_id], rank


def _parts(matcher: Matcher, units: np.ndarray, rows: np.ndarray, choose=None):
    """The events of a step: of one chunk of starts at a time, or those chosen."""
    if choose is None:
        for automaton in matcher.automata:
            yield from automaton.scan_chunks(units, rows)
    else:
        start, ordinal, end = matcher.events(units, rows)
        at = choose(ordinal, start, end)
        yield start[at], ordinal[at], end[at]


def _count_lists(matcher: Matcher, column: pa.Array, extent: bool = False, choose=None):
    """The events of one chunk of starts are held at a time.  extent: also how
    many units they cover."""
    ids, rank = _by_id(matcher)
    k = len(ids)
    for lo, hi, units, rows in _steps(column):
        dense = [np.zeros((hi - lo) * k, np.int64) for _ in range(1 + extent)] if (hi - lo) * k <= CELLS else None
        cells, parts = [], [[] for _ in range(1 + extent)]
        for start, ordinal, end in _parts(matcher, units, rows, choose):
            cell = (np.searchsorted(rows, start, side="right") - 1) * k + rank[ordinal]
            if dense is None:
                c, cell = np.unique(cell, return_inverse=True)
                cells.append(c)
            elif len(cell):  # the cells of the rows that the part has
                first = int(cell.min()) // k * k
                cell -= first
            for j, w in enumerate((None, end - start)[: 1 + extent]):
                # the sum of a part's weights is below 2**53, so it is exact
                n = np.bincount(cell, w).astype(np.int64)
                if dense is None:
                    parts[j].append(n)
                elif len(n):
                    dense[j][first : first + len(n)] += n
        if dense is not None:
            cell = np.flatnonzero(dense[0])
            values = [x[cell] for x in dense]
        else:
            cell, at = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_inverse=True)
            values = [np.zeros(len(cell), np.int64) for _ in parts]
            for v, n in zip(values, parts, strict=True):
                np.add.at(v, at, np.concatenate([np.zeros(0, np.int64), *n]))
        yield _lists(["pattern_id", "n", "units"][: 2 + extent], [np.bincount(cell // k, minlength=hi - lo)], [ids[cell % k]], *([v] for v in values))


def _count_list(matcher: Matcher, column: pa.Array) -> pa.Array:
    return pa.concat_arrays([_lists(["pattern_id", "n"], [], [], []), *_count_lists(matcher, column)])


def _member_list(matcher: Matcher, column: pa.Array) -> pa.Array:
    """Sorted ids with an event; a text in which an automaton has found all its
    patterns isn't scanned on."""
    ids, rank = _by_id(matcher)
    k, size, found = len(ids), [np.zeros(0, np.int64)], []
    for lo, hi, units, rows in _steps(column):
        cells = []
        for automaton in matcher.automata:
            own, seen, only = len(automaton.ends), np.zeros(hi - lo, np.int64), np.ones(len(units), bool)
            mine = np.zeros(0, np.int64)
            for start, ordinal, _ in automaton.scan_chunks(units, rows, only=only):
                cell = np.unique((np.searchsorted(rows, start, side="right") - 1) * k + rank[ordinal])
                new = np.setdiff1d(cell, mine, assume_unique=True)
                mine = np.union1d(mine, new)
                if len(new):
                    seen += np.bincount(new // k, minlength=hi - lo)
                    for r in np.unique(new // k)[seen[np.unique(new // k)] == own]:
                        only[rows[r] : rows[r + 1]] = False
            cells.append(mine)
        cell = np.sort(np.concatenate(cells))
        size.append(np.bincount(cell // k, minlength=hi - lo))
        found.append(ids[cell % k])
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(size)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64()))


def without_overlap(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the events that a scan from the left takes in each group;
    events are sorted by group and start, one for each."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    span = int(end.max()) + 1
    key = group * span + start
    after = np.searchsorted(key, group * span + end)  # where nothing is left, the next group's first
    # an event that none before it overlaps is taken; a chain of others follows it
    taken = np.ones(n, bool)
    taken[1:] = np.maximum.accumulate(after)[:-1] <= np.arange(1, n)
    at = after[taken]
    while len(at := at[at < n]) and len(at := at[~taken[at]]):
        if len(at) < FEW:
            for first in at.tolist():
                _follow(after, first, taken)
            break
        taken[at] = True
        at = after[at]
    return np.flatnonzero(taken)


def _follow(after: np.ndarray, at: int, taken: np.ndarray) -> None:
    """Marks the chain from `at` on, up to an event that is taken."""
    size = 256
    while at < len(after) and not taken[at]:
        lo, own = at, []
        part, size = after[lo : lo + size].tolist(), min(2 * size, 1 << 16)
        seen = taken[lo : lo + len(part)].tolist()
        while at - lo < len(part) and not seen[at - lo]:
            own.append(at)
            at = part[at - lo]
        taken[own] = True


def _leftmost(ordinal, start, end):
    if not len(start) or ordinal.min() == ordinal.max():
        return without_overlap(np.zeros(len(start), np.int64), start, end)
    order = np.argsort(ordinal, kind="stable")
    return np.sort(order[without_overlap(ordinal[order], start[order], end[order])])


def events_udf(spark, matcher: Matcher):
    """Arrow UDF: text, array<int> of code units or UTF-16LE binary to events."""
    shared = _share(spark, matcher)

    @arrow_udf(EVENTS)
    def find_events(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            yield from _event_lists(_local(shared), column)

    return find_events


def members_udf(spark, matcher: Matcher):
    """Arrow UDF: the sorted ids of the patterns that have an event."""
    shared = _share(spark, matcher)

    @arrow_udf("array<bigint>")
    def find_members(column: pa.Array) -> pa.Array:
        return _member_list(_local(shared), column)

    return find_members


def leftmost_udf(spark, matcher: Matcher):
    """Arrow UDF: the events of each pattern that don't overlap, from the left."""
    shared = _share(spark, matcher)

    @arrow_udf(EVENTS)
    def find_leftmost(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            yield from _event_lists(_local(shared), column, _leftmost)

    return find_leftmost


def counts_udf(spark, matcher: Matcher):
    """Arrow UDF: the number of events of each pattern that has any; no event
    leaves the Python worker."""
    shared = _share(spark, matcher)

    @arrow_udf(COUNTS)
    def count_events(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            yield from _count_lists(_local(shared), column)

    return count_events


def extents_udf(spark, matcher: Matcher, leftmost: bool = False):
    """As counts_udf, with the number of units that the events cover."""
    shared, choose = _share(spark, matcher), _leftmost if leftmost else None

    @arrow_udf(EXTENTS)
    def add_up(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            yield from _count_lists(_local(shared), column, True, choose)

    return add_up


def row_filter(matcher: Matcher, text: Column) -> Column | None:
    """A condition that every text with an event meets: one of the necessary
    literals is in it.  Parquet can test it for row groups and Spark before
    the text goes to Python."""
    literals = matcher.necessary_literals()
    if literals is None:
        return None
    out = None
    for s in literals:
        out = text.contains(s) if out is None else out | text.contains(s)
    return out


def _source(df: DataFrame, matcher: Matcher, column: str, outer: bool) -> DataFrame:
    bounded(df)
    if matcher.prefilter and matcher.literal_prefilter and not outer and isinstance(df.schema[column].dataType, StringType) and (keep := row_filter(matcher, F.col(column))) is not None:
        return df.where(keep)
    return df


def scan(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None, outer: bool = False) -> DataFrame:
    """One row for each event: the keys, pattern_id, start and end.  outer: a
    row without events gives one with nulls."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    clash = {"pattern_id", "start", "end"} & set(keys)
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}: events have columns of these names")
    found = events_udf(df.sparkSession, matcher)(F.col(column))
    make = F.inline_outer if outer else F.inline
    return _source(df, matcher, column, outer).select(*keys, make(found))


def counts(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None) -> DataFrame:
    """keys, pattern_id and n, for each row and pattern with events."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    return _source(df, matcher, column, False).select(*keys, F.inline(counts_udf(df.sparkSession, matcher)(F.col(column))))


def extents(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None, leftmost: bool = False) -> DataFrame:
    """keys, pattern_id, n and units, for each row and pattern with events: how
    many there are, and the sum of their lengths.  leftmost: of the events that
    a scan from the left takes without overlap."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    return _source(df, matcher, column, False).select(*keys, F.inline(extents_udf(df.sparkSession, matcher, leftmost)(F.col(column))))


def membership(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None) -> DataFrame:
    """keys and the sorted array of the ids that have an event in the row."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    return bounded(df).select(*keys, members_udf(df.sparkSession, matcher)(F.col(column)).alias("pattern_ids"))


def scan_leftmost(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Of each pattern's events in a row those that a scan from the left takes
    without overlap; nothing is shuffled."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    return _source(df, matcher, column, False).select(*keys, F.inline(leftmost_udf(df.sparkSession, matcher)(F.col(column))))


def matched_text(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Events with the text they cover.  Exact for every text: where a span
    cuts a surrogate pair, the half is replaced by U+FFFD."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    shared = _share(df, matcher)
    kind = EVENTS[:-2] + ", matched: string>>"

    @arrow_udf(kind)
    def with_text(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _local(shared)
        for column in it:
            for units, rows, size, ordinal, start, end in _step_events(m, column):
                raw = units.astype("<u2").tobytes()
                base = np.repeat(rows[:-1], size)
                text = pa.array([raw[2 * i : 2 * j].decode("utf-16-le", "replace") for i, j in zip((base + start).tolist(), (base + end).tolist(), strict=True)], pa.string())
                got = _lists(["pattern_id", "start", "end"], [size], [m.ids[ordinal]], [start], [end])
                items = pa.StructArray.from_arrays([*got.values.flatten(), text], names=["pattern_id", "start", "end", "matched"])
                yield pa.ListArray.from_arrays(got.offsets, items)

    return _source(df, matcher, column, False).select(*keys, F.inline(with_text(F.col(column))))


def scan_split(df: DataFrame, matcher: Matcher, column: str = "text", keys: list[str] | None = None, piece: int = 1 << 20) -> DataFrame:
    """As scan, but the starts of a long text are dealt over several tasks.

    Texts of up to `piece` units are scanned where they are.  A longer one is
    cut: if no match is longer than a known length, a piece goes with so many
    units more and one before, so that what is shuffled is little more than
    the long texts; otherwise each piece needs the whole text."""
    keys = [c for c in df.columns if c != column] if keys is None else keys
    shared = _share(df, matcher)
    most = [E.most_consumed(p.tree) or 0 for p in matcher.patterns]
    reach = None if E.UNBOUNDED in most else int(max(most))

    @arrow_udf(EVENTS)
    def part(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for col, lo, hi, base in it:
            held, parts = 0, ([], [], [], [])
            for k, (a, b, at) in enumerate(zip(lo.to_pylist(), hi.to_pylist(), base.to_pylist(), strict=True)):
                units, rows = utf16_batch(col.slice(k, 1))
                start, ordinal, end = shared.value.events(units, rows, a - at, min(len(units), b - at))
                for x, values in zip(parts, ([len(start)], shared.value.ids[ordinal], start + at, end + at), strict=True):
                    x.append(values)
                held += b - a
                if held >= STEP_UNITS or k + 1 == len(col):
                    yield _lists(["pattern_id", "start", "end"], *parts)
                    held, parts = 0, ([], [], [], [])

    names = _names(df, "units", "lo", "hi", "base")
    kind = df.schema[column].dataType
    if isinstance(kind, ArrayType):
        size, whole = F.size(column), F.col(column)
        cut = lambda a, n: F.slice(F.col(names[0]), a + 1, n)
    else:
        whole = F.encode(column, "UTF-16LE") if isinstance(kind, StringType) else F.col(column)
        size = F.coalesce(F.octet_length(whole) / 2, F.lit(0)).cast("int")
        cut = lambda a, n: F.substring(F.col(names[0]), 2 * a + 1, 2 * n)
    # a text has no more units than twice its characters, so short ones aren't converted to be measured
    long = F.length(column) * 2 > piece if isinstance(kind, StringType) else size > piece
    short = scan(df.where(F.coalesce(~long, F.lit(True))), matcher, column, keys)
    lo = F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(piece))).alias(names[1])
    pieces = bounded(df).where(long).select(*keys, whole.alias(names[0]), lo).withColumn(names[2], F.col(names[1]) + piece)
    if reach is None:
        pieces = pieces.withColumn(names[3], F.lit(0))
    else:
        base = F.greatest(F.col(names[1]) - 1, F.lit(0))
        pieces = pieces.withColumn(names[3], base).withColumn(names[0], cut(F.col(names[3]), F.lit(piece + reach + 2)))
    dealt = pieces.repartition(F.xxhash64(*keys, names[1]) if keys else F.col(names[1]))
    return short.unionByName(dealt.select(*keys, F.inline(part(*(F.col(n) for n in names)))))


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def register(spark, name: str, matcher: Matcher) -> None:
    """Makes the scan a SQL function: SELECT k, e.* FROM t LATERAL VIEW
    inline(name(text)) e."""
    spark.udf.register(name, events_udf(spark, matcher))


#: Facts about the matcher that a row of diagnostics has.
_MATCHER_FACTS = ["automata", "assertion_automata", "patterns", "workers", "state_budget", "beginnings_bytes"]


def diagnostics(df: DataFrame, matcher: Matcher, column: str = "text") -> DataFrame:
    """Counters of a scan, one row for each step of a batch, with the path that
    decided where matches may begin (`beginnings`, `first_unit`, `all`, `none`
    of one row's automata, or `mixed`) and the state path (`table`, `plain`)."""
    shared = _share(df, matcher)
    names = ["texts", "units", *COUNTERS, *_MATCHER_FACTS]

    def run(it):
        m = shared.value
        facts = [len(m.automata), sum(a.facts for a in m.automata), len(m.ids), m.workers, sum(a.budget for a in m.automata), sum(a.beginnings.nbytes for a in m.automata if a.beginnings is not None)]
        for batch in it:
            for lo, hi, units, rows in _steps(batch.column(0)):
                for a in m.automata:
                    a.counters = dict.fromkeys(COUNTERS, 0)
                m.events(units, rows)
                paths = {"all" if not a.filter_starts else "beginnings" if a.counters["masked_places"] else "first_unit" for a in m.automata} if len(units) else {"none"}
                row = [hi - lo, len(units), *(sum(a.counters[c] for a in m.automata) for c in COUNTERS), *facts]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x], pa.int64()) for x in row), pa.array([paths.pop() if len(paths) == 1 else "mixed"]), pa.array(["plain" if m.budget == 0 else "table"])],
                    names=[*names, "start_path", "state_path"],
                )

    return bounded(df).select(column).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", start_path string, state_path string")


def merge_diagnostics(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: sums of the counters, maxima of the peaks, facts as they are,
    paths that differ as `mixed`; steps without text don't count for paths."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["texts", "units", *COUNTERS] if c not in PEAKS]
    tops = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in [*sorted(PEAKS), *_MATCHER_FACTS]]
    path = lambda c: F.when(F.count_distinct(F.nullif(F.col(c), F.lit("none"))) > 1, "mixed").otherwise(F.coalesce(F.max(F.nullif(F.col(c), F.lit("none"))), F.lit("none"))).alias(c)
    return rows.groupBy(*(keys or [])).agg(*sums, *tops, path("start_path"), path("state_path"))
