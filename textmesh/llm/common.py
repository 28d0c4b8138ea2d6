"""Shared parts of the corpus operators: words, hashes, workspace, components.

Words are the runs of bytes outside 0x20 and 0x09-0x0D.  They are found and
hashed with numpy over the Arrow text buffer of a whole batch, so that no
Python object is made per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy step takes at once; longer documents go alone.
CHUNK_BYTES = 1 << 20
#: Bytes of a record batch that Spark hands to Python at most.
BATCH_BYTES = 8 << 20
#: Edges whose components one task finds: 8 MB, held a few times over.
EDGES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.where(_SPACE, 0, np.arange(256) + 1).astype(np.uint64)
_WORD_LOWER = _WORD[_LOWER]
LOWER_TABLE = bytes(_LOWER)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for the next batch."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (lo, hi) of documents with about `limit` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word of the texts."""
    return runs(~_SPACE[buf], offsets)


def run_hashes(values: np.ndarray | None, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """The polynomial in base of the values of the bytes of every run [start,
    end), modulo 2**64; runs are in order; values None: a code's is the code
    and one.  A step takes `CHUNK_BYTES` bytes,
    and runs over its border are put together, so that memory doesn't grow
    with the text."""
    h = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(buf) if len(starts) else 0, CHUNK_BYTES):
        hi = min(len(buf), lo + CHUNK_BYTES)
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi)
        if a >= b:
            continue
        prefix = np.zeros(hi - lo + 1, np.uint64)
        value = buf[lo:hi].astype(np.uint64) + np.uint64(1) if values is None else values[buf[lo:hi]]
        np.cumsum(value * powers(base, hi - lo), out=prefix[1:])
        first = np.maximum(starts[a:b], lo) - lo
        part = (prefix[np.minimum(ends[a:b], hi) - lo] - prefix[first]) * powers(inverse, hi - lo)[first]
        if starts[a] < lo:
            part[:1] *= np.uint64(pow(int(base), int(lo - starts[a]), 1 << 64))
        h[a:b] += part
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of True inside a document."""
    z = np.zeros(0, np.int64)
    if not len(inside):
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word: a polynomial over its bytes, then mixed."""
    h = run_hashes(_WORD_LOWER if lower else _WORD, buf, starts, ends, _BASE, _BASE_INV)
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs for whose texts keep(bytes, offsets) is true.  Columns
    go by number meanwhile, as Python functions can't take every name."""
    at = docs.columns.index("text")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(it):
        for batch, buf, off in batches(it, text=f"c{at}"):
            yield batch.filter(pa.array(keep(buf, off)))

    return small_batches(numbered).mapInArrow(run, numbered.schema).toDF(*docs.columns)


def batches(it, limit: int = CHUNK_BYTES, text: str = "text"):
    """(slice of the record batch, bytes, offsets) in steps of bounded size."""
    for batch in it:
        buf, off = utf8(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in chunks(off, limit):
            yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def ids_of(batch: pa.RecordBatch, name: str, null: int = np.iinfo(np.int64).max) -> np.ndarray:
    """An integer column as int64; null takes the largest value."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an integer array, byte position by byte position, so that
    the shuffle's codec finds the runs of equal high bytes."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: memoryview | bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose record batches are bounded by BATCH_BYTES: the
    default, 64 MB, counts several times in the JVM and in each Python worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def spark_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a long: XXH64 of its 8 bytes, seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v, r):
        return (v << np.uint64(r)) | (v >> np.uint64(64 - r))

    h = turn((p5 + np.uint64(50)) ^ (turn(x.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def checkpoint_base(spark: SparkSession) -> str:
    """Spark's checkpoint folder, set to a temporary one only where it is
    unset and the master is local."""
    sc = spark.sparkContext
    base = sc._jsc.sc().getCheckpointDir()
    if base.isDefined():
        return base.get()
    told = sc.getConf().get("spark.checkpoint.dir") or ""
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(told)
    return told


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared checkpoint folder."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, each: int = 1, least: int = 64, most: int = 65536) -> int:
    """A power of two of hash buckets, at least `each` for each shuffle
    partition, so that one bucket is no more than a task may hold."""
    want = min(most, max(least, each * partitions(spark)))
    return 1 << (want - 1).bit_length()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges; root is the smallest node of
    its component.  Larger roots go under smaller ones until no edge has two."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _joined(it):
    got = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in it]
    if got:
        node, root = joined(*(np.concatenate(x) for x in zip(*got, strict=True)))
        for lo in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (node, root)], names=["node", "root"])


def components(edges: DataFrame, together: int = EDGES) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the
    smallest node of its component.

    Up to `together` distinct edges meet in one task, as each query of the
    rounds below costs the driver threads, plans and garbage, whatever its
    rows.  More of them take rounds, with the same result.

    A round alternates large-star and small-star steps: each keeps the components and
    never has more edges than before, apart from duplicates, and a logarithmic
    number of rounds is enough in practice.  The minimum at a star's centre is
    a partial aggregate; it is checkpointed before it is joined, so that both
    sides of the join are plain shuffles, of which adaptive execution splits
    the centre's.  Only a count and a checksum reach the driver.
    """

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("a", "b") % 1000003).cast("long"))).first()
        return tuple(r)

    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = state(e)
    if now[0] <= together:
        return checkpoint(e.repartition(1).mapInArrow(_joined, "node long, root long"))
    while now[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint(large)
        low2 = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low2, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(small.unionByName(low2.select("a", F.col("m").alias("b"))).distinct())
        was, now = now, state(e)
        if was == now:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
