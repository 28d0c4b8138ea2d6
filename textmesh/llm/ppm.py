"""Language-model scores: prediction by partial matching over bytes.

Contexts of up to `order` bytes form a trie.  A context with n occurrences of
d distinct symbols gives symbol s, seen c(s) times, probability c(s) / (n + d)
and escapes to the next shorter context with d / (n + d); symbols of the
longer contexts are excluded there.  Below the empty context all 257 symbols
(bytes and the end of text) that are left are equally likely.  A document's
score is the log10 probability of its bytes and its end.

Training counts every (order+1)-gram of all training documents in Spark.  All
contexts are kept, so the trie grows with the corpus; `rare`, for experiments,
keeps those that occur at least once in every `rare` symbols.  It is a table
that is dealt over shards by the last `NEAR` symbols of the context: a shard
rolls its grams up to the contexts of that length or more, and only the grams
of up to `NEAR` symbols, whose number the alphabet bounds, are sent to all.

A symbol's probability depends on its (order+1)-gram alone.  Documents are cut
into blocks, the distinct grams of a block go to their shards, which answer
with log probabilities, and the answers meet the block's texts again.

The base score needs the count of every word.  Words that are at least one of
every `TOP` tokens, so at most `TOP` words, are broadcast; the others are joined.

Defined results: null text is the empty text; a null doc_id is not held out;
repeated rows are repeated, and counted as often if they are learnt from; a
long text is counted and scored in parts, over all its bytes; without training
documents all symbols are equally likely and base scores are
log10(1 / (0 + 1 * 1)) = 0; an empty table gives an empty one; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import CHUNK_BYTES, batches, checkpoint, ids_of, partitions, planes, small_batches, spark_hash, unplanes, word_hashes, words

ORDER = 5
#: Words that are one of so many tokens or more are broadcast: no more words than this number.
TOP = 1_000_000
END, START = 256, 257
SYMBOLS = 257
_BITS = 9
#: Last symbols of a context by which the trie is dealt over shards.
NEAR = 3
#: Training symbols for each shard, if that makes more than one for each shuffle partition.
SHARD = 32 << 20
#: Bytes of text whose distinct grams are asked for together.
BLOCK = 8 << 20
_CACHE_BITS = 20
_PLACE_BITS = 22


def gram_codes(buf: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Codes of the (order+1)-gram that ends at each byte and at each end."""
    n, size = len(off) - 1, np.diff(off)
    # text i lies behind `order` more symbols than text i - 1
    at = np.arange(len(buf) + n) + np.repeat(order * np.arange(1, n + 1), size + 1)
    padded = np.full(len(at) + n * order, START, np.int64)
    end = np.zeros(len(at), bool)
    end[off[1:] + np.arange(n)] = True
    padded[at[~end]] = buf
    padded[at[end]] = END
    code = padded[: len(padded) - order].copy()
    for k in range(1, order + 1):
        code <<= _BITS
        code |= padded[k : len(padded) - order + k]
    return code[at - order]


def gram_parts(buf: np.ndarray, off: np.ndarray, order: int, limit: int = CHUNK_BYTES):
    """gram_codes, in several parts if a text alone is much longer than limit."""
    if len(off) != 2 or len(buf) <= 2 * limit:
        yield gram_codes(buf, off, order)
        return
    for lo in range(0, len(buf), limit):
        hi, a = min(len(buf), lo + limit), max(0, lo - order)
        code = gram_codes(buf[a:hi], np.array([0, hi - a]), order)
        yield code[lo - a : len(code) if hi == len(buf) else -1]


def _count_grams(order: int):
    """(gram, n) of a task's documents: a direct-mapped table counts most
    grams, the others are sorted batch by batch."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(it):
        slots = 1 << _CACHE_BITS
        owner, counts = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        for code in (part for _, buf, off in batches(it) for part in gram_parts(buf, off, order)):
            slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            free = owner[slot] == -1
            owner[slot[free]] = code[free]
            own = owner[slot] == code
            counts += np.bincount(slot[own], minlength=slots)
            rest, n = np.unique(code[~own], return_counts=True)
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(n)], schema=schema)
        held = np.flatnonzero(counts)
        for lo in range(0, len(held), 65536):
            part = held[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(owner[part]), pa.array(counts[part])], schema=schema)

    return run


def _count_words(it):
    """(h, n) of the lower-cased words of a task's documents, in parts."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])
    held, size = [], 0

    def merged():
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(n, first)

    def out(h, n):
        for lo in range(0, len(h), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + 65536].view(np.int64)), pa.array(n[lo : lo + 65536])], schema=schema)

    for _, buf, off in batches(it):
        starts, ends, _doc = words(buf, off)
        if len(starts):
            h, n = np.unique(word_hashes(buf, starts, ends, lower=True), return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > 3_000_000:
                h, n = merged()
                held, size = [(h, n)], len(h)
                if size > 1_500_000:
                    yield from out(h, n)
                    held, size = [], 0
    if held:
        yield from out(*merged())


def _mask(symbols: int) -> int:
    return (1 << _BITS * symbols) - 1


def _kinds(a: np.ndarray) -> np.ndarray:
    """The distinct values of an array from 0 on, sorted."""
    a = np.sort(a)
    return a[np.diff(a, prepend=-1) > 0]


def _find(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in the sorted a, -1 where it isn't."""
    if not len(a):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(a, x), len(a) - 1)
    return np.where(a[at] == x, at, -1)


class Level:
    """Contexts of k symbols: the grams of k+1 symbols and their counts, and
    for each context its total, its kinds of symbols, and how often those
    symbols follow the next shorter context.  All arrays are sorted."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, k: int, least: int, shorter: Level | None):
        code = grams & _mask(k + 1)
        order = np.argsort(code, kind="stable")
        code, counts = code[order], counts[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, counts = code[first], np.add.reduceat(counts, first) if len(first) else counts
        ctx = code >> _BITS
        first = np.flatnonzero(np.diff(ctx, prepend=-1))
        size = np.diff(np.append(first, len(ctx)))
        total = np.add.reduceat(counts, first) if len(first) else counts
        if k and least > 1:
            keep = np.repeat(total >= least, size)
            code, counts, size, total = code[keep], counts[keep], size[total >= least], total[total >= least]
            first = np.cumsum(size) - size
        self.k, self.grams, self.counts, self.contexts, self.total, self.kinds = k, code, counts, code[first] >> _BITS, total, size
        above = shorter.counts[np.searchsorted(shorter.grams, code & _mask(k))] if k and len(code) else counts
        self.above = np.add.reduceat(above, first) if len(first) else counts


def log_probabilities(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of every gram after the others.

    What a context has seen, all its suffixes have, so the symbols excluded in
    a context are those of the next longer one that is known."""
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    longer, child = None, None
    for level in reversed(levels):
        at = _find(level.contexts, (grams >> _BITS) & _mask(level.k))
        there = at >= 0
        n, d = (x[at] if len(x) else np.zeros(len(at), np.int64) for x in (level.total, level.kinds))
        if longer is not None and len(longer.contexts):
            n, d = n - np.where(child >= 0, longer.above[child], 0), d - np.where(child >= 0, longer.kinds[child], 0)
        gram = _find(level.grams, grams & _mask(level.k + 1))
        left = open_ & there & (d > 0)
        hit, miss = left & (gram >= 0), left & (gram < 0)
        out[hit] += np.log10(level.counts[gram[hit]] / (n[hit] + d[hit]))
        out[miss] += np.log10(d[miss] / (n[miss] + d[miss]))
        open_ &= ~hit
        longer, child = level, at
    out[open_] -= math.log10(max(1, SYMBOLS - int(levels[0].kinds.sum())))
    return out


def _shard_of(grams: np.ndarray, order: int, shards: int) -> np.ndarray:
    return (spark_hash((grams >> _BITS) & _mask(min(NEAR, order))).view(np.int64) % shards).astype(np.int32)


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(planes(a), "zstd", asbytes=True)


def _unpack(b: bytes, dtype, n: int) -> np.ndarray:
    return unplanes(pa.decompress(b, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype, n)


_PARTS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
_PARTS_SQL = "block long, shard int, n long, data binary"


def _ask(order: int, shards: int):
    """For each block of documents its distinct grams and its rows (shard -1),
    and the distinct grams for each shard."""

    def run(it):
        name = TaskContext.get().partitionId() << 32
        held, grams, size = [], [], 0

        def block():
            g = _kinds(np.concatenate(grams))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            asked = _pack(np.diff(g, prepend=0))
            packed = len(asked).to_bytes(8, "little") + asked + sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([len(g)]), pa.array([packed], pa.binary())], schema=_PARTS)
            s = _shard_of(g, order, shards)
            by = np.argsort(s, kind="stable")
            g, s = g[by], s[by]
            first = np.flatnonzero(np.diff(s, prepend=-1))
            n = np.diff(np.append(first, len(g)))
            data = [_pack(np.diff(g[a : a + k], prepend=0)) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), name)), pa.array(s[first]), pa.array(n), pa.array(data, pa.binary())], schema=_PARTS)

        for batch, buf, off in batches(it):
            held.append(batch)
            grams += [_kinds(part) for part in gram_parts(buf, off, order)]
            size += len(buf)
            if size >= BLOCK:
                yield from block()
                name, held, grams, size = name + 1, [], [], 0
        if held:
            yield from block()

    return run


def _answer(order: int, least: int, shared):
    """The answers to blocks: rows are sorted by shard and block, and the
    grams of a shard's trie come first, under block -1."""

    def run(it):
        now, rows, table = None, [], None

        def made():
            gram, n = (np.concatenate([r[i] for r in rows] or [np.zeros(0, np.int64)]) for i in range(2))
            levels = list(shared.value)
            for k in range(len(levels), order + 1):
                levels.append(Level(gram, n, k, least, levels[-1]))
            gram = np.sort(gram)
            return levels, gram, log_probabilities(levels, gram)

        for batch in it:
            shard, block, gram, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if hi == lo:
                    continue
                if shard[lo] != now:
                    now, rows, table = shard[lo], [], None
                own = lo + int(np.searchsorted(block[lo:hi], 0))
                if own > lo:
                    rows.append((gram[lo:own], n[lo:own]))
                if own == hi:
                    continue
                if table is None:
                    table, rows = made(), []
                levels, known, logs = table
                asked = [np.cumsum(_unpack(batch.column(4)[i].as_py(), np.int64, n[i])) for i in range(own, hi)]
                g = np.concatenate(asked)
                at = _find(known, g)
                out = logs[at] if len(logs) else np.zeros(len(g))
                out[at < 0] = log_probabilities(levels, g[at < 0])
                parts = np.split(out.astype(np.float32), np.cumsum(n[own:hi])[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(block[own:hi]), pa.array(shard[own:hi]), pa.array(n[own:hi]), pa.array([_pack(x) for x in parts], pa.binary())], schema=_PARTS)

    return run


def _blocks(it):
    """(distinct grams, documents, answers in the order of shards) of every
    block; rows are sorted by block and shard."""
    grams, docs, held = None, None, []
    for batch in it:
        shard, n = (batch.column(i).to_numpy() for i in (1, 2))
        for i in range(len(shard)):
            data = batch.column(3)[i].as_py()
            if shard[i] < 0:
                if docs is not None:
                    yield grams, docs, np.concatenate(held)
                cut = 8 + int.from_bytes(data[:8], "little")
                grams, docs, held = np.cumsum(_unpack(data[8:cut], np.int64, n[i])), pa.ipc.open_stream(data[cut:]).read_all(), []
            else:
                held.append(_unpack(data, np.float32, n[i]))
    if docs is not None:
        yield grams, docs, np.concatenate(held)


def _scored_texts(it, order: int, shards: int):
    """(slice of documents, bytes, offsets, PPM scores) of the blocks; most
    grams are found in a direct-mapped table, the others by bisection."""

    def slot_of(g):
        return ((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PLACE_BITS)).astype(np.int64)

    place = np.zeros(1 << _PLACE_BITS, np.int32)
    for g, docs, answers in _blocks(it):
        logs = np.empty(len(g))
        logs[np.argsort(_shard_of(g, order, shards), kind="stable")] = answers
        place[:] = 0
        place[slot_of(g)] = np.arange(len(g))
        for batch, buf, off in batches(docs.to_batches()):
            sums = []
            for code in gram_parts(buf, off, order):
                at = place[slot_of(code)].astype(np.int64)
                other = np.flatnonzero(g[at] != code)
                at[other] = np.searchsorted(g, code[other])
                sums.append(np.add.reduceat(logs[at], off[:-1] + np.arange(len(off) - 1)) if len(code) == len(buf) + len(off) - 1 else logs[at].sum(keepdims=True))
            yield batch, buf, off, sum(sums)


def _dealt_scores(base: DataFrame, learnt: DataFrame, order: int, rare: int | None):
    """(answered blocks of base, number of shards); the trie is that of learnt."""
    spark = base.sparkSession
    n = partitions(spark)
    grams = checkpoint(learnt.select("text").mapInArrow(_count_grams(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // rare)) if rare else 1
    shards = max(n, -(-total // SHARD))
    top = min(NEAR - 1, order)
    gram, count = _columns(grams.groupBy(F.expr(f"gram & {_mask(top + 1)}L").alias("gram")).agg(F.sum("n").alias("n")))
    levels = []
    for k in range(top + 1):
        levels.append(Level(gram, count, k, least, levels[-1] if levels else None))
    asked = checkpoint(base.mapInArrow(_ask(order, shards), _PARTS_SQL))
    near = F.shiftright("gram", _BITS).bitwiseAND(F.lit(_mask(min(NEAR, order))).cast("long"))
    trie = grams.select(F.pmod(F.xxhash64(near), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).cast("long").alias("block"), "gram", "n", F.lit(None).cast("binary").alias("data"))
    requests = asked.where("shard >= 0").select("shard", "block", F.lit(0).cast("long").alias("gram"), "n", "data")
    met = trie.unionByName(requests).repartition(n, "shard").sortWithinPartitions("shard", "block")
    answers = met.mapInArrow(_answer(order, least, spark.sparkContext.broadcast(levels)), _PARTS_SQL)
    whole = asked.where("shard < 0").unionByName(answers).repartition(n, "block").sortWithinPartitions("block", "shard")
    return whole, shards


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    gram, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def _score(order: int, shards: int, hot):
    """One row for each document: PPM score, known part of the base score from
    the hot words, and its other words with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("known", pa.int64()), ("logs", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(it):
        top, top_n, end_n = hot.value
        for batch, buf, off, score in _scored_texts(it, order, shards):
            n = batch.num_rows
            starts, ends, doc = words(buf, off)
            h = word_hashes(buf, starts, ends, lower=True)
            tokens = np.bincount(doc, minlength=n) + 1
            at = np.minimum(np.searchsorted(top, h), max(len(top) - 1, 0))
            is_hot = top[at] == h if len(top) else np.zeros(len(h), bool)
            known = np.bincount(doc[is_hot], minlength=n) + (end_n > 0)
            logs = np.bincount(doc[is_hot], np.log10(top_n[at[is_hot]] + 1.0), minlength=n) + math.log10(end_n + 1)
            rd, rh = doc[~is_hot], h[~is_hot]
            by = np.lexsort((rh, rd))
            rd, rh = rd[by], rh[by]
            new = np.ones(len(rd), bool)
            new[1:] = (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rd))).astype(np.int32)
            lists = pa.array(np.searchsorted(rd[first], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of(batch, "doc_id"), mask=np.asarray(batch.column(0).is_null())), pa.array(tokens), pa.array(score), pa.array(known), pa.array(logs),
                 pa.ListArray.from_arrays(lists, pa.array(rh[first].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times))],
                schema=schema,
            )

    return run


def score_documents(docs: DataFrame, held_out, order: int = ORDER, rare: int | None = None, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte; held_out: boolean column over doc_id of what isn't learnt."""
    spark = docs.sparkSession
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnt = base.where(~held_out)
    dealt, shards = _dealt_scores(base, learnt, order, rare)
    n_train = learnt.count()
    counts = checkpoint(learnt.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = tokens + n_train, kinds + (n_train > 0)
    top_h, top_n = _columns(counts.where(F.col("n") * top >= tokens).select("h", "n"))
    by_h = np.argsort(top_h.view(np.uint64))
    shared = spark.sparkContext.broadcast((top_h.view(np.uint64)[by_h], top_n[by_h], n_train))
    scored = dealt.mapInArrow(_score(order, shards, shared), "doc_id long, n_tokens long, score double, known long, logs double, rare array<long>, times array<int>")
    scored = checkpoint(scored).withColumn("row", F.monotonically_increasing_id())
    rest = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    sums = rest.join(counts, "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("found"))
    j = scored.drop("rare", "times").join(sums, "row", "left")
    each = math.log10(total + distinct + 1)
    return j.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )


def held_out_fold() -> Column:
    """crc32 of doc_id as text, modulo 7, is 2; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


def op4_ppm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, held_out_fold())
