"""Exact substring removal by Rabin-Karp window hashes.

A window is `window` consecutive words of one document.  Its Rabin-Karp hash
is a polynomial over 64-bit word hashes modulo 2**64; prefix sums give the
hash of every window of a batch at once.  All windows of all documents are
hashed and counted: tasks first reduce their own blocks (a window keeps only
its smallest document there, larger ones are marked at once), then the hash
buckets are shuffled and each bucket finds the smallest document of a hash.
Marked windows go back to the documents, where overlapping ones merge into
maximal removal intervals.

A hot window leaves one entry for each block of `BLOCK_WINDOWS` windows, not
one for each document, so no bucket grows with the copies of a passage.

Marks belong to a row's key, the hash of its doc_id and text; rows that are
copies, doc_id included, share them, and rows without doc_id, or with one that
many rows have, are as many keys as they have texts.  Only rows whose key may
have marks are shuffled to meet them: a Bloom filter of the keys, of at most
`FILTER_BITS` bits, tells which; all others are passed on where they are.

Defined results: null text has no words; texts shorter than a window lose
nothing; rows that repeat a doc_id are no smaller than each other, and a mark
applies only where the row's own window has the marked hash; a null doc_id
counts as larger than all others; an empty table gives an empty one; extra
columns, whatever their names, are left alone.  A long text goes alone and
takes a small multiple of its size.  Two windows are taken as equal if 64 bits
of hash are; for a corpus of n windows the expected number of false pairs is
n*n / 2**65.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textmesh.llm.common import batches, buckets_for, checkpoint, column, ids_of, mix64, partitions, planes, powers, small_batches, unplanes, unused, word_hashes, words

WINDOW = 50
#: Windows that a task reduces among themselves before it writes them.
BLOCK_WINDOWS = 1_000_000
#: Bits of the filter of marked keys: so many for each key, and at most; bits set for a key.
KEY_BITS, FILTER_BITS, PROBES = 16, 1 << 27, 4

_BASE = np.uint64(0xA24BAED4963EE407)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `window` words, over document bounds too."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=prefix[1:])
    return mix64((prefix[window:] - prefix[:-window]) * powers(_INV, n))


def _windows(buf, off, window):
    """(hash, document, position) of every window of the texts."""
    starts, ends, doc = words(buf, off)
    h = window_hashes(word_hashes(buf, starts, ends), window)
    own = doc[: len(h)] == doc[window - 1 :]
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    at = np.flatnonzero(own)
    d = doc[at]
    return h[at], d, at - first[d]


def _pack_entries(doc, key, pos, h) -> bytes:
    """Windows, sorted by document and key: these once each, then for each
    window their place (delta-coded), position and hash, as byte planes."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    head = len(doc).to_bytes(8, "little") + len(first).to_bytes(8, "little")
    return head + planes(np.diff(doc[first], prepend=0).view(np.uint64)) + planes(key[first]) + planes(new.astype(np.uint8)) + planes(pos.astype(np.uint32)) + planes(h)


def _unpack_entries(b: bytes):
    n, m = int.from_bytes(b[:8], "little"), int.from_bytes(b[8:16], "little")
    view = memoryview(b)[16:]
    doc, key = np.cumsum(unplanes(view, np.uint64, m)).view(np.int64), unplanes(view[8 * m :], np.int64, m)
    view = view[16 * m :]
    place = np.cumsum(unplanes(view, np.uint8, n), dtype=np.int64) - 1
    return doc[place], key[place], unplanes(view[n:], np.uint32, n), unplanes(view[5 * n :], np.uint64, n)


def _unpack_marks(b: bytes):
    n = len(b) // 8
    return unplanes(memoryview(b), np.uint32, n), unplanes(memoryview(b)[4 * n :], np.uint32, n)


_OUT = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("payload", pa.binary())])
_OUT_SQL = "bucket int, key long, payload binary"


def _rows(out: list):
    for i in range(0, len(out), 256):
        part = out[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in part], pa.int32()), pa.array([k for _, k, _ in part], pa.int64()), pa.array([p for _, _, p in part], pa.binary())], schema=_OUT)


def _marks(key, pos, h):
    """(bucket -1, key, payload) of marked windows, once each; a mark keeps 32
    bits of the hash."""
    if not len(key):
        return
    h = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((h, pos, key))
    key, pos, h = key[order], pos[order].astype(np.uint32), h[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1]) | (h[1:] != h[:-1])
    key, pos, h = key[new], pos[new], h[new]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
        yield -1, int(key[lo]), planes(pos[lo:hi]) + planes(h[lo:hi])


def _smaller(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the windows whose hash has a smaller document."""
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    starts = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(ds, starts), np.diff(np.append(starts, len(h))))
    return order[ds > low]


def _reduce(window: int, nb: int):
    """Map side: hash all windows, keep each block's smallest document."""
    shift = np.uint64(64 - (nb - 1).bit_length())

    def rows(h, doc, key, pos):
        late = _smaller(h, doc)
        yield from _marks(key[late], pos[late], h[late])
        keep = np.ones(len(h), bool)
        keep[late] = False
        idx = np.flatnonzero(keep)
        idx = idx[np.lexsort((key[idx], doc[idx]))]
        bucket = (h[idx] >> shift).astype(np.uint16 if nb <= 65536 else np.uint32)
        idx = idx[np.argsort(bucket, kind="stable")]
        bucket = (h[idx] >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(idx)], strict=True):
            at = idx[lo:hi]
            yield int(bucket[lo]), None, _pack_entries(doc[at], key[at], pos[at], h[at])

    def run(it):
        held, size = [], 0
        for batch, buf, off in batches(it):
            h, d, pos = _windows(buf, off, window)
            for lo in range(0, len(h), BLOCK_WINDOWS):  # a long text's windows are several blocks
                part = slice(lo, lo + BLOCK_WINDOWS)
                held.append((h[part], ids_of(batch, "doc_id")[d[part]], ids_of(batch, "key")[d[part]], pos[part].astype(np.uint32)))
                size += len(held[-1][0])
                if size >= BLOCK_WINDOWS:
                    yield from _rows([*rows(*(np.concatenate(x) for x in zip(*held, strict=True)))])
                    held, size = [], 0
        if held:
            yield from _rows([*rows(*(np.concatenate(x) for x in zip(*held, strict=True)))])

    return run


def _grouped(it):
    """(bucket, [rows]) of batches that are sorted by bucket; marks made on the
    map side (bucket -1) come batch by batch."""
    at, held = None, []
    for batch in it:
        for b, k, p in zip(batch.column(0).to_numpy().tolist(), batch.column(1), batch.column(2), strict=True):
            if b != at or (b < 0 and len(held) >= 4096):
                if held:
                    yield at, held
                at, held = b, []
            held.append((k.as_py(), p.as_py()))
    if held:
        yield at, held


def _smallest(it):
    """Bucket side: mark the entries whose hash has a smaller document."""
    for bucket, held in _grouped(it):
        if bucket < 0:
            yield from _rows([(-1, k, p) for k, p in held])
        else:
            doc, key, pos, h = (np.concatenate(x) for x in zip(*(_unpack_entries(p) for _, p in held), strict=True))
            late = _smaller(h, doc)
            yield from _rows([*_marks(key[late], pos[late], h[late])])


def _key() -> Column:
    """A hash of doc_id and text; null is not the empty text of another row."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, marks): the marked windows of all rows that have any, as
    payloads of positions and hashes."""
    spark = docs.sparkSession
    nb = buckets_for(spark, 2)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text"))
    found = small_batches(base).mapInArrow(_reduce(window, nb), _OUT_SQL)
    # marks made on the map side stay out of the buckets' shuffle key
    dealt = found.repartition(partitions(spark), F.when(F.col("bucket") < 0, F.col("key")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    made = dealt.mapInArrow(_smallest, _OUT_SQL)
    return made.groupBy("key").agg(F.collect_set("payload").alias("marks"))


def _places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = mix64(key.view(np.uint64)), mix64(key.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of the distinct keys.  Its words are
    made by an aggregate, and at most `FILTER_BITS` / 64 of them are read."""
    n = keys.count()
    bits = min(FILTER_BITS, 1 << max(12, (KEY_BITS * n).bit_length()))

    def run(it):
        for batch in it:
            at = np.concatenate(_places(batch.column(0).to_numpy(), bits))
            word, where = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    got = keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def _cut_out(raw: bytes, marks: list[bytes], window: int) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, and which of them marked windows cover."""
    ws = raw.split()
    gone = np.zeros(len(ws), bool)
    if marks and len(ws) >= window:
        pos, h = (np.concatenate(x) for x in zip(*(_unpack_marks(m) for m in marks), strict=True))
        own = (_windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), window)[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        inside = pos < len(own)
        pos = pos[inside].astype(np.int64)
        pos = np.unique(pos[own[pos] == h[inside]])
        edge = np.zeros(len(ws) + 1, np.int64)
        edge[pos] += 1
        edge[pos + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
    return ws, gone


def _kept(ws: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join(compress(ws, (~gone).tolist())) if gone.any() else b" ".join(ws)


def _may_have_marks(words_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _places(keys, len(words_) << 6):
        out &= (words_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def _found(docs: DataFrame, window: int):
    """The marks by key, kept, and the shared filter of their keys."""
    found = checkpoint(removed_windows(docs, window))
    return found, docs.sparkSession.sparkContext.broadcast(key_filter(found.select("key")))


def _marked(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [m or [] for m in batch.column(batch.num_columns - 1).to_pylist()]


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<array<long>>"


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and the removed word
    intervals [start, end) of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    found, shared = _found(base, window)
    keyed = small_batches(base.select("doc_id", "text", _key().alias("key")))

    def rows(batch, buf, off, marks):
        data, null = buf.tobytes(), batch.column(1).is_null().to_pylist()
        n_words, n_removed, digests, kept_text, removed = [], [], [], [], []
        for i in range(batch.num_rows):
            raw = data[off[i] : off[i + 1]]
            ws, gone = _cut_out(raw, marks[i], window)
            kept, cut = _kept(ws, gone), int(gone.sum())
            n_words.append(len(ws))
            n_removed.append(cut)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_text.append((None if null[i] else raw.decode()) if not cut else kept.decode())
            removed.append(np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2).tolist() if cut else [])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n_words, n_removed)), pa.array(digests, pa.string()), pa.array(kept_text, pa.string()), pa.array(removed, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    # each path asks the filter in the Python function that it has anyway
    def without_marks(it):
        for batch in it:
            batch = batch.filter(pa.array(~_may_have_marks(shared.value, batch.column(2).to_numpy())))
            for part, buf, off in batches([batch]):
                yield rows(part, buf, off, [[]] * part.num_rows)

    def may_have(it):
        for batch in it:
            yield batch.filter(pa.array(_may_have_marks(shared.value, batch.column(2).to_numpy())))

    def with_marks(it):
        for batch, buf, off in batches(it):
            yield rows(batch, buf, off, _marked(batch))

    met = keyed.mapInArrow(may_have, keyed.schema).join(found, "key", "left").select("doc_id", "text", "marks")
    return keyed.mapInArrow(without_marks, _REMOVED).unionByName(met.mapInArrow(with_marks, _REMOVED))


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the kept words, joined by one space, as text; a text that
    loses nothing stays as it is."""
    key, marks = unused(docs, "key", "marks")
    found, shared = _found(docs, window)

    @arrow_udf("boolean")
    def may_have_marks(keys: pa.Array) -> pa.Array:
        return pa.array(_may_have_marks(shared.value, keys.to_numpy(zero_copy_only=False)))

    @arrow_udf("string")
    def kept(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, m in zip(text, found.to_pylist(), strict=True):
            t = t.as_py()
            ws, gone = _cut_out((t or "").encode(), m or [], window)
            out.append(_kept(ws, gone).decode() if gone.any() else t)
        return pa.array(out, pa.string())

    keyed = docs.withColumn(key, _key())
    there = may_have_marks(F.col(key))
    clean = keyed.where(~there).drop(key)
    met = keyed.where(there).join(found.withColumnsRenamed({"key": key, "marks": marks}), key, "left")
    cut = met.select(*(kept(F.col("text").cast("string"), F.col(marks)).alias("text") if c == "text" else column(c) for c in docs.columns))
    return clean.unionByName(cut) if len(set(docs.columns)) == len(docs.columns) else clean.union(cut)


def op6_substring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), k AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER s) AS h, count(*) OVER s AS n FROM t
  WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), m AS (
  SELECT h, min(doc_id) AS first FROM k WHERE n = 50 GROUP BY h
), f AS (
  SELECT DISTINCT doc_id, i FROM k JOIN m USING (h) WHERE n = 50 AND first < doc_id
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f
), r AS (
  SELECT t.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY t.i) AS kept
  FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
