"""Language identification by a string kernel.

Two texts are compared by the n-grams of one to `LONGEST` bytes that they
have: k(x, y) = |X & Y| / sqrt(|X| |Y|), the normalised presence kernel of the
blended spectrum, over the n-grams that at least two landmarks have.  ASCII
letters are lower-cased first.  Nystroem's method with `LANDMARKS` texts turns
the kernel into features, on which one-versus-rest kernel ridge regression is
fitted.  A batch of documents is a presence matrix; one product with the
landmarks' matrix and one with the fitted coefficients score it.

Landmarks and training texts are a bounded sample, `SAMPLE` labelled documents
with the least hash of doc_id: the only bounded part, and a parameter.  Their
kernel rows are computed on the executors.

Defined results: null text and text without a letter are `und` with score 0,
and so is everything if nothing can be learnt; the score is (1 + the largest
regression output) / 2, cut to 0..1; equal outputs go to the first language in
order; of rows that repeat a doc_id with other texts one is learnt from, and all
are judged; an empty table gives an empty one; other columns, whatever their
names, are ignored.  A text of any length is read in steps; the landmarks'
texts, the only ones that the driver reads, are among those of at most
`LANDMARK_BYTES`, if there are any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import LOWER_TABLE, batches, small_batches

LONGEST = 3
LANDMARKS = 128
SAMPLE = 3000
RIDGE = 0.05
STEP_BYTES = 1 << 20
#: Bytes of a text that becomes a landmark.
LANDMARK_BYTES = 1 << 20
#: Cells of a presence matrix that is made at once.
CELLS = 1 << 25

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def lower(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().translate(LOWER_TABLE), np.uint8)


def grams(buf: np.ndarray, off: np.ndarray, n: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of every n-gram inside a document that begins at lo or
    later and before hi."""
    hi = max(lo, min(len(buf) - n + 1, len(buf) if hi is None else hi))
    code = np.zeros(hi - lo, np.int64)
    for k in range(n):
        code = (code << 8) | buf[lo + k : hi + k]
    at = np.arange(lo, hi)
    doc = np.searchsorted(off, at, side="right") - 1
    inside = at + n <= off[doc + 1]
    return doc[inside], code[inside]


class Kernel:
    """Landmarks and their n-grams."""

    def __init__(self, texts: list[bytes], longest: int = LONGEST):
        self.longest = longest
        buf = lower(np.frombuffer(b"".join(texts), np.uint8))
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        kept, cells = [], []
        for n in range(1, longest + 1):
            doc, code = grams(buf, off, n)
            pair = np.unique(doc << 32 | code)
            codes, times = np.unique(pair & 0xFFFFFFFF, return_counts=True)
            kept.append(codes[(times >= 2) | (len(texts) < 4)])
            cells.append(pair)
        width = sum(map(len, kept))
        kind = np.uint16 if width < np.iinfo(np.uint16).max else np.uint32
        self.columns, first = [], 0
        for n, codes in enumerate(kept, 1):
            table = np.full(1 << 8 * n, np.iinfo(kind).max, kind)
            table[codes] = first + np.arange(len(codes))
            self.columns.append(table)
            first += len(codes)
        self.width = width
        matrix = np.zeros((len(texts), width + 1), np.float32)
        for table, pair in zip(self.columns, cells, strict=True):
            col = table[pair & 0xFFFFFFFF].astype(np.int64)
            matrix[pair >> 32, np.minimum(col, width)] = 1
        matrix = matrix[:, :width]
        size = np.maximum(matrix.sum(axis=1, keepdims=True), 1)
        self.landmarks = np.ascontiguousarray((matrix / np.sqrt(size)).T)
        self.own = (matrix / np.sqrt(size)) @ self.landmarks

    def rows(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """k(text, landmark) of every text of a batch."""
        step = max(1, CELLS // (self.width + 1))
        if len(off) - 1 > step:
            cuts = [(a, min(a + step, len(off) - 1)) for a in range(0, len(off) - 1, step)]
            return np.concatenate([self.rows(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in cuts])
        buf = lower(buf)
        present = np.zeros((len(off) - 1, self.width + 1), np.float32)
        flat = present.ravel()
        for n, table in enumerate(self.columns, 1):
            for lo in range(0, len(buf), STEP_BYTES):
                doc, code = grams(buf, off, n, lo, lo + STEP_BYTES)
                col = table[code].astype(np.int64)
                flat[doc * (self.width + 1) + np.minimum(col, self.width)] = 1
        present = present[:, : self.width]
        size = np.maximum(present.sum(axis=1, keepdims=True), 1)
        return (present @ self.landmarks) / np.sqrt(size)


def fit(kernel: Kernel, rows: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(languages, coefficients over landmarks and a constant)."""
    languages = sorted(set(labels.tolist()))
    value, vector = np.linalg.eigh(kernel.own.astype(np.float64))
    keep = value > 1e-6 * max(value.max(initial=0), 1e-12)
    project = vector[:, keep] / np.sqrt(value[keep])
    x = np.column_stack((rows.astype(np.float64) @ project, np.ones(len(rows))))
    y = np.where(labels[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    return languages, np.vstack((project @ w[:-1], w[-1:]))


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(off) - 1, bool), np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.logical_or.reduceat(_LETTERS[buf], off[some])
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _sample(learnt: DataFrame, sample: int, landmarks: int):
    """Ids of the sample, and of the landmarks, spread over the languages."""
    rows = learnt.groupBy("doc_id", "lang").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).collect()
    lang, size = {}, {}
    for r in rows:
        lang.setdefault(r.doc_id, r.lang)
        size[r.doc_id] = max(size.get(r.doc_id, 0), r.size)
    small = [i for i in lang if size[i] <= LANDMARK_BYTES] or list(lang)
    queues = {}
    for i in small:
        queues.setdefault(lang[i], []).append(i)
    chosen, depth = [], 0
    while len(chosen) < min(landmarks, len(small)):
        chosen += [q[depth] for _, q in sorted(queues.items()) if depth < len(q)]
        depth += 1
    return lang, chosen[:landmarks]


def identify(docs: DataFrame, learn: Column, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, lang_pred and score of every row; learn: boolean column over
    doc_id of the rows that may be learnt from, where lang is not null."""
    spark = docs.sparkSession
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnt = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    lang, chosen = _sample(learnt.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.octet_length("text").alias("size")), sample, landmarks)
    if not lang:
        return base.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    pick = learnt.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def texts(ids):  # at most `sample` ids
        few = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        return pick.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    kernel = Kernel([t.encode() for _, t in sorted((r.doc_id, r.text) for r in texts(chosen).collect())])
    shared = spark.sparkContext.broadcast(kernel)

    def kernel_rows(it):
        for batch, buf, off in batches(it, STEP_BYTES):
            k = shared.value.rows(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in k], pa.binary())], names=["doc_id", "k"])

    got = sorted((r.doc_id, bytes(r.k)) for r in texts(lang).mapInArrow(kernel_rows, "doc_id long, k binary").collect())
    rows = np.array([np.frombuffer(k, np.float32) for _, k in got])
    languages, weights = fit(kernel, rows, np.array([lang[i] for i, _ in got]))
    model = spark.sparkContext.broadcast((languages, weights))

    def predict(it):
        names, w = model.value
        for batch, buf, off in batches(it, STEP_BYTES):
            out = shared.value.rows(buf, off).astype(np.float64) @ w[:-1] + w[-1]
            best = out.argmax(axis=1)
            score = np.clip((1 + out[np.arange(len(best)), best]) / 2, 0, 1)
            some = has_letter(buf, off)
            pred = np.where(some, np.array(names, object)[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(np.where(some, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return base.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def fold(modulus: int = 5) -> Column:
    """crc32 of doc_id as text, modulo 5; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def op8_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fold() != 0).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
