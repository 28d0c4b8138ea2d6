"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic regressions on
the presence of words; each regression also gets the probabilities of the
earlier categories.  While fitting, those are predictions out of fold: for each of
`FOLDS` parts of the sample they come from a model, feature choice included,
that has not seen the part.  While scoring, models of the whole sample give
them.  A category's threshold is the one with the best F1 out of fold, among
those whose precision there is `PRECISION` or more.

Words are runs of ASCII letters and bytes beyond ASCII, lower-cased.  A model
uses the `WORDS` words whose presence differs most between its classes.

The models are fitted on a bounded sample, `SAMPLE` labelled documents with
the least hash of doc_id; all their distinct word hashes are taken on the
executors, where one task fits; the driver gets the models.  Every document is scored over its whole text.

Defined results: null and empty texts have no words and get what the constant
and the earlier categories say; a null label isn't learnt from; without both
classes a category has probability 0 or 1, as all labels say, or 0; without
documents there are no rows, without labels all probabilities are 0; of rows
that repeat a doc_id one is learnt from and all are scored, and of labels that
repeat one the largest counts; a null doc_id is scored; words whose difference
ties go by their hash; other columns, whatever their names, are kept by
`drop_toxic` and left out by `classify`.  A text of any length is hashed in
steps; a sampled text sends its distinct words to the task that fits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import _LOWER, batches, kept_rows, mix64, run_hashes, runs, small_batches

#: (name, condition over the columns of labels) in the chain's order.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]
SAMPLE = 8000
FOLDS = 3
WORDS = 192
#: Sample documents of a fold that a word needs.
SEEN = 5
RIDGE = 1.0
#: Share of right rejections that a threshold has out of fold.
PRECISION = 0.9
#: Standard errors by which a word's presence in the two classes differs at least.
LEAST_Z = 3.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = np.where(_LETTER, _LOWER.astype(np.uint64) + np.uint64(1), np.uint64(0))
_BASE = np.uint64(0x9FB21C651E98DF25)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def letter_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of letters."""
    start, end, doc = runs(_LETTER[buf], off)
    return doc, mix64(run_hashes(_VALUE, buf, start, end, _BASE, _INV))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Regression:
    """Ridge logistic regression on chosen words and earlier probabilities."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, extra: np.ndarray, constant: float):
        self.words, self.weights, self.extra, self.constant = words, weights, extra, constant

    def logit(self, n: int, doc: np.ndarray, h: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """For n documents with words (doc, h), repeats allowed."""
        out = np.full(n, self.constant)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            pair = np.unique(doc[hit] * len(self.words) + at[hit])
            out += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], minlength=n)
        return out + earlier @ self.extra


def fit(n: int, doc: np.ndarray, h: np.ndarray, earlier: np.ndarray, y: np.ndarray, words: int = WORDS, ridge: float = RIDGE) -> Regression:
    """doc, h: the distinct words of each of n documents."""
    share = y.mean() if n else 0.0
    if share in (0.0, 1.0):
        return Regression(np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), 30.0 if share else -30.0)
    vocabulary, at = np.unique(h, return_inverse=True)
    yes = np.bincount(at, y[doc], minlength=len(vocabulary))
    both = np.bincount(at, minlength=len(vocabulary))
    n1 = y.sum()
    p, q = yes / n1, (both - yes) / (n - n1)
    pool = both / n
    z = np.where(both >= min(SEEN, n), np.abs(p - q) / np.sqrt(np.maximum(pool * (1 - pool) * (1 / n1 + 1 / (n - n1)), 1e-12)), -1)
    best = np.sort(np.lexsort((vocabulary, -z))[:words])
    best = best[z[best] >= LEAST_Z]
    column = np.full(len(vocabulary), -1)
    column[best] = np.arange(len(best))
    x = np.zeros((n, len(best) + earlier.shape[1] + 1))
    col = column[at]
    x[doc[col >= 0], col[col >= 0]] = 1
    x[:, len(best) : -1] = earlier
    x[:, -1] = 1
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for _ in range(25):  # Newton's method
        m = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * np.maximum(m * (1 - m), 1e-6)) @ x + np.diag(penalty), x.T @ (y - m) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Regression(vocabulary[best], w[: len(best)], w[len(best) : -1], float(w[-1]))


def _best_threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """Between the probabilities where F1 is greatest among the thresholds of
    that precision or more; 0.5 if there is none."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    last &= hits >= precision * np.arange(1, len(p) + 1)
    if not last.any():
        return 0.5
    k = int(np.argmax(np.where(last, f1, -1)))
    low = p[order][k]
    return float(low + (p[order][k + 1] if k + 1 < len(p) else 0.0)) / 2


def fit_chain(sizes: np.ndarray, h: np.ndarray, labels: np.ndarray, folds: np.ndarray, n_folds: int = FOLDS):
    """sizes: words of each document in h; labels: (documents, categories).
    Returns the regressions, thresholds and out-of-fold probabilities."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    earlier = np.zeros((n, 0))
    models, cuts = [], []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        out = np.zeros(n)
        for k in range(n_folds):
            test = folds == k
            rank = np.cumsum(~test) - 1
            mine = ~test[doc]
            m = fit(int((~test).sum()), rank[doc[mine]], h[mine], earlier[~test], y[~test])
            rank_t = np.cumsum(test) - 1
            out[test] = m.logit(int(test.sum()), rank_t[doc[~mine]], h[~mine], earlier[test])
        models.append(fit(n, doc, h, earlier, y))
        cuts.append(_best_threshold(_sigmoid(out), y))
        earlier = np.column_stack((earlier, _sigmoid(out)))
    return models, cuts, earlier


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE):
    """Chain of the labelled documents."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(c).cast("int").alias(f"y{i}") for i, (_, c) in enumerate(categories))).dropna()
    ys = [f"y{i}" for i in range(len(categories))]
    few = known.groupBy("doc_id").agg(*(F.max(y).alias(y) for y in ys)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    truth = {r.doc_id: [r[y] for y in ys] for r in few}
    if not truth:
        zero = Regression(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), -30.0)
        return [Regression(zero.words, zero.weights, np.zeros(i), -30.0) for i in range(len(categories))], [0.5] * len(categories)

    def hashes(it):
        for batch, buf, off in batches(it):
            doc, h = letter_words(buf, off)
            cut = np.searchsorted(doc, np.arange(len(off)))
            out = [np.unique(h[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "h"])

    def chain(it):
        got = sorted((i, h) for batch in it for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if got:
            words = [np.frombuffer(b, np.uint64) for _, b in got]
            y = np.array([truth[i] for i, _ in got])
            folds = (mix64(np.array([i for i, _ in got], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
            models, cuts, _ = fit_chain(np.array([len(w) for w in words]), np.concatenate(words), y, folds)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((models, cuts))], pa.binary())], names=["chain"])

    wanted = F.broadcast(spark.createDataFrame([(i,) for i in truth], "doc_id long"))  # at most `sample` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")
    one = texts.mapInArrow(hashes, "doc_id long, h binary").groupBy("doc_id").agg(F.min("h").alias("h"))
    fitted = one.coalesce(1).mapInArrow(chain, "chain binary").collect()  # at most `sample` rows meet in a task
    if not fitted:
        return [Regression(np.zeros(0, np.uint64), np.zeros(0), np.zeros(i), -30.0) for i in range(len(categories))], [0.5] * len(categories)
    return pickle.loads(fitted[0].chain)


def _probabilities(models, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text of a batch, by category."""
    doc, h = letter_words(buf, off)
    p = np.zeros((len(off) - 1, 0))
    for m in models:
        p = np.column_stack((p, _sigmoid(m.logit(len(off) - 1, doc, h, p))))
    return p


def classify(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, train_docs: DataFrame | None = None) -> DataFrame:
    """doc_id and, for each category, p_<name> and is_<name> of every row;
    train_docs: the labelled documents, if they aren't among docs."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs if train_docs is None else train_docs, labels, categories, sample))
    names = [f"{x}_{n}" for n, _ in categories for x in ("p", "is")]

    def run(it):
        models, cuts = chain.value
        for batch, buf, off in batches(it):
            p = _probabilities(models, buf, off)
            made = [x for k in range(len(cuts)) for x in (pa.array(np.round(p[:, k], 6)), pa.array(p[:, k] >= cuts[k]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(base).mapInArrow(run, "doc_id long, " + ", ".join(f"`{n}` {'double' if n.startswith('p_') else 'boolean'}" for n in names))


def drop_toxic(docs: DataFrame, labels: DataFrame, category: str = "toxic", categories=CATEGORIES, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows of the category; all columns are kept as they are."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, sample))
    k = [n for n, _ in categories].index(category)

    def keep(buf, off):
        models, cuts = chain.value
        return _probabilities(models, buf, off)[:, k] < cuts[k]

    return kept_rows(docs, keep)


def op1_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
