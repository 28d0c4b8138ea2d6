"""Benchmark decontamination with a BM25 index of the test items.

The inverted index holds, for each term, its impact on each item: the item's
BM25 weight of the term divided by the item's score for itself, so that one
threshold serves all items.  Items are put in classes by length, which double
from one to the next, and inside a class they are dealt into blocks; each term
keeps its largest impact in every block.

For each class every document is cut into segments of as many words as the
class's longest item has; a passage is two neighbouring segments, so each run
of that many words lies in one.  Every passage is a query.  It is skipped if
its terms' largest impacts don't add up to the threshold.  As in WAND, only
an item's essential terms, its rarest, lead to it: those without which the
others stay under `REST`.  A block is opened for a passage only if the block
maxima of the passage's essential terms, and `REST`, reach the threshold.  All
items of the opened blocks are scored over all terms, and all that reach the
threshold are retrieved, none is cut off.  These tests are made for a whole
batch at once, over the postings that the passages' terms have.

A retrieved item is verified: at least `OVERLAP` of the five-word shingles of
its question (its first line), and of its answer (the other lines, if any),
must be in the passage.

Words are runs of ASCII letters, digits and bytes beyond ASCII, lower-cased.
The index is broadcast; it is bounded by `MAX_ITEMS` and `MAX_BYTES`, which are
checked before the items are read.

Defined results: null text and text without words match nothing; items without
words or id match nothing; a part with fewer than five words is one shingle;
items of equal text are all reported; repeated documents are each judged;
without items all documents are clean; an empty table gives an empty one; other
columns, whatever their names, are kept by `drop_contaminated`.  A text of any
length is searched in steps; its words' hashes are held together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import _LOWER, batches, kept_rows, mix64, run_hashes, runs, small_batches
from textmesh.llm.substring import window_hashes

K1, B = 1.2, 0.75
#: Share of an item's score for itself that a passage must reach.
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
#: Impact that an item's terms outside its essential ones stay under.
REST = 0.2
MAX_ITEMS, MAX_BYTES = 100_000, 64 << 20
#: Postings, or cells of a table of passages and blocks, that a step takes.
STEP = 1 << 21

_IN = np.zeros(256, bool)
_IN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = np.where(_IN, _LOWER.astype(np.uint64) + np.uint64(1), np.uint64(0))
_BASE = np.uint64(0xD1B54A32D192ED03)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word, in order."""
    start, end, doc = runs(_IN[buf], off)
    return doc, mix64(run_hashes(_VALUE, buf, start, end, _BASE, _INV))


def _one(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return terms(raw, np.array([0, len(raw)]))[1]


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(h, min(size, len(h))))


def _slices(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the slices start[x]:start[x + 1] for x in of, and which of
    them each is of."""
    n = start[of + 1] - start[of]
    which = np.repeat(np.arange(len(of)), n)
    return np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum()), which


class Class:
    """Items of one class of length.  term, item, weight: impacts, by item;
    rarity: of each term, its items in the whole index; first: the class's
    first item; terms: the size of the vocabulary."""

    def __init__(self, term, item, weight, rarity, first: int, items: int, segment: int, block: int, terms: int, threshold: float):
        self.first, self.segment, self.block, self.items, self.threshold = first, segment, block, items, threshold
        self.known, local = np.unique(term, return_inverse=True)
        self.of = np.full(terms, -1, np.int32)
        self.of[self.known] = np.arange(len(self.known))
        item = item - first
        # what each item has: by item, the rarest terms first
        order = np.lexsort((local, rarity[term], item))
        self.term, item, self.weight = local[order], item[order], weight[order]
        self.start = np.searchsorted(item, np.arange(items + 1))
        upto = np.cumsum(self.weight)
        before = upto - self.weight - np.concatenate(([0.0], upto))[self.start][item]
        essential = 1 - before >= min(REST, threshold / 2)
        self.top = np.zeros(len(self.known))
        np.maximum.at(self.top, self.term, self.weight)
        # what the essential terms lead to: by term, blocks and their maxima
        self.blocks = -(-items // block)
        cell, where = np.unique(self.term[essential] * self.blocks + item[essential] // block, return_inverse=True)
        self.maximum = np.zeros(len(cell))
        np.maximum.at(self.maximum, where, self.weight[essential])
        self.leads = cell % self.blocks
        self.leads_at = np.searchsorted(cell // self.blocks, np.arange(len(self.known) + 1))

    def search(self, doc: np.ndarray, first: np.ndarray, at: np.ndarray, term: np.ndarray, seen: list):
        """(document, item, impact, first word, end word) of all passages and
        items at the threshold; words at have terms of the index, first: the
        first word of each document.  seen: counts the items scored."""
        local = self.of[term]
        hit = np.flatnonzero(local >= 0)
        at, local, size = at[hit], local[hit].astype(np.int64), self.segment
        if not len(at):
            return
        n_seg = -(-np.diff(first) // size)
        seg_at = np.concatenate(([0], np.cumsum(n_seg)))
        d = doc[at]
        seg = seg_at[d] + (at - first[d]) // size
        # a segment's terms belong to its passage and to the one before
        v = len(self.known)
        own = np.unique(seg * v + local)
        s = own // v
        pair = np.union1d(own, own[s > seg_at[np.searchsorted(seg_at, s, side="right") - 1]] - v)
        p, t = pair // v, pair % v
        begin = np.flatnonzero(np.diff(p, prepend=-1))
        enough = np.add.reduceat(self.top[t], begin) >= self.threshold - 1e-6
        keep = np.repeat(enough, np.diff(np.append(begin, len(p))))
        p, t = p[keep], t[keep]
        if not len(p):
            return
        names, p = np.unique(p, return_inverse=True)
        # passages in steps of bounded numbers of postings and cells
        work = np.cumsum(np.bincount(p, self.leads_at[t + 1] - self.leads_at[t], minlength=len(names)))
        lo = 0
        while lo < len(names):
            hi = int(np.searchsorted(work, (work[lo - 1] if lo else 0) + STEP, side="right"))
            hi = min(max(hi, lo + 1), lo + max(1, STEP // self.blocks))
            a, b = np.searchsorted(p, (lo, hi))
            yield from self._open(names[lo:hi], p[a:b] - lo, t[a:b], first, seg_at, seen)
            lo = hi

    def _open(self, names, p, t, first, seg_at, seen):
        place, which = _slices(self.leads_at, t)
        cell = p[which] * self.blocks + self.leads[place]
        least = self.threshold - min(REST, self.threshold / 2) - 1e-6
        cells = len(names) * self.blocks
        if 8 * len(cell) > cells:
            opened = np.flatnonzero(np.bincount(cell, self.maximum[place], minlength=cells) >= least)
        else:
            cell, where = np.unique(cell, return_inverse=True)
            opened = cell[np.bincount(where, self.maximum[place], minlength=len(cell)) >= least]
        if not len(opened):
            return
        v, key = len(self.known), p * len(self.known) + t
        for lo in range(0, len(opened), 1 << 14):
            part = opened[lo : lo + (1 << 14)]
            g = np.repeat(part // self.blocks, self.block)
            item = (np.repeat(part % self.blocks * self.block, self.block).reshape(-1, self.block) + np.arange(self.block)).ravel()
            g, item = g[item < self.items], item[item < self.items]
            seen[0] += len(item)
            place, which = _slices(self.start, item)
            wanted = g[which] * v + self.term[place]
            found = key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted
            score = np.bincount(which, np.where(found, self.weight[place], 0.0), minlength=len(item))
            good = np.flatnonzero(score >= self.threshold - 1e-9)
            if len(good):
                name = names[g[good]]
                d = np.searchsorted(seg_at, name, side="right") - 1
                begin = first[d] + (name - seg_at[d]) * self.segment
                yield d, item[good] + self.first, score[good], begin, np.minimum(begin + 2 * self.segment, first[d + 1])


class Index:
    """Impacts of the items' terms, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, block: int = BLOCK):
        items = [(i, t, w) for i, t in items if len(w := _one(t or ""))]
        items.sort(key=lambda x: (len(x[2]), x[0]))
        self.ids = np.array([i for i, _, _ in items], np.int64)
        self.threshold, self.scored = threshold, [0]
        lengths = np.array([len(w) for _, _, w in items], np.int64)
        n = max(1, len(items))
        item = np.repeat(np.arange(len(items)), lengths)
        self.terms, at = np.unique(np.concatenate([w for *_, w in items]) if items else np.zeros(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(item * max(1, len(self.terms)) + at, return_counts=True)
        item, term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((len(items) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if items else 1, 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[item])
        weight /= np.bincount(item, weight, minlength=n)[item]
        self.classes, lo = [], 0
        while lo < len(items):
            hi = int(np.searchsorted(lengths, 1 << int(lengths[lo] - 1).bit_length(), side="right"))
            a, b = np.searchsorted(item, (lo, hi))
            self.classes.append(Class(term[a:b], item[a:b], weight[a:b], df, lo, hi - lo, int(lengths[hi - 1]), block, len(self.terms), threshold))
            lo = hi
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        parts = [((t or "").strip().split("\n", 1) + [""])[:2] for _, t, _ in items]
        self.question = [shingles(_one(q)) for q, _ in parts]
        self.answer = [shingles(_one(a)) for _, a in parts]
        self.sizes = [(min(SHINGLE, max(1, len(_one(q)))), min(SHINGLE, max(1, len(_one(a))))) for q, a in parts]

    def search(self, doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, impact, first word, end word) of all passages and
        items at the threshold or above; words count over the whole batch."""
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64))
        if not len(h) or not len(self.terms):
            return none
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        hit = np.flatnonzero(self.sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[hit]), len(self.terms) - 1)
        ok = self.terms[at] == h[hit]
        hit, at = hit[ok], at[ok]
        out = [none, *(x for c in self.classes for x in c.search(doc, first, hit, at, self.scored))]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def verified(self, h: np.ndarray, item: int, overlap: float) -> bool:
        """Question and answer are in the words h of a passage."""
        for part, size in zip((self.question[item], self.answer[item]), self.sizes[item], strict=True):
            if len(part) and (len(h) < size or np.isin(part, window_hashes(h, size)).mean() < overlap):
                return False
        return True


def build(benchmark: DataFrame, threshold: float = THRESHOLD) -> Index:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > MAX_ITEMS or size > MAX_BYTES:
        raise ValueError(f"{n} items of {size} bytes are more than {MAX_ITEMS} or {MAX_BYTES}: give them in parts")
    return Index([(r.item_id, r.text) for r in items.collect()], threshold)


def _matches(index: Index, buf: np.ndarray, off: np.ndarray, overlap: float):
    """For each document its verified (items, largest score)."""
    doc, h = terms(buf, off)
    out = [({}, 0.0) for _ in range(len(off) - 1)]
    for d, i, score, a, b in zip(*(x.tolist() for x in index.search(doc, h, len(off) - 1)), strict=True):
        if (score > out[d][1] or int(index.ids[i]) not in out[d][0]) and index.verified(h[a:b], i, overlap):
            out[d][0][int(index.ids[i])] = True
            out[d] = (out[d][0], max(score, out[d][1]))
    return out


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and score, the largest share
    of a verified item's own score, of every row."""
    index = docs.sparkSession.sparkContext.broadcast(build(benchmark, threshold))

    def run(it):
        for batch, buf, off in batches(it):
            got = _matches(index.value, buf, off, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bool(i) for i, _ in got]), pa.array([sorted(i) for i, _ in got], pa.list_(pa.int64())), pa.array([round(s, 6) for _, s in got], pa.float64())],
                names=["doc_id", "contaminated", "item_ids", "score"],
            )

    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, contaminated boolean, item_ids array<long>, score double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without the rows that hold a verified item."""
    index = docs.sparkSession.sparkContext.broadcast(build(benchmark, threshold))
    return kept_rows(docs, lambda buf, off: [not i for i, _ in _matches(index.value, buf, off, overlap)])


def op3_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


