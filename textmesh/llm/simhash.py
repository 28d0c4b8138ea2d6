"""SimHash near-duplicates by multi-index hashing.

Fingerprints of equal value are one entry.  The 64 bits are cut into segments;
two fingerprints that differ in at most `distance` bits agree, in at least one
segment, up to that segment's radius (the radii add up to distance - segments
+ 1).  Every fingerprint is entered in the table of each segment under its
value and probes the values of a small Hamming ball around it; the rows of one
table key meet in one place, and complete distances are verified there.

The number of segments, two or three, is what makes the expected work least
for the number of distinct fingerprints; both find every link.

A key with many fingerprints gives the links of a spanning forest, not all
pairs.  A key with more than `HOT` table entries is dealt over several tasks:
its entries are salted, and its probes go to every salt.

Defined results: null and empty texts have fingerprint zero and link like any
other; copies share one fingerprint; a null doc_id is never a component id
unless its component has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import LOWER_TABLE, batches, checkpoint, column, components, mix64, partitions, small_batches, unused, word_hashes, words
from textmesh.llm.substring import window_hashes

SHINGLE = 4
DISTANCE = 4
#: Table entries of one key that a task verifies at once.
HOT = 50_000
#: Rows of one key that a task holds before it lets verified probes go.
PROBES = 500_000
#: Groups with more table entries than this give a spanning forest.
DENSE = 16
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprints_of(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of every text of a batch, as uint64."""
    n_docs = len(off) - 1
    starts, ends, doc = words(buf, off)
    out = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return out
    data = buf.tobytes().translate(LOWER_TABLE)
    size = ends - starts
    text = b" ".join(data.translate(_TO_SPACE).split()) if len(off) == 2 else b" ".join([w for i in range(n_docs) for w in data[off[i] : off[i + 1]].split()])
    end = np.cumsum(size + 1) - 1
    start = end - size
    # a shingle begins at every word with shingle - 1 more words in its document, or at the only word of a short one
    last = np.searchsorted(doc, np.arange(n_docs), side="right")
    first = np.searchsorted(doc, np.arange(n_docs), side="left")
    count = np.where(last > first, np.maximum(last - first - shingle + 1, 1), 0)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    upto = np.minimum(at + shingle, np.repeat(last, count)) - 1
    digest, h = xxhash.xxh64_intdigest, np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 16):  # few Python objects at a time
        part = slice(lo, lo + (1 << 16))
        h[part] = [digest(text[a:b], 42) for a, b in zip(start[at[part]].tolist(), end[upto[part]].tolist(), strict=True)]
    cuts = np.concatenate(([0], np.cumsum(count)))
    some = np.flatnonzero(count)
    for lo in range(0, len(some), 64):  # a few documents at a time: 64 bytes for each shingle
        part = some[lo : lo + 64]
        a, b = cuts[part[0]], cuts[part[-1] + 1]
        if b - a > 1 << 20:
            sums = np.array([_bit_sums(h[cuts[i] : cuts[i + 1]]) for i in part])
        else:
            bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, cuts[part] - a, axis=0, dtype=np.int32)
        major = 2 * sums > count[part][:, None]
        out[part] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _bit_sums(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 18):
        total += np.unpackbits(h[lo : lo + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(it):
        for batch, buf, off in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(buf, off, shingle).view(np.int64))], names=["doc_id", "fp"])

    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, fp long")


def plan_segments(n: int, distance: int, counts: tuple[int, ...] = (2, 3)) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment, for n distinct fingerprints; of
    the numbers of segments the one with the least expected work."""

    def cut(m: int) -> list[tuple[int, int, int]]:
        bits = [64 // m + (i < 64 % m) for i in range(m)]
        left = max(0, distance - m + 1)
        radii = [left // m + (i < left % m) for i in range(m)]
        return [(sum(bits[:i]), bits[i], radii[i]) for i in range(m)]

    def ball(bits: int, r: int) -> int:
        total, term = 1, 1
        for k in range(1, r + 1):
            term = term * (bits - k + 1) // k
            total += term
        return total

    options = [cut(m) for m in counts]
    return min(options, key=lambda s: sum(ball(b, r) * (1 + n / 2**b) for _, b, r in s))


def _masks(bits: int, radius: int) -> list[int]:
    out, ring = [], {0}
    for _ in range(radius):
        ring = {x | 1 << b for x in ring for b in range(bits) if not x >> b & 1}
        out += sorted(ring)
    return out


def _rows(segments) -> Column:
    """The table entry (probe 0) and the probes (probe 1) of column fp."""
    made = []
    for i, (shift, bits, radius) in enumerate(segments):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << 40))
        made.append(F.array(F.struct(value.alias("key"), F.lit(0).alias("probe"))))
        if masks := _masks(bits, radius):
            balls = F.array(*(F.lit(m).cast("long") for m in masks))
            made.append(F.transform(balls, _probe(value)))
    return F.inline(F.concat(*made))


def _probe(value: Column):
    """A function of one argument, as a second one would be the index."""
    return lambda mask: F.struct(value.bitwiseXOR(mask).alias("key"), F.lit(1).alias("probe"))


def _forest(table: np.ndarray, probes: np.ndarray, distance: int) -> tuple[list, list]:
    """Spanning edges of the links inside `table` and between it and `probes`."""
    a, b = [], []
    while len(table):
        stack, table = [(table[0], True)], table[1:]
        while stack:
            x, inside = stack.pop()
            near = np.bitwise_count(table ^ x) <= distance
            if near.any():
                got, table = table[near], table[~near]
                a += [np.full(len(got), x)]
                b += [got]
                stack += [(y, True) for y in got]
            if inside and len(probes):
                near = np.bitwise_count(probes ^ x) <= distance
                if near.any():
                    got, probes = probes[near], probes[~near]
                    a += [np.full(len(got), x)]
                    b += [got]
                    stack += [(y, False) for y in got]
    return a, b


def links_of(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of equal keys; rows are sorted by key, probe."""
    fp = fp.view(np.uint64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    in_table = np.add.reduceat((probe == 0).astype(np.int64), begin)
    a, b = [], []
    for g in np.flatnonzero(in_table > DENSE):
        part, t = fp[begin[g] : begin[g] + size[g]], in_table[g]
        x, y = _forest(part[:t], part[t:], distance)
        a += x
        b += y
    small = np.flatnonzero((in_table > 0) & (in_table <= DENSE) & (size > 1))
    if len(small):
        # row i of a group's table meets the rows after it
        each = np.minimum(in_table[small], size[small] - 1)
        row = np.repeat(begin[small] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        left = np.repeat(begin[small] + size[small], each) - row - 1
        step = 1 << 21
        cuts = np.searchsorted(np.cumsum(left), np.arange(step, left.sum() + step, step))
        lo = 0
        for hi in [*(cuts + 1).tolist(), len(row)]:
            r, n = row[lo:hi], left[lo:hi]
            lo = max(lo, hi)
            if not len(r):
                continue
            i = np.repeat(r, n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
            a.append(fp[i[near]])
            b.append(fp[j[near]])
    if not a:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _verify(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        held = [np.zeros(0, np.int64) for _ in range(3)]

        def edges(part):
            if len(part[0]):
                a, b = links_of(*part, distance)
                differ = a != b
                lo, hi = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
                if len(lo):
                    o = np.lexsort((hi, lo))
                    lo, hi = lo[o], hi[o]
                    first = np.ones(len(lo), bool)
                    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(lo[first]), pa.array(hi[first])], schema=schema)

        for batch in it:
            got = [batch.column(i).to_numpy() for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, got, strict=True)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                yield from edges([x[:cut] for x in held])
                held = [x[cut:] for x in held]
                if len(held[0]) > PROBES:  # one key's probes meet its table part by part
                    yield from edges(held)
                    held = [x[held[1] == 0] for x in held]
        yield from edges(held)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT, counts: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Links (a, b), a < b, that connect what the links of `distance` bits
    between the distinct values of fps.fp connect.  A link may come from
    several keys; groups of a key give a spanning forest of theirs."""
    n = partitions(fps.sparkSession)
    segments = plan_segments(fps.count(), distance, counts)
    rows = fps.select("fp", _rows(segments))
    crowded = rows.where("probe = 0").groupBy("key").count().where(F.col("count") > hot)
    crowded = checkpoint(crowded.select("key", F.ceil(F.col("count") / hot).cast("int").alias("salts")))
    if not crowded.isEmpty():
        rows = rows.join(crowded, "key", "left")
        own = F.when(F.col("probe") == 0, F.pmod(F.xxhash64("fp"), "salts").cast("int")).otherwise(-1)
        rows = rows.withColumn("own", own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        rows = rows.select("fp", (F.col("key") * (1 << 20) + F.col("salt")).alias("key"), F.when(F.col("salts").isNull() | (F.col("own") == F.col("salt")), F.col("probe")).otherwise(1).alias("probe"))
    dealt = rows.select("key", "probe", "fp").repartition(n, "key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id that links reach, for every row of docs."""
    each = checkpoint(fingerprints(docs, shingle))
    low = each.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = components(links(low.select("fp"), distance))
    group = low.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = checkpoint(group.groupBy("root").agg(F.min("low").alias("component_id")))  # so that the join can split a large component
    ids = group.join(least, "root").select("fp", "component_id")
    return each.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates whose five-word shingles agree: fingerprints and MinHash bands propose, the sets decide.

#: Bits in which the fingerprints of two texts to compare may differ; the least Jaccard similarity.
PROPOSE, SIMILARITY = 7, 0.8
#: Bands of MinHash values, and values in a band: a pair of similarity s agrees in none with probability
#: (1 - s**ROWS)**BANDS, 3e-6 at 0.8.
BANDS, ROWS = 32, 5
#: Texts of a crowded band that a task compares at once.
TOGETHER = 1000
_mixed = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _mixed[: BANDS * ROWS], _mixed[BANDS * ROWS :] | np.uint64(1)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _shingled(h: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles; a shorter text is one."""
    own = doc[: max(0, len(h) - size + 1)] == doc[size - 1 :] if len(h) >= size else np.zeros(0, bool)
    at = np.flatnonzero(own)
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < size))
    first = np.searchsorted(doc, short)
    whole = np.array([window_hashes(h[a : a + c], c)[0] for a, c in zip(first.tolist(), count[short].tolist(), strict=True)], np.uint64)
    return _distinct(np.concatenate((doc[at], short)), np.concatenate((window_hashes(h, size)[at], whole)))


def _bands(d: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """A key for each of n texts and each band, from the distinct shingles;
    the texts without words have the same ones."""
    out = np.zeros((n, BANDS), np.uint64)
    some, first = np.unique(d, return_index=True)
    if len(some):
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for i in range(band * ROWS, band * ROWS + ROWS):
                key = mix64(key ^ np.minimum.reduceat((s ^ _XOR[i]) * _TIMES[i], first))
            out[some, band] = key
    return out.view(np.int64)


def _profile(shingle: int):
    """(doc_id, copy, fp, bands) of every row: the SimHash of the distinct
    word pairs and the keys of the bands of the distinct shingles."""

    def run(it):
        for batch, buf, off in batches(it):
            n = batch.num_rows
            starts, ends, doc = words(buf, off)
            h = word_hashes(buf, starts, ends, lower=True)
            d, pair = _shingled(h, doc, n, 2)
            cut = np.searchsorted(d, np.arange(n + 1))
            fp = np.zeros(n, np.uint64)
            for i in range(n):
                if cut[i + 1] > cut[i]:
                    major = 2 * _bit_sums(pair[cut[i] : cut[i + 1]]) > cut[i + 1] - cut[i]
                    fp[i] = np.packbits(major, bitorder="little").view(np.uint64)[0]
            keys = _bands(*_shingled(h, doc, n, shingle), n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64)), lists], names=["doc_id", "copy", "fp", "bands"])

    return run


def _sets(shingle: int):
    """(id, shingles): the sorted hashes of the distinct shingles of a text."""

    def run(it):
        for batch, buf, off in batches(it):
            n = batch.num_rows
            starts, ends, doc = words(buf, off)
            d, s = _shingled(word_hashes(buf, starts, ends, lower=True), doc, n, shingle)
            cut = np.searchsorted(d, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    return run


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes; both empty: 1."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _similar(least: float):
    def run(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                keep.append(min(len(x), len(y)) >= least * max(len(x), len(y)) and similarity(x, y) >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def similar_groups(roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what similar pairs connect, given texts that are
    connected already if their roots are equal: each pair is compared unless
    it is connected by then."""
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner, start = np.repeat(np.arange(len(sets)), size), np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    roots, out = roots.copy(), []
    for i in range(len(sets)):
        if (roots[i + 1 :] == roots[i]).all():
            continue
        mine = flat[start[i] : start[i + 1]]
        marked[mine] = True
        both = np.bincount(owner[start[i] :][marked[flat[start[i] :]]], minlength=len(sets))[i + 1 :]
        marked[mine] = False
        union = size[i] + size[i + 1 :] - both
        near = ((both >= least * union) & (roots[i + 1 :] != roots[i])).nonzero()[0] + i + 1
        for j in near.tolist():
            if roots[j] != roots[i]:
                out.append((i, j))
                roots[roots == roots[j]] = roots[i]
    return out


def _crowd(least: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        found = similar_groups(table["root"].to_numpy(), [np.frombuffer(x.as_py(), "<u8") for x in table["shingles"]], least)
        a, b = (ids[np.array([p[k] for p in found], np.int64)] for k in range(2))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_texts(texts: DataFrame, read, least: float, distance: int) -> DataFrame:
    """(node, root) of the groups of texts (id, fp, bands) that similar pairs
    connect; read gives (id, shingles) of a table of ids.

    All pairs of a band's small groups are compared.  In a crowded one all
    texts meet the first; where that leaves several groups, the texts come
    together and all pairs of theirs that aren't connected are compared."""
    entries = texts.select("id", F.explode(F.array_distinct("bands")).alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    member = checkpoint(entries.join(shared, "key"))
    few, many = member.where(F.col("n") <= DENSE).select("key", "id"), member.where(F.col("n") > DENSE)
    small = few.withColumnRenamed("id", "x").join(few.withColumnRenamed("id", "y"), "key").where("x < y").select("x", "y")
    stars = many.where("id <> lead").select(F.col("lead").alias("x"), F.col("id").alias("y"))
    lead = texts.groupBy("fp").agg(F.min("id").alias("lead"))
    pairs = links(lead.select("fp"), distance, counts=(2, 3, 4)).distinct()
    far = pairs.join(lead.withColumnsRenamed({"fp": "a", "lead": "x"}), "a").join(lead.withColumnsRenamed({"fp": "b", "lead": "y"}), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    same = texts.select("fp", F.col("id").alias("y")).join(lead, "fp").where("lead <> y").select(F.col("lead").alias("x"), "y")
    proposed = checkpoint(small.unionByName(stars).unionByName(far).unionByName(same).distinct())
    held = checkpoint(read(proposed.select(F.col("x").alias("id")).union(proposed.select("y")).distinct()))
    sides = proposed.join(held.withColumnsRenamed({"id": "x", "shingles": "sx"}), "x").join(held.withColumnsRenamed({"id": "y", "shingles": "sy"}), "y")
    found = checkpoint(sides.select(F.col("x").alias("a"), F.col("y").alias("b"), "sx", "sy").mapInArrow(_similar(least), "a long, b long"))
    groups = components(found)
    crowd = many.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "n", "id", F.coalesce("root", "id").alias("root"))
    crowd = checkpoint(crowd)
    open_ = crowd.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id") % 1000003).alias("y")).where("r0 <> r1")
    once = checkpoint(open_.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"))  # keys of the same texts are one
    if once.isEmpty():
        return groups
    parts = F.ceil(F.col("n") / TOGETHER).cast("int")
    dealt = crowd.join(once, "key").withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "root").join(held, "id")
    more = dealt.groupBy("key", "lo", "hi").applyInArrow(_crowd(least), "a long, b long")
    return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY, distance: int = PROPOSE) -> DataFrame:
    """docs with one document of each group of near-duplicates, that with the
    smallest doc_id.

    Equal texts are one entry.  Bands of MinHash values of the distinct
    shingles, lower-cased, and SimHash fingerprints of the distinct word pairs
    propose pairs of texts; a pair is a link if the Jaccard similarity of the
    whole sets of shingles is `least` or more.  Groups are the components of
    the links.  Rows that repeat the doc_id of the kept document stay with it;
    null text counts as empty, and texts without words are one group; a row
    without doc_id stays only if its group has no doc_id.
    """
    copy = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy"), F.col("text").cast("string").alias("text"))
    each = base.mapInArrow(_profile(shingle), "doc_id long, copy string, fp long, bands array<long>")
    texts = checkpoint(each.groupBy("copy").agg(F.min("doc_id").alias("low"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    texts = texts.withColumn("id", F.monotonically_increasing_id())

    def read(ids: DataFrame) -> DataFrame:
        wanted = texts.select("id", "copy").join(ids, "id")
        one = wanted.join(base.select("copy", "text"), "copy").groupBy("id").agg(F.min("text").alias("text"))
        return one.mapInArrow(_sets(shingle), "id long, shingles binary")

    groups = similar_texts(texts, read, least, distance).withColumnRenamed("node", "id")
    member = texts.select("id", "copy", "low", "n").join(groups, "id", "left").select("copy", "low", "n", F.coalesce("root", "id").alias("root"))
    kept = member.groupBy("root").agg(F.min("low").alias("kept"), F.sum("n").alias("size")).where("size > 1")
    own, stays, grouped = unused(docs, "copy", "kept", "grouped")
    decided = checkpoint(member.join(checkpoint(kept), "root").select(F.col("copy").alias(own), F.col("kept").alias(stays), F.lit(True).alias(grouped)))
    j = docs.withColumn(own, copy).join(decided, own, "left")
    return j.where(F.col(grouped).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(stays))).select(*(column(c) for c in docs.columns))


def op9_simhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
