"""Shared helpers."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textmesh.llm import common as C
from textmesh.llm.substring import window_hashes


def test_hash_is_sparks(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, *range(50)]
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i").alias("h")).collect()]
    assert C.spark_hash(np.array(ids, np.int64)).view(np.int64).tolist() == got


def test_words_and_hashes():
    texts = ["", None, " a  bb\n", "x\x0by z", "", "A a", "  "]
    buf, off = C.utf8(pa.array(texts))
    raw = [(t or "").encode() for t in texts]
    start, end, doc = C.words(buf, off)
    got = [(int(d), buf[a:b].tobytes()) for a, b, d in zip(start, end, doc, strict=True)]
    assert got == [(i, w) for i, r in enumerate(raw) for w in r.split()]
    h = C.word_hashes(buf, start, end)
    by = {}
    for (_, w), x in zip(got, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    low = C.word_hashes(buf, start, end, lower=True)
    assert low[[w for _, w in got].index(b"A")] == h[[w for _, w in got].index(b"a")]


def test_sliced_columns_and_chunks():
    col = pa.array(["aa", None, "b b", "c" * 50, ""]).slice(1)
    buf, off = C.utf8(col)
    assert buf.tobytes() == b"b b" + b"c" * 50 and off.tolist() == [0, 0, 3, 53, 53]
    assert [*C.chunks(off, 4)] == [(0, 2), (2, 4)] or [*C.chunks(off, 4)][0][0] == 0
    assert C.utf8(pa.array([], pa.string()))[1].tolist() == [0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), col], names=["doc_id", "text"])
    parts = [(b.column(0).to_pylist(), x.tobytes()) for b, x, _ in C.batches([batch], 4)]
    assert [i for ids, _ in parts for i in ids] == [0, 1, 2, 3] and b"".join(x for _, x in parts) == buf.tobytes()


def test_planes():
    a = np.array([0, 1, 2**40, 2**63], np.uint64)
    assert C.unplanes(C.planes(a), np.uint64, 4).tolist() == a.tolist()


def test_windows():
    r = random.Random(4)
    h = np.array([r.choice([3, 5, 7]) for _ in range(400)], np.uint64)
    for k in (1, 2, 9):
        got = window_hashes(C.mix64(h), k).tolist()
        seen = {}
        for i, x in enumerate(got):
            assert seen.setdefault(tuple(h[i : i + k].tolist()), x) == x
        assert len(set(got)) == len(seen)
    assert len(window_hashes(h[:3], 5)) == 0


def test_session_settings(spark):
    df = spark.range(1)
    assert C.small_batches(df) is df
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b") == str(C.BATCH_BYTES)
    assert C.buckets_for(spark, 1, 2) == 4 and C.checkpoint(df).count() == 1


def test_hashes_in_steps(monkeypatch):
    r = random.Random(5)
    raw = bytes(r.choice(b"ab  \ncdefgh") for _ in range(500)) + b"x" * 200 + b" end"
    buf, off = np.frombuffer(raw, np.uint8), np.array([0, 100, 100, 350, len(raw)])
    start, end, _ = C.words(buf, off)
    want, codes = C.word_hashes(buf, start, end, lower=True), C.run_hashes(None, buf.astype(np.uint32), start, end, C._BASE, C._BASE_INV)
    for step in (1, 7, 64, 10_000):
        monkeypatch.setattr(C, "CHUNK_BYTES", step)
        assert (C.word_hashes(buf, start, end, lower=True) == want).all()
        assert (C.run_hashes(None, buf.astype(np.uint32), start, end, C._BASE, C._BASE_INV) == codes).all()
    words = [raw[a:b] for a, b in zip(start, end, strict=True)]
    assert len(set(want.tolist())) == len(set(words))


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "key int, key_ int, Copy int")
    assert C.unused(df, "key", "copy", "other", "other") == ["key__", "copy_", "other", "other_"]


def test_components_together_and_in_rounds(spark):
    r = random.Random(6)
    far = [(-(2**63), 2**63 - 1), (5, 5), (7, 7)]
    edges = [*far, *((i, i + 1) for i in range(100, 220)), *((r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)), *((2000, i) for i in range(1950, 2050))]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    a, b = np.array([e for e in edges if e[0] != e[1]], np.int64).T
    assert dict(zip(*(x.tolist() for x in C.joined(a, b)), strict=True)) == root
    df = spark.createDataFrame(edges, "a long, b long")
    for together in (0, C.EDGES):
        assert sorted((x.node, x.root) for x in C.components(df, together).collect()) == sorted(root.items())


def test_components_of_few_edges_take_few_jobs(spark):
    sc = spark.sparkContext
    sc.setJobGroup("few", "few edges")
    try:
        C.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
        assert len(sc.statusTracker().getJobIdsForGroup("few")) <= 8
    finally:
        sc.setJobGroup("", "")
