"""PPM scores against a plain recursive model over all contexts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textmesh.llm import ppm
from textmesh.llm.ppm import END, START, held_out_fold, score_documents


def plain_model(texts, order, rare):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    n = 0
    for t in texts:
        s = [START] * order + list(t) + [END]
        for i in range(order, len(s)):
            n += 1
            for k in range(order + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1
    least = max(1, -(-n // rare))
    return [{c: v for c, v in level.items() if not k or sum(v.values()) >= least} for k, level in enumerate(counts)]


def plain_score(model, order, text):
    s = [START] * order + list(text) + [END]
    total = 0.0
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = model[k].get(tuple(s[i - k : i]))
            if not seen:
                continue
            left = {x: c for x, c in seen.items() if x not in excluded}
            if not left:
                continue
            n, d = sum(left.values()), len(left)
            if s[i] in left:
                p *= left[s[i]] / (n + d)
                break
            p *= d / (n + d)
            excluded |= set(seen)
        else:
            p /= 257 - len(excluded)
        total += math.log10(p)
    return total


ROWS = [
    (1, "the cat sat on the mat"), (2, None), (3, ""), (4, "the dog sat on the log " * 60), (5, "ünïcode tëxt ∂ x"), (5, "ünïcode tëxt ∂ x"),
    (None, "no id here"), (7, "zzz QQQ the"), (8, "a"), (9, " \t\n "), (10, "x" * 1500), (11, "The THE the"),
]


@pytest.mark.parametrize(("order", "rare"), [(2, 100_000), (3, 40), (0, 100), (5, 100_000)])
def test_matches_plain_model(spark, order, rare):
    df = spark.createDataFrame([(i, t, 0.0, 1) for i, t in ROWS], "doc_id long, text string, score double, rare int")
    got = score_documents(df, held_out_fold(), order, rare).collect()
    assert len(got) == len(ROWS)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learnt = [t or "" for i, t in ROWS if not out(i)]
    model = plain_model([t.encode() for t in learnt], order, rare)
    tokens = Counter()
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) + [None]
    for t in learnt:
        tokens.update(cut(t))
    n, v = sum(tokens.values()), len(tokens)
    want = sorted((str(i), out(i), len(cut(t or "")), sum(tokens[w] > 0 for w in cut(t or "")), n, round(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in cut(t or "")), 6)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    expect = {str(i): plain_score(model, order, (t or "").encode()) for i, t in ROWS}
    for r in got:
        assert r.score == pytest.approx(expect[str(r.doc_id)], rel=1e-5, abs=1e-4)


def test_rare_contexts_of_a_large_corpus_stay(spark):
    texts = {1: "ab" * 120_000, 3: "quiz", 4: "quit", 5: "quiz quit"}
    rows = list(texts.items())
    model = plain_model([t.encode() for t in texts.values()], 2, 10**9)
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), 2).collect()}
    for i in (3, 4, 5):
        assert got[i] == pytest.approx(plain_score(model, 2, texts[i].encode()), rel=1e-5)


def test_few_top_words_give_the_same(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    key = lambda r: (str(r.doc_id), r.n_known, round(r.base_score, 6))
    assert sorted(map(key, score_documents(df, held_out_fold(), 2, top=2).collect())) == sorted(map(key, score_documents(df, held_out_fold(), 2).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(df, held_out_fold()).collect() == []
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = score_documents(one, F.lit(True)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(-3 * math.log10(257), rel=1e-5)


def test_longer_contexts_help_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    total = [sum(r.score for r in score_documents(docs, held_out_fold(), k).collect() if r.held_out) for k in (0, 2)]
    assert total[1] > 0.8 * total[0]


def test_long_texts_in_parts():
    import random

    import numpy as np

    r = random.Random(4)
    for n in (0, 1, 9, 40, 41, 100):
        buf = np.array([r.randrange(256) for _ in range(n)], np.uint8)
        off = np.array([0, n])
        assert np.concatenate([*ppm.gram_parts(buf, off, 5, 10)]).tolist() == ppm.gram_codes(buf, off, 5).tolist()
