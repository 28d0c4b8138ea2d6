"""URL filter and revisit resolution: DataFrame operators against plain code."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textmesh.llm import url_lm, warc
from textmesh.llm.queries import ORACLE_SQL, QUERIES

BAD = [(None, None), (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.COM"), (6, "x://a.com/é?q#f"), (6, "x://a.com/é?q#f"), (7, "http://Example.com/en/x"), (8, "http://www.example.com/en/x"), (9, "http://example.net/es/" + "y" * 20000), (10, "http://notexample.com/en/?a"), (11, "http://a.net/fr/#x://b"), (12, "http://a.net?x")]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[n:]
    m = min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), path[:m]


def rule_of(host, path):
    best = None
    for verdict, rule in url_lm.RULES:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def brute(rows, order=url_lm.ORDER):
    texts = {}
    for _, u in rows:
        t = u or ""
        n, _, role, ok = texts.get(t, (0, None, None, None))
        hit = rule_of(*host_path(u))
        texts[t] = (n + 1, hit, 0 if not hit else 1 if hashlib.md5(t.encode()).hexdigest()[0] in "012" else 2, hit and hit[1] == "allow")
    counts = {ok: [defaultdict(Counter) for _ in range(order + 1)] for ok in (True, False)}
    pad = lambda t: "\u0002" * order + t + "\u0003"
    for t, (n, _, role, ok) in texts.items():
        if role == 2:
            s = pad(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[ok][k][s[i - k : i]][s[i]] += n

    def logp(model, s, i):
        p = 1 / url_lm.ALPHABET
        for k in range(order + 1):
            c = model[k].get(s[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                p = (c[s[i]] + d * p) / (n + d)
        return math.log(p)

    score = {}
    for t in texts:
        s = pad(t)
        span = range(order, len(s))
        score[t] = round(sum(logp(counts[True], s, i) - logp(counts[False], s, i) for i in span) / len(span), 6)
    hist = sorted((max(-4000, min(4000, math.floor(score[t] * 200))), ok) for t, (_, _, role, ok) in texts.items() if role == 1)
    yes, no = sum(ok for _, ok in hist), sum(not ok for _, ok in hist)
    cut, best = 0.0, -1
    if yes and no:
        for b in sorted({b for b, _ in hist}):
            gain = sum(ok for x, ok in hist if x >= b) / yes + sum(not ok for x, ok in hist if x < b) / no
            if gain > best + 1e-12:
                best, cut = gain, b / 200
    out = []
    for i, u in rows:
        hit = rule_of(*host_path(u))
        out.append((i, *host_path(u), hit and hit[0], hit[1] if hit else "allow" if score[u or ""] >= cut else "block", round(score[u or ""], 4)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 4)) for r in df.collect()), key=str)


def test_urls_with_edges(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    for rows in (BAD, pages + BAD[:6], BAD[:4]):
        df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in rows], "page_id long, url string, verdict string, score double")
        assert [x[:5] for x in got(url_lm.filter_urls(df))] == [x[:5] for x in brute(rows)]
    assert got(url_lm.filter_urls(spark.createDataFrame(pages, "page_id long, url string"))) == brute(pages)
    assert url_lm.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_filter_is_native(spark, sf_dir):
    plan = url_lm.op2_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


COLUMNS = "record_id long, kind string, uri string, time long, etag string, last_modified string, digest string, headers map<string,string>, payload string, outcome string"


def test_revisits(spark):
    h = {"content-type": "text/html", "etag": "1", "date": "a"}
    rows = [
        (1, "response", "http://A.com/x/", 10, '"a"', None, "d1", h, "one", "?"), (2, "response", "https://www.a.com/x#f", 20, 'W/"b"', "m", "d2", h, "two", "?"), (3, "response", "http://a.com/x", 20, '"b"', "m", "d2", h, "three", "?"),
        (10, "revisit", "http://a.com/x", 10, None, None, None, None, None, "?"), (11, "revisit", "http://a.com/x", 11, 'W/"a"', None, None, {"date": "b", "content-type": "no", "etag": "2"}, None, "?"),
        (12, "revisit", "http://a.com:80/x?utm_q=1", 20, None, None, "d9", None, None, "?"), (13, "revisit", "http://a.com/x", 99, '"b"', None, "d2", {}, None, "?"), (13, "revisit", "http://a.com/x", 99, '"b"', None, "d2", {}, None, "?"),
        (14, "revisit", None, 99, None, None, None, None, None, "?"), (15, "revisit", "http://a.com/x", None, None, None, None, None, None, "?"), (16, "revisit", "http://b.com/", 5, None, None, None, None, None, "?"),
        (17, "revisit", "http://a.com/x", 98, None, "other", None, None, None, "?"),
    ]
    out = sorted(((r.record_id, r.refers_to, r.outcome, r.headers, r.payload) for r in warc.resolve_revisits(spark.createDataFrame(rows, COLUMNS)).collect()), key=lambda x: x[0])
    assert [(a, b, c) for a, b, c, *_ in out] == [(10, None, "unresolved"), (11, 1, "resolved"), (12, 1, "mismatch"), (13, 3, "resolved"), (13, 3, "resolved"), (14, None, "unresolved"), (15, None, "unresolved"), (16, None, "unresolved"), (17, 3, "mismatch")]
    assert out[1][3:] == ({"content-type": "text/html", "etag": "2", "date": "b"}, "one") and out[3][3:] == (h, "three") and out[2][3:] == (None, None)
    assert warc.resolve_revisits(spark.createDataFrame([], COLUMNS)).collect() == []


def test_as_of_many_times(spark):
    right = [("u", t * 7 % 1000, t) for t in range(300)] + [("v", 5, 1)]
    left = [("u", t) for t in range(0, 1100, 3)] + [("v", 5), ("w", 1)]
    out = {(r.url, r.time): r.record_id for r in warc.as_of(spark.createDataFrame(left, "url string, time long"), spark.createDataFrame(right, "url string, time long, record_id long")).collect()}
    want = {(u, t): max(((a, r) for x, a, r in right if x == u and a < t), default=(0, None))[1] for u, t in left}
    assert out == want


@pytest.mark.parametrize("url", ["http://A.b/c/?z=1&a=2&utm_x=3#f", "//x", "", "HTTPS://www.x.y:443"])
def test_canonical(spark, url):
    r = spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first().c
    assert r == {"http://A.b/c/?z=1&a=2&utm_x=3#f": "a.b/c?a=2&z=1", "//x": "//x", "": "", "HTTPS://www.x.y:443": "x.y"}[url]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con, d = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = QUERIES[name](spark, d)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall())) and df.columns == want.columns
