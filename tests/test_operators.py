"""Spark operators, sources, streaming, and all queries against their SQL."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmesh import queries as Q
from textmesh.functions import as_units, is_empty, text_units
from textmesh.operators import events as ev
from textmesh.operators import scan as sc
from textmesh.plans import automaton
from textmesh.plans.matcher import MatcherBuilder
from textmesh.sources import files, generators


def matcher(*patterns):
    return MatcherBuilder().add_all(enumerate(patterns, 1)).build()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    got = Q.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    assert got
    if name in Q.ORACLE:
        con = duckdb.connect()
        for t in glob.glob(f"{sf_dir}/*.parquet"):
            con.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
        want = con.sql(Q.ORACLE[name])
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_nulls_empty_and_outer(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "é😀ab")], "id long, text string")
    m = matcher("ab")
    assert rows(sc.scan(df, m)) == [(3, 1, 0, 2), (4, 1, 3, 5)]
    assert rows(sc.scan(df, m, outer=True).select("id", "start").fillna(-1)) == [(1, -1), (2, -1), (3, 0), (4, 3)]
    assert rows(sc.counts(df, m)) == [(3, 1, 1), (4, 1, 1)]
    assert rows(sc.membership(df, m)) == [(1, []), (2, []), (3, [1]), (4, [1])]
    assert rows(sc.matched_text(df, matcher("[^a]b|é.")).select("id", "matched")) == [(4, "é�")]
    assert sc.scan(df.limit(0), m).count() == 0


def test_units_and_binary(spark):
    df = spark.createDataFrame([(1, [0xD800, 97]), (2, None), (3, [])], "id long, u array<int>")
    assert rows(sc.scan(df, matcher(".", "a"), "u")) == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 2, 1, 2)]
    df = spark.createDataFrame([(1, "ab".encode("utf-16-le")), (2, None)], "id long, b binary")
    assert rows(sc.scan(df, matcher("b"), "b")) == [(1, 1, 1, 2)]


def test_key_clash_is_told(spark):
    df = spark.createDataFrame([(1, "a")], "start long, text string")
    with pytest.raises(ValueError, match="start"):
        sc.scan(df, matcher("a"))


def test_plans_push_filters_and_columns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = plan(sc.scan(df, matcher("idiot[a-z]*"), keys=["doc_id", "lang"]).where("doc_id = 3").select("doc_id", "start"))
    assert "EqualTo(doc_id,3)" in got and "StringContains(text,idiot)" in got and "lang" not in got.split("ReadSchema")[1] and "Exchange" not in got


def test_small_batches_give_the_same(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    m = matcher(r"\bth", "e$", "[A-Z].*?".replace("?", "") + "x")
    want = rows(sc.scan(df, m))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(sc.scan(df.repartition(3, "turn"), m)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_digest(spark):
    events = [(1, 0, 3), (70, 5, 9), (1, 0, 3), (4294967295, 2**40, 2**40 + 1)]
    df = spark.createDataFrame(events, "pattern_id long, start long, end long")
    total = xor = squares = 0
    for e in events:
        h = int(ev.ordered_digest([e]), 16)
        r = e[0] % 64
        total, squares = (total + h) % 2**64, (squares + h * h) % 2**64
        xor ^= (h << r | h >> (64 - r)) % 2**64
    assert tuple(ev.digest(df).first()) == (4, f"multiset64:{total:016x}:{xor:016x}:{squares:016x}")
    assert ev.digest(df.repartition(3)).first() == ev.digest(df).first()
    assert tuple(ev.digest(df.limit(0)).first()) == (0, f"multiset64:{0:016x}:{0:016x}:{0:016x}")


def test_upper_median(spark):
    df = spark.createDataFrame([(1, 4.0), (1, 1.0), (1, 3.0), (1, 2.0), (2, 7.0)], "k long, v double")
    assert rows(ev.upper_median(df, "v", ["k"])) == [(1, 3.0), (2, 7.0)]
    assert rows(ev.upper_median(df, "v")) == [(3.0,)] and rows(ev.upper_median(df.limit(0), "v")) == [] and rows(ev.upper_median(df.limit(0), "v", ["k"])) == []
    r = random.Random(2)
    values = [(r.choice([None, 1, 2]), r.choice([None, *range(1000)])) for _ in range(40_000)] + [(3, 5)] * 20_000
    df = spark.createDataFrame(values, "k long, v long")
    want = {}
    for k in (None, 1, 2, 3):
        own = sorted(v for x, v in values if x == k and v is not None)
        want[k] = own[len(own) // 2]
    assert {x.k: x.median for x in ev.upper_median(df, "v", ["k"]).collect()} == want
    own = sorted(v for _, v in values if v is not None)
    assert ev.upper_median(df, "v").collect()[0].median == own[len(own) // 2]


def test_leftmost_longest(spark):
    df = spark.createDataFrame([(1, "aaaa")], "id long, text string")
    assert rows(ev.leftmost_longest(sc.scan(df, matcher("aa", "a{3}")), ["id"])) == [(1, 1, 0, 2), (1, 1, 2, 4), (1, 2, 0, 3)]
    r = random.Random(8)
    df = spark.createDataFrame([(r.choice([None, k]), "x", "".join(r.choice("ab ") for _ in range(r.randint(0, 60)))) for k in range(80)], "id long, part string, text string").dropDuplicates(["id"])
    m = matcher("[ab]+", "aa|aab", " ?b.")
    order = lambda df: sorted(map(str, rows_of(df)))
    want = []
    for row in df.collect():
        for i in (1, 2, 3):
            last = 0
            for _, a, b in (e for e in m.find(row.text) if e[0] == i):
                if a >= last:
                    want.append((row.id, row.part, i, a, b))
                    last = b
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert order(ev.leftmost_longest(sc.scan(df, m), ["id", "part"])) == sorted(map(str, want)) == order(sc.scan_leftmost(df, m))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pattern_files(spark, tmp_path):
    ok = tmp_path / "p.tsv"
    ok.write_bytes(b"3\ta|b\r\n1\t\"x\n")
    assert rows(files.read_patterns(spark, str(ok))) == [(0, 3, "a|b"), (1, 1, '"x')]
    for bad in ("1 a", "0\ta", "1\t", "1\ta\tb", "1\ta\n1\tb", "x\ta", ""):
        ok.write_text(bad)
        with pytest.raises(ValueError):
            files.read_patterns(spark, str(ok))
    ok.write_text("1\té")
    with pytest.raises(ValueError):
        files.read_patterns(spark, str(ok), ascii_only=True)


def test_other_sources(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text(" b.c \n\na\nb.c\nzz\n")
    assert rows(files.read_word_patterns(spark, str(p), 2)) == [(1, "a"), (2, r"b\.c")]
    with pytest.raises(ValueError):
        files.read_word_patterns(spark, str(p), 9)
    assert files.read_corpus(spark, str(p)).count() == 1
    assert files.expand_corpus("aé", 5) == "aéa" and len(files.expand_corpus("ab", 7)) == 7
    j = tmp_path / "f.jsonl"
    j.write_text('{"schema_version":1,"case_id":"x","compatibility_tier":"t","expectation":"matched","patterns":[{"pattern_id":1,"utf16":[97]}],"input_utf16":[97,55296]}\n')
    assert files.read_fixtures(spark, str(j)).first().input_utf16 == [97, 55296]
    good = j.read_text()
    for bad in (good.replace('"case_id":"x",', ""), good.replace("{", '{"other":1,', 1), good.replace("55296", "65536"), good.replace('"x"', "1"), "[]\n", "{\n", good.replace('"pattern_id":1,', "")):
        j.write_text(good + "\n" + bad)
        with pytest.raises(ValueError, match="line 3"):
            files.read_fixtures(spark, str(j))
    files.write_receipt(spark.createDataFrame([(1, "a")], "n long, s string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("make", [generators.literal_sparse, generators.literal_dense, generators.mixed_sparse, generators.word_assertions, generators.mixed_unfilterable])
def test_generators(make):
    patterns, text, want = make(40, 8000)
    assert MatcherBuilder().add_all(patterns).build().find(text) == sorted(want)


def test_patterns_from_dataframe(spark):
    df = spark.createDataFrame([(5, "A", True), (2, "[", False), (1, "a", False)], "pattern_id long, pattern string, case_insensitive boolean")
    b = MatcherBuilder().from_dataframe(df, on_reject="skip")
    assert b.build().find("a") == [(1, 0, 1), (5, 0, 1)]


def test_split_of_one_long_text(spark):
    df = spark.createDataFrame([(1, "xy" * 5000), (2, None), (3, "")], "id long, text string")
    m = matcher("xyx", "y$")
    assert rows(sc.scan_split(df, m, piece=777)) == rows(sc.scan(df, m))
    r = random.Random(4)
    texts = [(k, "".join(r.choice("ab\n é😀") for _ in range(r.randint(0, 300)))) for k in range(30)]
    df = spark.createDataFrame(texts, "id long, text string")
    for m in (matcher("a.{0,4}b", r"\ba", "^ab?", "b$", r"b\B", "."), matcher("[ab]+", "é")):
        want = rows(sc.scan(df, m))
        assert rows(sc.scan_split(df, m, piece=7)) == want
        assert rows(sc.scan_split(df.withColumn("text", F.encode("text", "UTF-16LE")), m, piece=7)) == want
        assert rows(sc.scan_split(df.withColumn("text", as_units(F.col("text"))), m, piece=7)) == want
    wide = df.withColumnsRenamed({"id": "lo"}).withColumn("units", F.lit(1))
    assert rows(sc.scan_split(wide, m, piece=7).drop("units")) == want


def test_unit_functions(spark):
    df = spark.createDataFrame([(1, "a😀é"), (2, ""), (3, None)], "id long, text string")
    assert rows(df.select("id", as_units(F.col("text")), text_units(F.col("text")), is_empty(F.col("text")))) == [(1, [97, 0xD83D, 0xDE00, 233], 4, False), (2, [], 0, True), (3, None, None, None)]


def test_counts_and_members_in_small_parts(spark, monkeypatch):
    r = random.Random(6)
    df = spark.createDataFrame([(k, "".join(r.choice("abc ") for _ in range(r.randint(0, 90)))) for k in range(40)], "id long, text string")
    m = matcher("a+", r"\bb", "c", "abcabcabc")
    want = Counter((x.id, x.pattern_id) for x in sc.scan(df, m).collect())
    for name, value in (("CHUNK", 20), ("MEET", 2)):
        monkeypatch.setattr(automaton, name, value)
    table = pa.array([x.text for x in df.orderBy("id").collect()])
    for cells in (1 << 22, 0):
        monkeypatch.setattr(sc, "CELLS", cells)
        got = sc._count_list(m, table).to_pylist()
        assert {(k, x["pattern_id"]): x["n"] for k, row in enumerate(got) for x in row} == want
    assert {(k, x) for k, row in enumerate(sc._member_list(m, table).to_pylist()) for x in row} == set(want)


def test_extents_and_events_by_step(spark, monkeypatch):
    r = random.Random(9)
    df = spark.createDataFrame([(k, r.choice([None, "", "ab \n" * 40, *["".join(r.choice("abc \n") for _ in range(r.randint(0, 90))) for _ in range(9)]])) for k in range(50)], "id long, text string")
    m = matcher(".+", r"[^\n]+", r"\bb.", "ab|abc a")
    for events, leftmost in ((sc.scan(df, m), False), (sc.scan_leftmost(df, m), True)):
        want = rows(events.groupBy("id", "pattern_id").agg(F.count("*"), F.sum(F.col("end") - F.col("start"))))
        assert rows(sc.extents(df, m, leftmost=leftmost)) == want
        table = pa.array([x.text for x in df.orderBy("id").collect()])
        for cells in (1 << 22, 0):
            monkeypatch.setattr(sc, "CELLS", cells)
            monkeypatch.setattr(sc, "STEP_UNITS", 100)
            monkeypatch.setattr(automaton, "CHUNK", 30)
            parts = list(sc._count_lists(m, table, True, sc._leftmost if leftmost else None))
            assert len(parts) > 5 and sum(map(len, parts)) == 50
            assert [(k, *x.values()) for k, row in enumerate(y for p in parts for y in p.to_pylist()) for x in row] == want
            monkeypatch.undo()


def test_a_batch_of_words_takes_little_memory():
    import tracemalloc

    m = matcher("[a-z]+")
    table = pa.array(["some words of a text " * 100] * 4000)  # 8.4 MB
    for run in (lambda: sc._count_lists(m, table, True, sc._leftmost), lambda: sc._event_lists(m, table, sc._leftmost), lambda: sc._event_lists(m, table)):
        tracemalloc.start()
        n = most = 0
        for part in run():
            n, most = n + len(part), max(most, len(part))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 4000 and most < 600 and peak < 200e6  # 432 MB where a batch's events were held together


def test_choice_from_the_left(monkeypatch):
    r = random.Random(3)
    for few in (0, 3, 64):
        monkeypatch.setattr(sc, "FEW", few)
        for _ in range(60):
            events = sorted({(r.randint(0, 3), r.randint(0, r.choice([20, 900]))) for _ in range(r.randint(0, 900))})
            events = [(g, a, a + r.randint(1, r.choice([3, 30]))) for g, a in events]
            want, last = [], {}
            for k, (g, a, b) in enumerate(events):
                if a >= last.get(g, 0):
                    want.append(k)
                    last[g] = b
            assert sc.without_overlap(*np.array(events, np.int64).reshape(-1, 3).T).tolist() == want


def test_hash_columns():
    h = ev.event_hashes(np.array([1]), np.array([0]), np.array([3]))
    assert f"{int(h[0]):016x}" == ev.ordered_digest([(1, 0, 3)])


def test_counts_by_aggregate(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = matcher("the", "of")
    assert rows(ev.pattern_counts(sc.scan(df, m))) == rows(sc.counts(df, m).groupBy("pattern_id").agg(F.sum("n")))


def test_diagnostics(spark):
    df = spark.createDataFrame([("xxab",), ("ab",), (None,)], "text string").coalesce(1)
    r = sc.diagnostics(df, matcher("ab", r"\bx")).first().asDict()
    assert r["texts"] == 3 and r["units"] == 6 and r["starts"] == 12 and r["admitted_starts"] == 4 and r["events"] == 3 and r["automata"] == 2 and r["assertion_automata"] == 1 and r["start_path"] == "beginnings" and r["state_path"] == "table"
    off = MatcherBuilder().add(1, "ab").prefilter_enabled(False).literal_prefilter_enabled(False).cohort_compilation_enabled(False).build()
    assert sc.diagnostics(df, off).first().admitted_starts == 6 and sc.diagnostics(df, off).first().start_path == "all"
    plain = MatcherBuilder().add(1, "ab").add(2, "x*").state_cache_budget(0).build()
    both = sc.diagnostics(df.repartition(3), plain)
    m = sc.merge_diagnostics(both).first()
    assert m.state_path == "plain" and m.texts == 3 and m.units == 6 and m.fallback_transitions > 0 and m.states_made <= 3 * both.count() and m.workers == 1 and m.events == 4
    assert sc.merge_diagnostics(both.limit(0)).first().texts == 0
    rows_ = sc.diagnostics(df, off).select("start_path", *(c for c in both.columns if c != "start_path")).unionByName(both)
    assert sc.merge_diagnostics(rows_).first().start_path == "mixed"
