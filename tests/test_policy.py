"""Prefix matcher and fixture operators."""

import pytest

from textmesh.operators import fixtures as fx
from textmesh.operators import policy as po
from textmesh.plans.matcher import MatcherBuilder
from textmesh.sources.files import FIXTURE


def builder(n, shape=r"\bword{:04d}\b"):
    b = po.PrefixMatcherBuilder()
    for k in range(n):
        b.add(k, shape.format(k))
    return b


def test_eligibility():
    for b, kind in ((builder(3, "word{:04d}"), "no_assertion_bearing_patterns"), (builder(255), "too_few_assertion_bearing_patterns"), (builder(256, r"\bw{:04d}"), "no_shared_five_unit_ascii_prefix"), (builder(256, r"(?i)\bword{:04d}"), "no_shared_five_unit_ascii_prefix")):
        with pytest.raises(po.Ineligible) as e:
            b.build()
        assert e.value.kind == kind
    m = builder(256).add(999, "free").build()
    assert m.prefix == "word0" and m.assertion_patterns == 256


def test_policies(spark):
    m = builder(256).add(999, "xy").build()
    m.min_units = 100
    texts = [(1, "word0001 xy word0255 wordword0002 " * 9), (2, "word0003"), (3, None), (4, "word0" * 99)]
    df = spark.createDataFrame(texts, "id long, text string")
    plain = MatcherBuilder().add_all([(p.pattern_id, p.text) for p in m.matcher.patterns]).build()
    events, report = po.scan_with_policy(df, m, po.ALLOW_EXACT_FALLBACK)
    want = sorted((i, *e) for i, t in texts if t for e in plain.find(t))
    assert sorted(map(tuple, events.collect())) == want and want
    got = {r.id: r for r in report.collect()}
    assert {i: (r.backend, r.specialized, r.reason, r.candidates, r.candidate_bytes) for i, r in got.items()} == {
        1: ("assertion_prefix", True, None, 27, -(-len(texts[0][1]) // 8)), 2: ("exact", False, "input_too_short", 0, 0), 3: ("exact", False, "input_too_short", 0, 0), 4: ("assertion_prefix", True, None, 99, -(-495 // 8)),
    }
    assert got[2].input_units == 8 and got[3].input_units == 0 and got[1].minimum_units == 100 and got[1].assertion_patterns == 256 and got[1].shared_prefix == "word0" and got[1].policy == po.ALLOW_EXACT_FALLBACK
    events, report = po.scan_with_policy(df, m, po.REQUIRE_SPECIALIZED)
    assert {r.id for r in events.collect()} == {1} and {r.id: r.backend for r in report.collect()}[2] == "refused"
    with pytest.raises(ValueError):
        po.scan_with_policy(df, m, "other")


def test_disabled_acceleration(spark):
    df = spark.createDataFrame([(1, "word0001 " * 30)], "id long, text string")
    for off, reason in (("prefilter_enabled", "acceleration_disabled"), ("literal_prefilter_enabled", "literal_acceleration_disabled")):
        m = getattr(builder(256), off)(False).build()
        m.min_units = 100
        events, report = po.scan_with_policy(df, m, po.ALLOW_EXACT_FALLBACK)
        assert report.first().reason == reason and events.count() == 30
        events, report = po.scan_with_policy(df, m, po.REQUIRE_SPECIALIZED)
        assert report.first().backend == "refused" and events.count() == 0
    dense = po.PrefixMatcherBuilder().add_all([(k, rf"\baaaaa{k}?") for k in range(256)]).build()
    dense.min_units = 100
    events, report = po.scan_with_policy(spark.createDataFrame([("a" * 200,)], "text string"), dense, po.ALLOW_EXACT_FALLBACK)
    assert report.first().reason == "candidate_sample_too_dense" and events.count() == 10


def test_fixtures(spark):
    u = lambda s: [ord(c) for c in s]
    rows = [(1, "one", "f", "matched", [(1, u("a")), (2, u("aa"))], u("aaa")), (1, "bad", "f", "rejected", [(1, u("["))], u("a")), (1, "none", "g", "matched", [(1, u("a"))], [])]
    out = fx.run_cases(spark.createDataFrame(rows, FIXTURE))
    got = {r.case_id: (r.status, [tuple(e) for e in r.events]) for r in out.collect()}
    assert got == {"one": ("matched", [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3)]), "bad": ("rejected", []), "none": ("matched", [])}
    assert fx.compare(out, out).count() == 0
    assert {(r.case_id, r.problem) for r in fx.compare(out.where("case_id <> 'one'"), out.where("case_id <> 'bad'")).collect()} == {("one", "missing"), ("bad", "unexpected")}
    assert [(r.comparisons, r.differences) for r in fx.totals(out, out.where("case_id <> 'bad'").withColumn("status", fx.F.lit("matched"))).where("family is null").collect()] == [(2, 0)]
    assert [(r.comparisons, r.differences) for r in fx.totals(out, out.withColumn("status", fx.F.lit("matched"))).where("family is null").collect()] == [(3, 1)]
    assert sorted((str(r.family), r.cases, r.matched, r.rejected, r.events) for r in fx.totals(out).collect()) == [("None", 3, 2, 1, 5), ("f", 2, 1, 1, 5), ("g", 1, 1, 0, 0)]
