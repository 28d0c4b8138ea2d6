"""The pattern language: symbols, parsing, automaton against the interpreter."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmesh.plans import automaton
from textmesh.plans import expr as E
from textmesh.plans import symbols as S
from textmesh.plans.dialect import parse
from textmesh.plans.errors import DuplicatePatternId, EmptyPattern, InvalidPattern, InvalidPatternId, InvalidWorkerCount, NoPatterns, PatternError, PatternNestingTooDeep, PatternSetTooLarge
from textmesh.plans.interpreter import find
from textmesh.plans.matcher import CASE_INSENSITIVE, Matcher, MatcherBuilder


def hits(pattern, text, flags=0):
    return [e[1:] for e in MatcherBuilder().add(1, pattern, flags).build().find(text)]


def test_case_table_has_the_published_hash():
    blob = b"RMF1" + (65536).to_bytes(4, "big") + S.case_table().astype(">u2").tobytes()
    assert hashlib.sha256(blob).hexdigest() == "159531a10c144b10e448d7a66786978ba71d86dba966fc89f7191c0592bce4f4"


def test_sets():
    assert [u for u in range(65536) if S.contains(S.SPACE, u)] == [9, 10, 11, 12, 13, 32]
    assert sum(hi - lo + 1 for lo, hi in S.WORD) == 63
    for s in (S.EMPTY, S.ANY, S.WORD, S.DIGIT):
        assert S.complement(S.complement(s)) == s and S.union(s, S.complement(s)) == S.ANY
    assert S.union(((1, 3),), ((4, 5),), ((9, 9),)) == ((1, 5), (9, 9))


@pytest.mark.parametrize(("pattern", "text", "want"), [
    ("a+", "aaa", [(0, 3), (1, 3), (2, 3)]), ("aba", "ababa", [(0, 3), (2, 5)]), ("a|ab|abc", "abc", [(0, 3)]), ("a||b", "ab", [(0, 1), (1, 2)]),
    ("x(|a)y", "xyxay", [(0, 2), (2, 5)]), ("x(a|)y", "xyxay", [(2, 5)]), ("x()y", "xy", []), ("x()?y", "xy", [(0, 2)]), ("a.*b", "axb\nb", [(0, 5)]),
    ("a{2,3}", "aaaa", [(0, 3), (1, 4), (2, 4)]), ("a{0,2}b", "aab", [(0, 3), (1, 3), (2, 3)]), ("(?:a|aa)+b", "aab", [(0, 3), (1, 3)]), (".", [0xD800, 0xDC00], [(0, 1), (1, 2)]),
    ("😀", "x😀", [(1, 3)]), ("😀+", [0xD83D, 0xDE00, 0xDE00], [(0, 3)]), ("(?i)ǅ", "Ǆǅǆ", [(0, 1), (2, 3)]), ("(?i)[ǅ]", "Ǆǅǆ", [(0, 1), (1, 2), (2, 3)]),
    ("(?i)[^a]", "aAb", [(2, 3)]), ("(?iis)a", "A", [(0, 1)]), ("^a", "a\nab a", [(0, 1), (2, 3)]), ("a^", "a\na", []), ("$a", "\na", []), ("$\\n", "\n", []), ("\\n^a", "x\na", [(1, 3)]),
    ("foo$|foobar", "foo\nfoobar", [(0, 3), (4, 10)]), (r"\bΩ\b", "Ω", []), (r"\BΩ\B", "Ω", [(0, 1)]), (r"cat\b|category", "category cat", [(0, 8), (9, 12)]), (r"\bcat", "écat", [(1, 4)]),
    ("[]", "a", []), ("[^]", "a\n", [(0, 1), (1, 2)]), (r"\s", "\x0b", [(0, 1)]), ("]}", "]}", [(0, 2)]), ("(a||)", "a", [(0, 1)]), ("a*", "b", []), ("(?i)k", "K", []), ("a", "", []),
    (r"[\]\[\-\^]", "-", [(0, 1)]), ("[(.*]", "(", [(0, 1)]),
])
def test_events(pattern, text, want):
    assert hits(pattern, text) == want


@pytest.mark.parametrize(("pattern", "span"), [
    ("[-a]", (1, 2)), ("[a-]", (0, 4)), ("[a-b-c]", (4, 5)), (r"[\.]", (1, 3)), (r"[\D]", (1, 3)), ("[a", (0, 2)), ("(?i)[Z-a]", (5, 8)), ("a{2}{3}", (1, 5)), ("a+?", (1, 3)), ("(?i)", (0, 4)),
    ("[]*", (0, 3)), ("^", (0, 1)), (r"\b", (0, 2)), ("^$", (0, 2)), ("|", (0, 1)), ("(|)*", (0, 4)), ("|[]", (0, 3)), ("a{1001}", (1, 6)), ("a{0}", (1, 4)), ("a{0,0}", (1, 6)), ("a{3,2}", (1, 6)), ("a{,2}", (1, 3)),
    ("a{x}", (1, 3)), ("a{2", (1, 3)), ("a)", (1, 2)), ("*a", (0, 1)), ("{2}", (0, 1)), ("(?=a)", (0, 2)), ("a(?i)b", (1, 3)), ("(?x)a", (0, 2)), (r"\q", (0, 2)), ("a\\", (1, 2)), (r"[\d-z]", (3, 4)), (r"[a-\d]", (0, 5)),
    ("(a", (0, 2)), ("a|*", (2, 3)), ("(*a)", (1, 2)),
])
def test_rejections(pattern, span):
    with pytest.raises(InvalidPattern) as e:
        parse(1, pattern)
    assert e.value.span == span


def test_accepted_edges():
    for p in ("a{0002}", "a{0,}", "]}", "()", "[]", "(a||)", "a{1000}", "(" * 256 + "a" + ")" * 256, "(" * 256 + "()" + ")" * 256):
        MatcherBuilder().add(1, p).build()
    with pytest.raises(PatternNestingTooDeep):
        parse(1, "(" * 257 + "a" + ")" * 257)


def test_builder():
    b = MatcherBuilder()
    with pytest.raises(NoPatterns):
        b.worker_count(0).build()
    b.add(0, "a")
    with pytest.raises(InvalidWorkerCount):
        b.build()
    b.worker_count(1)
    with pytest.raises(DuplicatePatternId):
        b.add(0, "[")
    with pytest.raises(InvalidPattern):
        b.add(1, "[")
    with pytest.raises(EmptyPattern):
        b.add(1, "")
    with pytest.raises(InvalidPatternId):
        b.add(1 << 32, "a")
    b.add(1, "a").add((1 << 32) - 1, "A", CASE_INSENSITIVE)
    assert b.build().find("a") == [(0, 0, 1), (1, 0, 1), ((1 << 32) - 1, 0, 1)]
    assert b.build().restrict([1]).find("a") == [(1, 0, 1)]
    with pytest.raises(PatternSetTooLarge):
        Matcher([parse(1, "(a{1000}){1000}")], limit=10_000)
    assert len(MatcherBuilder().add_all([(1, "a"), (2, "["), (1, "b")], on_reject="skip").patterns) == 1


ATOMS = ["a", "b", ".", "[ab]", "[^a]", r"\n"]
SHAPES = ["{0}", "{0}{1}", "{0}|{1}", "({0}|{1})*{0}", "{0}+{1}", "{0}?{1}", "{0}{{1,2}}", "(?:{0}{1})+", "({0}|)x?{1}"]
FACTS = ["^{0}", "{0}$", r"\b{0}", r"{0}\b", r"{0}\B{1}", r"({0}$|{0}{1})", r"(^|{1}){0}", r"(\b|{1}){0}+$"]


def test_generated_patterns_over_all_short_texts():
    patterns = [s.format(x, y) for s in SHAPES + FACTS for x, y in itertools.product(ATOMS, ATOMS)]
    trees = []
    for k, p in enumerate(dict.fromkeys(patterns)):
        try:
            trees.append(parse(k, p))
        except PatternError:
            continue
    assert len(trees) > 300
    for budget, workers in ((8192, 1), (5, 3), (0, 1)):
        m = Matcher(trees, budget, workers)
        for n in range(4 if budget == 8192 else 3):
            for t in itertools.product("ab\n", repeat=n):
                units = [ord(c) for c in t]
                assert m.find(units) == find([(p.pattern_id, p.tree) for p in trees], units)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcxyz012", min_size=1, max_size=6), min_size=1, max_size=8), st.lists(st.sampled_from([*map(ord, "abcxyz012"), 0xD800, 0xDFFF]), max_size=96), st.sampled_from([0, 1, 8192]), st.sampled_from([1, 2, 4]))
def test_literals_against_substrings(words, units, budget, workers):
    b = MatcherBuilder().state_cache_budget(budget).worker_count(workers)
    for k, w in enumerate(words):
        b.add(k, w)
    want = sorted((k, s, s + len(w)) for k, w in enumerate(words) for s in range(len(units)) if units[s : s + len(w)] == [ord(c) for c in w])
    assert b.build().find(units) == want


def test_rows_are_separate():
    m = MatcherBuilder().add(1, "ab").add(2, r"\bb").add(3, "a$").build()
    units = np.frombuffer("abab".encode("utf-16-le"), "<u2")
    start, ordinal, end = m.events(units, np.array([0, 1, 1, 2, 4]))
    assert sorted(zip(m.ids[ordinal].tolist(), start.tolist(), end.tolist(), strict=True)) == [(1, 2, 4), (2, 1, 2), (3, 0, 1)]


def test_necessary_literals():
    build = lambda *ps: MatcherBuilder().add_all(enumerate(ps)).build().necessary_literals()
    assert build("abc[0-9]", "abd+", "ab") == ["ab"]
    assert build("abc", "x(y|z)") == ["abc", "x"]
    assert build("abc", "[ab]c") is None and build("a?b") is None and build("(ab){2}c") == ["ababc"] and build(r"ab\bc") == ["ab"]


def test_facts():
    assert E.most_consumed(parse(1, "a{2,5}(b|cd)").tree) == 7 and E.least_consumed(parse(1, "a{2,5}(b|cd)").tree) == 3
    assert E.most_consumed(parse(1, "a+").tree) == E.UNBOUNDED and E.most_consumed(parse(1, "[]").tree) is None
    assert E.prefix(parse(1, r"\bab").tree, True) == ((97, 98), True) and E.prefix(parse(1, r"\bab").tree, False) == ((), False)


def test_random_long_text():
    rng = random.Random(5)
    text = "".join(rng.choice("ab \n") for _ in range(300))
    trees = [parse(k, p) for k, p in enumerate([r"\b[ab]+\b", "(ab|ba){2,}$", "^.{3}", "a.*?b".replace("?", ""), "[^ ]+"])]
    assert Matcher(trees).find(text) == find([(p.pattern_id, p.tree) for p in trees], [ord(c) for c in text])


@pytest.mark.parametrize(("chunk", "meet", "visits", "budget"), [(1 << 18, 16, 1 << 20, None), (7, 2, 5, None), (13, 1, 1, 3), (40, 3, 50, 1), (64, 4, 9, 0)])
def test_starts_that_meet(monkeypatch, chunk, meet, visits, budget):
    for name, value in (("CHUNK", chunk), ("MEET", meet), ("VISITS", visits), ("ROWS", 50)):
        monkeypatch.setattr(automaton, name, value)
    rng = random.Random(chunk)
    patterns = [".+", "[^b]*", "(ab|ba)+", "(a|b){5,30}", r"\b.*a$", "a.*b", "b[^ ]{0,9}a", "(aa|a)*b", r"^.{4,}\b", "a+|a+b+", "[]", "b"]
    trees = [parse(k, p) for k, p in enumerate(patterns)]
    texts = ["".join(rng.choice("aaabb \n") for _ in range(rng.randint(0, 70))) for _ in range(6)]
    for cohorts in (True, False):
        m = Matcher(trees, budget, 1, cohorts=cohorts)
        units = np.array([ord(c) for t in texts for c in t], np.uint16)
        rows = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start, ordinal, end = m.events(units, rows)
        row = np.searchsorted(rows, start, side="right") - 1
        got = sorted(zip(row.tolist(), m.ids[ordinal].tolist(), (start - rows[row]).tolist(), (end - rows[row]).tolist(), strict=True))
        assert got == sorted((k, *e) for k, t in enumerate(texts) for e in find([(p.pattern_id, p.tree) for p in trees], [ord(c) for c in t]))


@pytest.mark.parametrize(("chunk", "meet", "budget"), [(1 << 18, 16, None), (31, 3, None), (9, 1, 2), (50, 5, 4)])
def test_runs_of_a_state(monkeypatch, chunk, meet, budget):
    for name, value in (("CHUNK", chunk), ("MEET", meet), ("RUNNING", 0), ("SPARSE", 3), ("LONG", 2)):
        monkeypatch.setattr(automaton, name, value)
    rng = random.Random(chunk)
    for patterns in ([r"[^\n]+", ".+"], [r"\b[ab]+\b", "a.*"], ["x.*b", "x[^\n]*$"], ["([ab]+ )+", "[ab]+( [ab]+)*", "b*a.*"], [".+", "a+", r"^[^ ]+", "(aa)*b", "[^a]+b*"]):
        trees = [parse(k, p) for k, p in enumerate(patterns)]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for letters in ("aaaaab", "aaaaaabbbbb \n", "ab    ", "a", "aaaaaaaaaaaax\n")]
        m = Matcher(trees, budget)
        units = np.array([ord(c) for t in texts for c in t], np.uint16)
        rows = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        want = sorted((k, *e) for k, t in enumerate(texts) for e in find([(p.pattern_id, p.tree) for p in trees], [ord(c) for c in t]))
        for _ in range(2):  # the second time with the states that are known
            start, ordinal, end = m.events(units, rows)
            row = np.searchsorted(rows, start, side="right") - 1
            assert sorted(zip(row.tolist(), m.ids[ordinal].tolist(), (start - rows[row]).tolist(), (end - rows[row]).tolist(), strict=True)) == want


def test_long_lines_take_few_steps():
    m = MatcherBuilder().add(1, r"[^\n]+").add(2, ".+").build()
    units = np.frombuffer((("x" * 4999 + "\n") * 80).encode("utf-16-le"), "<u2")
    start, ordinal, end = m.events(units, np.array([0, len(units)]))
    assert np.bincount(ordinal).tolist() == [4999 * 80, 5000 * 80] and (end[ordinal == 1] == len(units)).all() and (end[ordinal == 0] == start[ordinal == 0] // 5000 * 5000 + 4999).all()
    assert m.automata[0].counters["steps"] < 100


def test_long_matches_take_little_memory_and_time():
    import resource

    text = "x" * 300_000 + "\n" + "ab" * 50_000
    m = MatcherBuilder().add(1, r"[^\n]+").add(2, "[^a]*").add(3, "(ab)+").build()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    start, ordinal, end = m.events(units, np.array([0, len(units)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    n = np.bincount(ordinal)
    assert n.tolist() == [400_000, 350_001, 50_000] and (end[(ordinal == 0) & (start < 300_000)] == 300_000).all() and (end[ordinal == 2] == len(units)).all()
    assert (end[(ordinal == 1) & (start <= 300_000)] == 300_001).all()


def test_beginnings_exclude_places():
    m = MatcherBuilder().add(1, "abc").add(2, "xy[0-9]z").add(3, r"q\bq?").build()
    text = "ab.abd.abc.xy1z.xyz.xy." * 4000
    got = m.find(text)
    off = MatcherBuilder().add(1, "abc").add(2, "xy[0-9]z").add(3, r"q\bq?").prefilter_enabled(False).build()
    a, b = m.automata[0].counters, off.automata[0].counters
    assert got == off.find(text) and len(got) == 8000 and a["admitted_starts"] == 8000 and a["masked_places"] == len(text)
    dense = MatcherBuilder().add(1, "[a-z.]{3}").build()
    assert len(dense.find(text)) > 60_000 and dense.automata[0].counters["mask_bypasses"] == 1 and b["masked_places"] == 0
