"""Queries over the test tables, each with the SQL that gives the same rows.

The SQL knows nothing of the matcher: it tries all pairs of start and end of a
short column, or compares substrings and their neighbours.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from textmesh.functions import as_units, is_empty, text_units
from textmesh.operators import events as ev
from textmesh.operators import fixtures as fx
from textmesh.operators import patterns as pt
from textmesh.operators import policy as po
from textmesh.operators import scan as sc
from textmesh.plans import symbols
from textmesh.plans.matcher import CASE_INSENSITIVE, MatcherBuilder
from textmesh.sources import files
from textmesh.streaming.scan import scan_stream

QUERIES, ORACLE = {}, {}


def matcher(patterns, budget: int | None = None, workers: int = 1, prefilter: bool = True, cohorts: bool = True, fold: bool = False):
    b = MatcherBuilder().state_cache_budget(budget).worker_count(workers).prefilter_enabled(prefilter).cohort_compilation_enabled(cohorts)
    for i, p in patterns:
        b.add(i, p, CASE_INSENSITIVE if fold else 0)
    return b.build()


def table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + ")"


def all_pairs(name: str, keys: list[str], text: str, patterns, longest: int = 64) -> str:
    """Every start and end of the distinct texts of a column; the largest end."""
    rx = values((str(i), lit(f"(?s){p}")) for i, p in patterns)
    return f"""WITH d AS (SELECT DISTINCT {text} AS t FROM {name} WHERE {text} IS NOT NULL),
p AS (SELECT t, unnest(range(length(t))) AS s FROM d),
q AS (SELECT t, s, unnest(range(1, least(length(t) - s, {longest}) + 1)) AS k FROM p),
m AS (SELECT t, CAST(r.id AS BIGINT) AS pattern_id, CAST(s AS BIGINT) AS "start", CAST(max(s + k) AS BIGINT) AS "end"
  FROM q, {rx} AS r(id, rx) WHERE regexp_full_match(substr(t, CAST(s + 1 AS BIGINT), CAST(k AS BIGINT)), r.rx) GROUP BY ALL)
SELECT {", ".join(f"x.{k}" for k in keys)}, m.pattern_id, m."start", m."end" FROM {name} x JOIN m ON x.{text} = m.t"""


def starts(name: str, keys: list[str], text: str, branches) -> str:
    """branches: (id, literal, condition on the neighbours a and b); the
    longest branch of an id counts."""
    parts = [
        f"SELECT {', '.join(keys)}, CAST({i} AS BIGINT) AS pattern_id, s, s + {len(w)} AS e, CASE WHEN s = 0 THEN '' ELSE substr(t, s, 1) END AS a, substr(t, s + {len(w) + 1}, 1) AS b, "
        f"substr(t, s + 1, 1) AS f, substr(t, s + {len(w)}, 1) AS l FROM p WHERE substr(t, s + 1, {len(w)}) = {lit(w)}"
        for i, w, _ in branches
    ]
    cond = [c for *_, c in branches]
    union = " UNION ALL ".join(f"SELECT * FROM ({q}) z WHERE {c}" for q, c in zip(parts, cond, strict=True))
    return f"""WITH p AS (SELECT {', '.join(keys)}, {text} AS t, unnest(range(length({text}))) AS s FROM {name})
SELECT {', '.join(keys)}, pattern_id, CAST(s AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM ({union}) u GROUP BY {', '.join(keys)}, pattern_id, s"""


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def short_column(name: str, source: str, keys: list[str], text: str, patterns, oracle=None, longest: int = 64, fold: bool = False):
    """A scan of a whole short column."""
    rx = oracle if oracle is not None else patterns
    query(name, all_pairs(source, keys, text, rx, longest))(lambda spark, d: sc.scan(table(spark, d, source, *keys, text), matcher(patterns, fold=fold), text, keys))


_PART = ("part", ["p_partkey"], "p_name")
_URL = ("pages", ["page_id"], "url")
_PROPS = ("events", ["event_id"], "props")

for _name, _patterns, _oracle in [
    ("class_union", [(1, "[os]m"), (2, "[aeiou ]r")], None),
    ("class_range", [(1, "[a-f][n-t]"), (2, "[l-r]+")], None),
    ("class_negated", [(1, "[^a-m ]+")], None),
    ("class_any", [(1, "r[^]")], [(1, "r.")]),
    ("empty_class_mixed", [(1, "[]"), (2, "in"), (3, "a[]b|re")], [(2, "in"), (3, "re")]),
    ("alternation_longest", [(1, "r|re|red|ri"), (2, "s|sm|small")], None),
    ("shared_prefix_alternation", [(1, "sm(all|ooth|o)"), (2, "r(e|ed|i|ing)")], None),
    ("nested_groups", [(1, "((a|e|i)(l|n|d))+"), (2, "(?:(?:s|m)(?:m|a)){1,2}")], None),
    ("leading_empty_alt", [(1, "r(|e)d"), (2, "s(|m)(|a)")], None),
    ("trailing_empty_alt", [(1, "r(e|)d"), (2, "m(a||)")], [(1, "red"), (2, "m(a|)")]),
    ("empty_group", [(1, "r()e"), (2, "r()?e"), (3, "l()*l")], [(2, "re"), (3, "ll")]),
    ("optional", [(1, "e?d"), (2, "al?l?")], None),
    ("star", [(1, "l*e"), (2, "[a-z]*")], None),
    ("plus", [(1, "[a-z]+"), (2, "l+")], None),
    ("count_exact", [(1, "[a-z]{3}"), (2, "l{2}")], None),
    ("count_range", [(1, "[a-z]{2,4}"), (2, "(?:a|l){1,3}")], None),
    ("count_open", [(1, "[a-z]{4,}"), (2, "l{0,}a")], None),
    ("dot_star", [(1, "s.*g"), (2, "r.+")], None),
    ("nullable_consuming", [(1, "l*"), (2, "(?:a|)")], [(1, "l+"), (2, "a")]),
    ("many_patterns", [(k, p) for k, p in enumerate([f"{a}[a-z]{{{n}}}" for a in "abcdefghijklmnopqrst" for n in (1, 2, 3)], 1)], None),
]:
    short_column(_name, *_PART, _patterns, _oracle)

short_column("escapes", *_URL, [(1, r"\."), (2, r"\?[a-z_]+="), (3, r"/[a-z]{2}/"), (4, "://")])
short_column("case_insensitive_class", *_URL, [(1, "(?i)[A-D]+"), (2, "(?i)[^H-Z/.:0-9]+")], [(1, "[A-Da-d]+"), (2, "[^H-Zh-z/.:0-9]+")])
short_column("case_insensitive_typed_flag", *_URL, [(1, "HTTP"), (2, "Example|ORG")], [(1, "[hH][tT][tT][pP]"), (2, "[eE][xX][aA][mM][pP][lL][eE]|[oO][rR][gG]")], fold=True)
short_column("case_insensitive_prefix_flag", *_URL, [(1, "(?is)E."), (2, "(?i)wWw")], [(1, "[eE]."), (2, "[wW]{3}")])
short_column("shorthands", *_PROPS, [(1, r"\d+"), (2, r"\w+"), (3, r"\s")], [(1, "[0-9]+"), (2, "[A-Za-z0-9_]+"), (3, "[ \t\n\x0b\f\r]")])
short_column("shorthand_complements", *_PROPS, [(1, r"\D+"), (2, r"\W"), (3, r"\S+")], [(1, "[^0-9]+"), (2, "[^A-Za-z0-9_]"), (3, "[^ \t\n\x0b\f\r]+")])
short_column("dot_any", "conversations", ["conv_id", "turn"], "text", [(1, "t.e"), (2, "\\..")], [(1, "t.e"), (2, "[.].")], longest=3)

_CONV = ["conv_id", "turn"]
_WORD = "regexp_matches({}, '^[A-Za-z0-9_]$')"
_BORDER_LEFT, _BORDER_RIGHT = f"({_WORD.format('a')} <> {_WORD.format('f')})", f"({_WORD.format('b')} <> {_WORD.format('l')})"


def conversation(name, patterns, branches):
    query(name, starts("conversations", _CONV, "text", branches))(lambda spark, d: sc.scan(table(spark, d, "conversations", *_CONV, "text"), matcher(patterns), "text", _CONV))


conversation("word_boundary", [(1, r"\bthe\b"), (2, r"of\b"), (3, r"\ban")], [(1, "the", f"{_BORDER_LEFT} AND {_BORDER_RIGHT}"), (2, "of", _BORDER_RIGHT), (3, "an", _BORDER_LEFT)])
conversation("non_word_boundary", [(1, r"\Bth\B"), (2, r"\Be")], [(1, "th", f"NOT {_BORDER_LEFT} AND NOT {_BORDER_RIGHT}"), (2, "e", f"NOT {_BORDER_LEFT}")])
conversation("line_start", [(1, "^T"), (2, r"^th|en")], [(1, "T", "a IN ('', chr(10))"), (2, "th", "a IN ('', chr(10))"), (2, "en", "true")])
conversation("line_end", [(1, r"\.$"), (2, "t.$")], [(1, ".", "b IN ('', chr(10))")] + [(2, "t" + c, "b IN ('', chr(10))") for c in ".,?!"])
conversation("line_feed_then_start", [(1, r"\n^A"), (2, r"$\n"), (3, "$a")], [(1, "\nA", "true")])
conversation("assertion_alternation_longest", [(1, r"on\b|only"), (2, r"\bth|the")], [(1, "on", _BORDER_RIGHT), (1, "only", "true"), (2, "th", _BORDER_LEFT), (2, "the", "true")])
conversation("literal_overlap", [(1, "thth"), (2, "nn"), (3, "anan")], [(1, "thth", "true"), (2, "nn", "true"), (3, "anan", "true")])

#: Literals that can't overlap themselves, so that replacing counts them.
_WORDS = [(1, "the"), (2, "tion"), (3, "of"), (4, "idiot"), (5, "stupid")]
_N = {i: f"(length(text) - length(replace(text, {lit(w)}, ''))) // {len(w)}" for i, w in _WORDS}
_DOC_COUNTS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS pattern_id, CAST({n} AS BIGINT) AS n FROM documents" for i, n in _N.items()) + ") WHERE n > 0"


@query("doc_counts", _DOC_COUNTS)
def doc_counts(spark, d):
    return sc.counts(table(spark, d, "documents", "doc_id", "text"), matcher(_WORDS))


@query("pattern_counts", f"SELECT pattern_id, CAST(sum(n) AS BIGINT) AS n FROM ({_DOC_COUNTS}) GROUP BY pattern_id")
def pattern_counts(spark, d):
    return doc_counts(spark, d).groupBy("pattern_id").agg(F.sum("n").alias("n"))


@query("top_patterns", f"SELECT pattern_id, CAST(sum(n) AS BIGINT) AS n FROM ({_DOC_COUNTS}) GROUP BY pattern_id ORDER BY n DESC, pattern_id LIMIT 3")
def top_patterns(spark, d):
    return pattern_counts(spark, d).orderBy(F.desc("n"), "pattern_id").limit(3)


@query("literal_all_starts", """WITH p AS (SELECT doc_id, k.id AS pattern_id, length(k.w) AS size, string_split(text, k.w) AS parts
  FROM documents, (VALUES (1, 'idiot'), (2, 'stupid'), (3, 'pathetic')) AS k(id, w)),
q AS (SELECT doc_id, pattern_id, size, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
r AS (SELECT doc_id, pattern_id, size, i, sum(length(part) + size) OVER (PARTITION BY doc_id, pattern_id ORDER BY i) AS e, max(i) OVER (PARTITION BY doc_id, pattern_id) AS n FROM q)
SELECT doc_id, CAST(pattern_id AS BIGINT) AS pattern_id, CAST(e - size AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM r WHERE i < n""")  # fmt: skip
def literal_all_starts(spark, d):
    return sc.scan(table(spark, d, "documents", "doc_id", "text"), matcher([(1, "idiot"), (2, "stupid"), (3, "pathetic")]))


@query("duplicate_text_ids", all_pairs(*_PART, [(7, "red"), (8, "red"), (0, "r")]))
def duplicate_text_ids(spark, d):
    return sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher([(7, "red"), (8, "red"), (0, "r")]), "p_name")


_MEMBERS = [(1, "idiot|stupid|scum"), (2, "[0-9]{4}-[0-9]{4}"), (3, r"@[a-z]+\."), (4, "[A-Z]{3,}!")]


@query("membership", "SELECT doc_id, CAST(r.id AS BIGINT) AS pattern_id FROM documents, " + values((str(i), lit(p)) for i, p in _MEMBERS) + " AS r(id, rx) WHERE regexp_matches(text, r.rx)")
def membership(spark, d):
    return sc.membership(table(spark, d, "documents", "doc_id", "text"), matcher(_MEMBERS)).select("doc_id", F.explode("pattern_ids").alias("pattern_id"))


@query("matched_ids", "SELECT DISTINCT CAST(r.id AS BIGINT) AS pattern_id FROM documents, " + values((str(i), lit(p)) for i, p in _MEMBERS) + " AS r(id, rx) WHERE regexp_matches(text, r.rx)")
def matched_ids(spark, d):
    return ev.matched_ids(membership(spark, d))


_COLOURS = [(1, "red|ring|r"), (2, "small|sm"), (3, "[aeiou]l+")]


@query("matched_text", f'SELECT e.*, substr(x.p_name, e."start" + 1, e."end" - e."start") AS matched FROM ({all_pairs(*_PART, _COLOURS)}) e JOIN part x USING (p_partkey)')
def matched_text(spark, d):
    return sc.matched_text(table(spark, d, "part", "p_partkey", "p_name"), matcher(_COLOURS), "p_name")


@query("event_length", f'SELECT p_partkey, pattern_id, "end" - "start" AS len FROM ({all_pairs(*_PART, _COLOURS)})')
def event_length(spark, d):
    return sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher(_COLOURS), "p_name").select("p_partkey", "pattern_id", (F.col("end") - F.col("start")).alias("len"))


@query("events_enriched", f"SELECT e.*, r.kind FROM ({all_pairs(*_PART, _COLOURS)}) e JOIN (VALUES (1, 'colour'), (2, 'size'), (3, 'other')) AS r(id, kind) ON r.id = e.pattern_id")
def events_enriched(spark, d):
    kinds = spark.createDataFrame([(1, "colour"), (2, "size"), (3, "other")], "pattern_id long, kind string")
    return sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher(_COLOURS), "p_name").join(F.broadcast(kinds), "pattern_id")


@query("outer_scan", f'SELECT x.p_partkey, e.pattern_id, e."start", e."end" FROM part x LEFT JOIN ({all_pairs(*_PART, [(1, "red")])}) e USING (p_partkey)')
def outer_scan(spark, d):
    return sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher([(1, "red")]), "p_name", outer=True)


@query("first_events_window", f"SELECT * FROM ({all_pairs(*_PART, _COLOURS)}) QUALIFY row_number() OVER (PARTITION BY p_partkey, pattern_id ORDER BY \"start\", \"end\") = 1")
def first_events_window(spark, d):
    return ev.first_events(sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher(_COLOURS), "p_name"), ["p_partkey"])


@query("leftmost_longest", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
c AS (SELECT p_partkey, length(part) AS k, sum(length(part) + 1) OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS e FROM w WHERE part <> '')
SELECT p_partkey, CAST(1 AS BIGINT) AS pattern_id, CAST(e - k AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM c""")  # fmt: skip
def leftmost_longest(spark, d):
    return ev.leftmost_longest(sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher([(1, "[a-z]+")]), "p_name"), ["p_partkey"])


#: Patterns with and without assertions, of which the branches are the longest first.
_VARIANT = [(1, r"\bthe\b"), (2, r"of\b"), (3, "an"), (4, "on|only|onl"), (5, r"t.$"), (6, "(?i)TION")]
_VARIANT_BRANCHES = [
    (1, "the", f"{_BORDER_LEFT} AND {_BORDER_RIGHT}"), (2, "of", _BORDER_RIGHT), (3, "an", "true"), (4, "on", "true"), (4, "onl", "true"), (4, "only", "true"),
    *((5, "t" + c, "b IN ('', chr(10))") for c in ".,?!"), *((6, w, "true") for w in ("tion", "Tion", "TION")),
]


def variant(name, change=lambda df: df, **how):
    """The same events however the matcher is set up and the rows are dealt."""
    query(name, starts("conversations", _CONV, "text", _VARIANT_BRANCHES))(lambda spark, d: sc.scan(change(table(spark, d, "conversations", *_CONV, "text")), matcher(_VARIANT, **how)))


variant("shard_invariance", workers=3)
variant("nfa_vs_dfa", budget=0)
variant("small_budget", budget=3)
variant("cohort_invariance", cohorts=False)
variant("start_filter_invariance", prefilter=False)
variant("partition_invariance", lambda df: df.repartition(7, "turn", "conv_id"))
query("split_invariance", starts("conversations", _CONV, "text", _VARIANT_BRANCHES))(lambda spark, d: sc.scan_split(table(spark, d, "conversations", *_CONV, "text"), matcher(_VARIANT), piece=200))

_INSULTS = [(1, "idiot"), (2, "stupid"), (3, "pathetic")]


@query("prefilter_invariance", ORACLE["literal_all_starts"])
def prefilter_invariance(spark, d):
    m = matcher(_INSULTS, prefilter=False)
    return sc.scan(table(spark, d, "documents", "doc_id", "text"), m)


_LINES = "SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n, text FROM documents"


@query("unbounded_matches", f"""SELECT doc_id, pattern_id, n, total FROM (
  SELECT doc_id, CAST(1 AS BIGINT) AS pattern_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS total FROM ({_LINES}) GROUP BY doc_id
  UNION ALL SELECT doc_id, CAST(2 AS BIGINT), length(text), length(text) * (length(text) + 1) // 2 FROM documents) WHERE n > 0""")  # fmt: skip
def unbounded_matches(spark, d):
    """Matches that run to the end of a line or of the text: how many, and how
    many units they cover."""
    found = sc.extents(table(spark, d, "documents", "doc_id", "text"), matcher([(1, r"[^\n]+"), (2, ".+")]))
    return found.groupBy("doc_id", "pattern_id").agg(F.sum("n").alias("n"), F.sum("units").alias("total"))


@query("leftmost_longest_documents", "SELECT doc_id, CAST(1 AS BIGINT) AS pattern_id, CAST(len(regexp_extract_all(text, '[a-z]+')) AS BIGINT) AS n, CAST(length(regexp_replace(text, '[^a-z]+', '', 'g')) AS BIGINT) AS units FROM documents WHERE regexp_matches(text, '[a-z]')")
def leftmost_longest_documents(spark, d):
    found = sc.extents(table(spark, d, "documents", "doc_id", "text"), matcher([(1, "[a-z]+")]), leftmost=True)
    return found.groupBy("doc_id", "pattern_id").agg(F.sum("n").alias("n"), F.sum("units").alias("units"))


@query("sql_function", all_pairs(*_PART, _COLOURS))
def sql_function(spark, d):
    name = "scan_" + uuid.uuid4().hex[:8]
    sc.register(spark, name, matcher(_COLOURS))
    return spark.sql(f"SELECT p_partkey, e.pattern_id, e.start, e.end FROM parquet.`{d}/part.parquet` LATERAL VIEW inline({name}(p_name)) e")


@query("stream_scan", all_pairs(*_PART, _COLOURS))
def stream_scan(spark, d):
    out = folder(spark)
    schema = spark.read.parquet(f"{d}/part.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(f"{d}")
    scan_stream(stream, matcher(_COLOURS), "p_name", ["p_partkey"], f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.schema("p_partkey long, pattern_id long, start long, end long").parquet(f"{out}/data")


_CASES = [
    (1, "a|ab", True, None, None, None), (2, "", False, "empty_pattern", None, None), (3, "[-a]", False, "invalid_pattern", 1, 2), (4, "a+?", False, "invalid_pattern", 1, 3),
    (5, "(?i)", False, "invalid_pattern", 0, 4), (6, "x()y", True, None, None, None), (7, "a{1001}", False, "invalid_pattern", 1, 6), (8, "(ab", False, "invalid_pattern", 0, 3),
    (9, "[]", True, None, None, None), (10, r"\q", False, "invalid_pattern", 0, 2), (11, "^$", False, "invalid_pattern", 0, 2), (12, "(" * 257 + "a" + ")" * 257, False, "pattern_nesting_too_deep", None, None),
    (13, "a)", False, "invalid_pattern", 1, 2), (14, "[b-a]", False, "invalid_pattern", 1, 4), (15, "a{0002}", True, None, None, None),
]
_sql = lambda v, t: f"CAST({'NULL' if v is None else str(v).lower() if isinstance(v, bool) else lit(v) if isinstance(v, str) else v} AS {t})"


@query("pattern_validation", "SELECT * FROM " + values([_sql(i, "BIGINT"), _sql(ok, "BOOLEAN"), _sql(e, "VARCHAR"), _sql(a, "BIGINT"), _sql(b, "BIGINT")] for i, _, ok, e, a, b in _CASES) + " AS v(pattern_id, ok, error, err_start, err_end)")
def pattern_validation(spark, d):
    return pt.validate(spark.createDataFrame([(i, p) for i, p, *_ in _CASES], "pattern_id long, pattern string"))


@query("pattern_diagnostics", "SELECT * FROM " + values([
    ["CAST(1 AS BIGINT)", "0", "'assertion_free'", "''", "false", "3", "'finite'", "3", "true", "3", "3", "true", "4"],
    ["CAST(2 AS BIGINT)", "1", "'assertion_bearing'", "'word_boundary'", "false", "2", "'finite'", "2", "true", "CAST(NULL AS INTEGER)", "2", "false", "4"],
    ["CAST(3 AS BIGINT)", "2", "'assertion_free'", "''", "true", "0", "'unbounded'", "CAST(NULL AS INTEGER)", "true", "CAST(NULL AS INTEGER)", "0", "false", "2"],
]) + " AS v(pattern_id, registration_ordinal, cohort, assertion_kinds, nullable, minimum_consumed, maximum_status, maximum_units, ascii_only, exact_literal_units, necessary_prefix_units, filterable_prefix, expression_nodes)")
def pattern_diagnostics(spark, d):
    b = MatcherBuilder().add(1, "abc").add(2, r"\bab").add(3, "a*")
    return pt.explain_patterns(spark, b).withColumn("assertion_kinds", F.array_join("assertion_kinds", ","))


@query("units_surrogates", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)), (1, 1, 1, 2), (2, 1, 0, 1), (2, 2, 0, 1), (3, 1, 0, 1), (3, 1, 1, 2), (3, 1, 2, 3), (3, 3, 0, 2)) AS v(id, pattern_id, \"start\", \"end\")")
def units_surrogates(spark, d):
    df = spark.createDataFrame([(1, [0xD800, 0xDC00]), (2, [0x0A]), (3, [0x61, 0x62, 0xD83D]), (4, [])], "id long, units array<int>")
    return sc.scan(df, matcher([(1, "."), (2, r"\n"), (3, "ab")]), "units")


_OFFSET, _PRIME, _WRAP = "14695981039346656037::HUGEINT", "1099511628211::HUGEINT", "18446744073709551616"
_BYTES = "list_concat(list_transform(range(4), lambda k: (pattern_id >> (8 * k)) & 255), list_concat(list_transform(range(8), lambda k: (s >> (8 * k)) & 255), list_transform(range(8), lambda k: (e >> (8 * k)) & 255)))"
_FNV = f"list_reduce(list_concat([{_OFFSET}], list_transform({{}}, lambda x: x::HUGEINT)), lambda h, x: (xor(h, x) * {_PRIME}) % {_WRAP}::HUGEINT)"
_HEX = "lpad(lower(to_hex(CAST({} AS UBIGINT))), 16, '0')"


@query("event_digest", f"""WITH e AS (SELECT pattern_id, "start" AS s, "end" AS e FROM ({ORACLE["literal_all_starts"]})),
h AS (SELECT pattern_id, {_FNV.format(_BYTES)} AS h FROM e),
r AS (SELECT h, (h * p) % {_WRAP}::HUGEINT + h // q AS turned, ((h::UHUGEINT * h::UHUGEINT) % {_WRAP}::UHUGEINT)::HUGEINT AS square
  FROM h JOIN (VALUES {", ".join(f"({i}, {2**i}::HUGEINT, {2**(64 - i)}::HUGEINT)" for i, _ in _INSULTS)}) AS t(id, p, q) ON t.id = h.pattern_id)
SELECT count(*) AS n, 'multiset64:' || {_HEX.format(f"coalesce(sum(h), 0) % {_WRAP}")} || ':' || {_HEX.format("coalesce(bit_xor(turned), 0)")} || ':' || {_HEX.format(f"coalesce(sum(square), 0) % {_WRAP}")} AS digest FROM r""")  # fmt: skip
def event_digest(spark, d):
    return ev.digest(sc.scan(table(spark, d, "documents", "doc_id", "text"), matcher(_INSULTS)))


@query("ordered_digest", f"""WITH e AS (SELECT p_partkey, pattern_id, "start" AS s, "end" AS e FROM ({all_pairs(*_PART, _COLOURS)})),
b AS (SELECT p_partkey, flatten(list({_BYTES} ORDER BY pattern_id, s)) AS bytes FROM e GROUP BY p_partkey)
SELECT p_partkey, {_HEX.format(_FNV.format("bytes"))} AS digest FROM b""")  # fmt: skip
def ordered_digest(spark, d):
    events = sc.scan(table(spark, d, "part", "p_partkey", "p_name"), matcher(_COLOURS), "p_name")
    return ev.ordered_digests(events, ["p_partkey"])


@query("scan_diagnostics", f"""SELECT count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS units, CAST(sum(length(text)) AS BIGINT) AS starts,
  CAST((SELECT sum(n) FROM ({_DOC_COUNTS})) AS BIGINT) AS events, CAST(5 AS BIGINT) AS patterns, CAST(1 AS BIGINT) AS automata, CAST(0 AS BIGINT) AS evictions, CAST(0 AS BIGINT) AS fallback_transitions, 'table' AS state_path FROM documents""")  # fmt: skip
def scan_diagnostics(spark, d):
    merged = sc.merge_diagnostics(sc.diagnostics(table(spark, d, "documents", "text"), matcher(_WORDS)))
    return merged.select("texts", "units", "starts", "events", "patterns", "automata", "evictions", "fallback_transitions", "state_path")


def folder(spark) -> str:
    """A new folder among those that the driver and all executors share."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='files-')}/files-{uuid.uuid4().hex}"


def written(lines) -> str:
    """The folder with one file of these lines (ordinal, value)."""
    path = folder(lines.sparkSession)
    lines.coalesce(1).sortWithinPartitions("ordinal").select("value").write.text(path)
    return path


@query("pattern_file", f"""WITH p AS (SELECT r_regionkey AS ordinal, CAST(r_regionkey + 1 AS BIGINT) AS pattern_id, substr(r_name, 1, 2) AS w FROM region),
t AS (SELECT r_regionkey, r_name, unnest(range(length(r_name))) AS i FROM region)
SELECT r_regionkey, ordinal, pattern_id, CAST(i AS BIGINT) AS "start", CAST(i + 2 AS BIGINT) AS "end" FROM t JOIN p ON substr(r_name, CAST(i + 1 AS BIGINT), 2) = w""")  # fmt: skip
def pattern_file(spark, d):
    region = table(spark, d, "region", "r_regionkey", "r_name")
    path = written(region.select(F.col("r_regionkey").alias("ordinal"), F.concat(F.col("r_regionkey") + 1, F.lit("\t"), F.substring("r_name", 1, 2)).alias("value")))
    patterns = files.read_patterns(spark, path)
    events = sc.scan(region, MatcherBuilder().from_dataframe(patterns).build(), "r_name")
    return events.join(F.broadcast(patterns.select("ordinal", "pattern_id")), "pattern_id")


@query("corpus_file", "SELECT md5(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, CAST(sum(length(n_name) + 1) AS BIGINT) AS units FROM nation")
def corpus_file(spark, d):
    nation = table(spark, d, "nation", "n_nationkey", "n_name")
    text = files.read_corpus(spark, written(nation.select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("value"))))
    return text.select(F.md5("text").alias("digest"), text_units(F.col("text")).cast("long").alias("units"))


@query("word_file", "SELECT CAST(row_number() OVER (ORDER BY w) AS BIGINT) AS pattern_id, w AS pattern FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' ORDER BY w LIMIT 4")
def word_file(spark, d):
    words = table(spark, d, "part", "p_partkey", F.explode(F.split("p_name", " ")).alias("value")).withColumnRenamed("p_partkey", "ordinal")
    return files.read_word_patterns(spark, written(words.withColumn("value", F.concat(F.lit(" "), "value", F.lit("\t")))), 4)


@query("expanded_text", "SELECT r_name, substr(repeat(r_name, 30), 1, 30) AS text FROM region")
def expanded_text(spark, d):
    rows = [(r.r_name, files.expand_corpus(r.r_name, 30)) for r in table(spark, d, "region", "r_name").collect()]  # five rows
    return spark.createDataFrame(rows, "r_name string, text string")


@query("text_units", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS units, p_name = '' AS empty, list_sum(list_transform(range(1, length(p_name) + 1), lambda i: CAST(i * ord(substr(p_name, CAST(i AS BIGINT), 1)) AS BIGINT))) AS weighted FROM part")
def units_of_names(spark, d):
    name = F.col("p_name")
    weighted = F.aggregate(F.transform(as_units(name), lambda u, i: u.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", text_units(name).alias("units"), is_empty(name).alias("empty"), weighted.cast("decimal(38,0)").cast("long").alias("weighted"))


@query("upper_median", "SELECT l_returnflag, l_linenumber, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY ALL")
def upper_median(spark, d):
    return ev.upper_median(table(spark, d, "lineitem", "l_returnflag", "l_linenumber", "l_extendedprice"), "l_extendedprice", ["l_returnflag", "l_linenumber"])


@query("upper_median_of_all", "SELECT list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem")
def upper_median_of_all(spark, d):
    return ev.upper_median(table(spark, d, "lineitem", "l_extendedprice"), "l_extendedprice")


short_column("control_escapes", "documents", ["doc_id"], "text", [(1, r"\n"), (2, r"\t"), (3, r"[\r\f]"), (4, r"[^\na-zA-Z]")], [(1, "\n"), (2, "\t"), (3, "[\r\f]"), (4, "[^\na-zA-Z]")], longest=1)
short_column("class_escapes", *_URL, [(1, r"[\]\-/]+"), (2, r"[\^:\\]"), (3, r"[^\-a-z0-9.]+")], [(1, "[-/\\]]+"), (2, "[\\^:\\\\]"), (3, "[^-a-z0-9.]+")])
short_column("case_insensitive_accents", "conversations", _CONV, "text", [(1, "(?i)É"), (2, "(?i)[à-ä]"), (3, "(?i)ß")], [(1, "[éÉ]"), (2, "[à-äÀ-Ä]"), (3, "ß")], longest=1)


@query("case_table_digest", "SELECT '159531a10c144b10e448d7a66786978ba71d86dba966fc89f7191c0592bce4f4' AS sha256, 65536 AS units")
def case_table_digest(spark, d):
    """The fixed digest of the table of cases, in its exchange format."""
    t = symbols.case_table()
    raw = b"RMF1" + len(t).to_bytes(4, "big") + t.astype(">u2").tobytes()
    return spark.createDataFrame([(hashlib.sha256(raw).hexdigest(), len(t))], "sha256 string, units int")


_u = lambda t: [ord(c) for c in t]
#: (case, family, patterns, text, status, events)
_FIXTURES = [
    ("all-starts", "overlap", ["aa"], "aaaa", "matched", [(1, 0, 2), (1, 1, 3), (1, 2, 4)]), ("nested", "overlap", ["abc", "b", "bc"], "abc", "matched", [(1, 0, 3), (2, 1, 2), (3, 1, 3)]),
    ("longest", "choice", ["a|ab|abc"], "abcab", "matched", [(1, 0, 3), (1, 3, 5)]), ("empty-branch", "choice", ["x(|y)"], "xyx", "matched", [(1, 0, 2), (1, 2, 3)]), ("nothing", "choice", ["q"], "abc", "matched", []),
    ("borders", "assertions", [r"\ba", r"a\b", r"\Ba"], "a aa", "matched", [(1, 0, 1), (1, 2, 3), (2, 0, 1), (2, 3, 4), (3, 3, 4)]), ("lines", "assertions", ["^b", "a$"], "a\nba", "matched", [(1, 2, 3), (2, 0, 1), (2, 3, 4)]),
    ("no-text", "edges", ["a*"], "", "matched", []), ("open-class", "rejected", ["a", "[b"], "ab", "rejected", []), ("lazy", "rejected", ["a+?"], "aa", "rejected", []), ("wrong-on-purpose", "edges", ["a"], "a", "matched", []),
]


def fixture_results(spark):
    """(results, expected results) of the cases, read from a file of theirs."""
    import json

    lines = [json.dumps({"schema_version": 1, "case_id": c, "compatibility_tier": f, "expectation": s, "patterns": [{"pattern_id": k, "utf16": _u(p)} for k, p in enumerate(ps, 1)], "input_utf16": _u(t)}) for c, f, ps, t, s, _ in _FIXTURES]
    cases = files.read_fixtures(spark, written(spark.createDataFrame(list(enumerate(lines)), "ordinal int, value string")))
    expected = spark.createDataFrame([(c, s, e) for c, *_, s, e in _FIXTURES], "case_id string, status string, events array<struct<pattern_id: bigint, start: bigint, end: bigint>>")
    return fx.run_cases(cases), expected


@query("fixture_comparison", "SELECT 'wrong-on-purpose' AS case_id, 'different' AS problem")
def fixture_comparison(spark, d):
    return fx.compare(*fixture_results(spark))


def _family(name, rows):
    return f"({name}, {len(rows)}, {sum(r[4] == 'matched' for r in rows)}, {sum(r[4] == 'rejected' for r in rows)}, {sum(len(r[5]) for r in rows) + sum(r[0] == 'wrong-on-purpose' for r in rows)}, {len(rows)}, {sum(r[0] == 'wrong-on-purpose' for r in rows)})"


@query("fixture_totals", "SELECT family, CAST(a AS BIGINT) AS cases, CAST(b AS BIGINT) AS matched, CAST(c AS BIGINT) AS rejected, CAST(d AS BIGINT) AS events, CAST(e AS BIGINT) AS comparisons, CAST(f AS BIGINT) AS differences FROM (VALUES " + ", ".join([_family("NULL", _FIXTURES), *(_family(lit(f), [r for r in _FIXTURES if r[1] == f]) for f in sorted({r[1] for r in _FIXTURES}))]) + ") AS t(family, a, b, c, d, e, f)")
def fixture_totals(spark, d):
    return fx.totals(*fixture_results(spark))


@query("receipts", "SELECT 'run-1' AS run, CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE WHEN r_regionkey > 1 THEN r_name END AS r_name FROM region")
def receipts(spark, d):
    path = folder(spark)
    files.write_receipt(table(spark, d, "region", "r_regionkey", F.expr("CASE WHEN r_regionkey > 1 THEN r_name END AS r_name")), path, run="run-1")
    return spark.read.json(path).select("run", "r_regionkey", "r_name")


@query("cohort_report", "SELECT cohort, CAST(n AS INTEGER) AS patterns, ids AS pattern_ids, 3 AS pattern_count, sha256('1' || chr(9) || 'abc' || chr(10) || '2' || chr(9) || '\\bab' || chr(10) || '3' || chr(9) || 'a*' || chr(10)) AS source_digest FROM (VALUES ('assertion_free', 2, '1,3'), ('assertion_bearing', 1, '2')) AS t(cohort, n, ids)")
def cohort_report(spark, d):
    b = MatcherBuilder().add(1, "abc").add(2, r"\bab").add(3, "a*")
    return pt.cohort_report(spark, b).withColumn("pattern_ids", F.array_join("pattern_ids", ","))


#: 256 patterns with assertions that share five units, by what follows these.
_POLICY = [(k, f"{x}*{y}") for k, (x, y) in enumerate(((x, y) for x in "abcdefghijklmnop" for y in "abcdefghijklmnop"), 1)]


def prefix_matcher():
    b = po.PrefixMatcherBuilder()
    for k, p in _POLICY:
        b.add(k, rf"\Btiona{p}")
    b.add(1000, "retion")
    m = b.build()
    m.min_units = 200
    return m


def policy_sql(only_long: bool) -> str:
    """Places of `tiona` inside a word; how far each pattern goes on there."""
    rx = values((str(k), lit(f"^{p}")) for k, p in _POLICY)
    enough = "length(text) >= 200" if only_long else "true"
    return f"""WITH t AS (SELECT conv_id, turn, text, unnest(range(length(text))) AS i FROM conversations WHERE {enough}),
p AS (SELECT conv_id, turn, i, substr(text, CAST(i + 6 AS BIGINT)) AS rest FROM t WHERE substr(text, CAST(i + 1 AS BIGINT), 5) = 'tiona' AND i > 0 AND {_WORD.format("substr(text, CAST(i AS BIGINT), 1)")})
SELECT conv_id, turn, CAST(r.id AS BIGINT) AS pattern_id, CAST(i AS BIGINT) AS "start", CAST(i + 5 + length(regexp_extract(rest, r.rx)) AS BIGINT) AS "end" FROM p, {rx} AS r(id, rx) WHERE regexp_matches(rest, r.rx)
UNION ALL SELECT conv_id, turn, 1000, CAST(i AS BIGINT), CAST(i + 6 AS BIGINT) FROM t WHERE substr(text, CAST(i + 1 AS BIGINT), 6) = 'retion'"""


def policy(name, how, only_long):
    query(name, policy_sql(only_long))(lambda spark, d: po.scan_with_policy(table(spark, d, "conversations", *_CONV, "text"), prefix_matcher(), how)[0])


policy("policy_specialized", po.REQUIRE_SPECIALIZED, True)
policy("policy_fallback", po.ALLOW_EXACT_FALLBACK, False)


@query("policy_report", f"""SELECT conv_id, turn, '{po.ALLOW_EXACT_FALLBACK}' AS policy, CASE WHEN length(text) < 200 THEN 'exact' ELSE 'assertion_prefix' END AS backend, length(text) >= 200 AS specialized,
  CASE WHEN length(text) < 200 THEN 'input_too_short' END AS reason, length(text) AS input_units, CAST(CASE WHEN length(text) < 200 THEN 0 ELSE (length(text) - length(replace(text, 'tiona', ''))) // 5 END AS BIGINT) AS candidates,
  CAST(CASE WHEN length(text) < 200 THEN 0 ELSE (length(text) + 7) // 8 END AS BIGINT) AS candidate_bytes FROM conversations""")  # fmt: skip
def policy_report(spark, d):
    report = po.scan_with_policy(table(spark, d, "conversations", *_CONV, "text"), prefix_matcher(), po.ALLOW_EXACT_FALLBACK)[1]
    return report.select(*_CONV, "policy", "backend", "specialized", "reason", "input_units", "candidates", "candidate_bytes")


@query("policy_eligibility", "SELECT * FROM (VALUES ('free', 'no_assertion_bearing_patterns', CAST(NULL AS INTEGER)), ('few', 'too_few_assertion_bearing_patterns', 255), ('apart', 'no_shared_five_unit_ascii_prefix', NULL), ('fit', NULL, 256)) AS v(name, problem, found)")
def policy_eligibility(spark, d):
    """Why sets of patterns are not taken, in the order of the tests."""
    out = []
    for name, n, shape in (("free", 300, "word{}"), ("few", 255, r"\bword{:03d}"), ("apart", 256, r"\b{}word"), ("fit", 256, r"\bwords{}")):
        b = po.PrefixMatcherBuilder()
        for k in range(n):
            b.add(k, shape.format(k))
        try:
            out.append((name, None, b.build().assertion_patterns))
        except po.Ineligible as e:
            out.append((name, e.kind, e.found))
    return spark.createDataFrame(out, "name string, problem string, found int")


def flagship(spark, sf_dir):
    """Events of a few patterns over all documents, counted."""
    m = matcher([(1, "the|then"), (2, "[A-Z][a-z]+"), (3, r"\bof\b")])
    return sc.counts(table(spark, sf_dir, "documents", "doc_id", "text"), m).groupBy("pattern_id").agg(F.sum("n").alias("n")).orderBy("pattern_id")
