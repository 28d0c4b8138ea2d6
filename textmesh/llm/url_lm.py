"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models over characters, of the accepted and of the
rejected URLs, are smoothed by Witten-Bell interpolation from the empty
context up to `order` characters.  A URL's score is the difference of its log
likelihoods, divided by its length; a threshold on it is calibrated on the
part of the labelled URLs that the models don't learn from.

Everything is DataFrame operations: characters are exploded into n-grams of
full order, counted with partial aggregates, and probabilities are worked out
once for each distinct n-gram; a hot n-gram, host or URL is then one row of a
table, and the join back to the URLs is one that adaptive execution can split.

Defined results: a null URL, and one without `://`, has empty host and path
and no rule, and is scored like the text it is (null: the empty text); rows
that repeat are judged alike; a URL of any length is scored over all its
characters, which travel with a number, not with the URL; of thresholds that
tie the lowest counts; if either class has no URLs to learn or to calibrate
from, the threshold is 0 and unlabelled URLs are allowed at 0 or more; no pages
give no rows.  Only page_id and url are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import checkpoint

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER = 3
#: Labelled URLs whose MD5 begins with one of these digits calibrate; the others train.
CALIBRATE = "012"
#: Bins of the calibration's histogram for each unit of score, and its range.
BINS, RANGE = 200, 20
#: Characters that a model reserves probability for.
ALPHABET = 65536

_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, empty without `://`."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(text: Column, order: int) -> Column:
    """The n-grams of order + 1 characters that end at each character of the
    text and at its end mark."""
    padded = F.concat(F.lit(_START * order), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def ratio_table(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) for each row (gram, accepted, rejected): the difference of
    the log probabilities of its last character after the others.

    The counts of shorter grams are sums over the longer ones' first
    characters.  Each order's probabilities are a table of its distinct grams,
    made of two joins, and kept before the next order is worked out."""
    names = ("accepted", "rejected")
    counts = {order: grams}
    for k in range(order - 1, -1, -1):
        counts[k] = checkpoint(counts[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(*(F.sum(c).alias(c) for c in names)))
    shorter = None
    for k in range(order + 1):
        now = counts[k].withColumn("context", F.substring("gram", 1, k))
        contexts = checkpoint(now.groupBy("context").agg(*(F.sum(c).alias(f"t_{c}") for c in names), *(F.count_if(F.col(c) > 0).alias(f"d_{c}") for c in names)))
        t = now.join(contexts, "context")
        if k:
            t = t.withColumn("end", F.substring("gram", 2, k)).join(shorter.withColumnRenamed("gram", "end"), "end")
        else:
            t = t.withColumns({f"p_{c}": F.lit(1.0 / ALPHABET) for c in names})
        made = [F.when(F.col(f"t_{c}") > 0, (F.col(c) + F.col(f"d_{c}") * F.col(f"p_{c}")) / (F.col(f"t_{c}") + F.col(f"d_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in names]
        shorter = checkpoint(t.select("gram", *made))
    return shorter.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score from which calibration URLs are best accepted: where the sum
    of both classes' hit rates is greatest, the lowest such bin.  scored has
    columns score and accepted; the histogram has at most 2*BINS*RANGE+1 bins."""
    bin_ = F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(-BINS * RANGE)), F.lit(BINS * RANGE))
    hist = scored.groupBy(bin_.alias("bin")).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).orderBy("bin").collect()
    yes, no = sum(r.yes for r in hist), sum(r.no for r in hist)
    if not yes or not no:
        return 0.0
    best, at, missed, caught = -1.0, 0.0, 0, 0
    for r in hist:  # accept from this bin on
        gain = (yes - missed) / yes + caught / no
        if gain > best + 1e-12:
            best, at = gain, r.bin / BINS
        missed, caught = missed + r.yes, caught + r.no
    return float(at)


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold for every page."""
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", F.coalesce("url", F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    role = F.when(F.col("hit").isNull(), 0).when(F.substring(F.md5("text"), 1, 1).isin(*CALIBRATE), 1).otherwise(2)
    base = base.withColumn("role", role).withColumn("accepted", F.col("hit.verdict") == "allow")
    texts = checkpoint(base.groupBy("text").agg(F.count("*").alias("times"), F.first("role").alias("role"), F.first("accepted").alias("accepted"))).withColumn("id", F.monotonically_increasing_id())
    train = F.when(F.col("role") == 2, F.col("times")).otherwise(0)
    exploded = texts.where("role = 2").select(F.explode(_grams(F.col("text"), order)).alias("gram"), train.alias("n"), "accepted")
    counted = exploded.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(~F.col("accepted"), F.col("n")).otherwise(0)).alias("rejected"))
    asked = texts.select("id", F.explode(_grams(F.col("text"), order)).alias("gram"))
    # grams of the other URLs count nothing, but have a probability
    wanted = asked.select("gram", F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("rejected"))
    known = counted.unionByName(wanted.distinct()).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    ratios = ratio_table(checkpoint(known), order)
    # a URL's characters carry its number, not its text
    sums = asked.groupBy("id", "gram").agg(F.count("*").alias("n")).join(ratios, "gram").groupBy("id").agg(F.round(F.sum(F.col("ratio") * F.col("n")) / F.sum("n"), 6).alias("score"))
    scores = checkpoint(texts.join(sums, "id").select("text", "times", "role", "accepted", "score"))
    cut = threshold(scores.where("role = 1").select("score", "accepted"))
    judged = base.join(scores.select("text", "score"), "text")
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score", F.lit(cut).alias("threshold"))


def op2_url_filter(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql(order: int = ORDER) -> str:
    """The same judgement as DuckDB SQL."""
    rules = ", ".join("('{}', '/{}', '{}')".format(*r.split("/", 1), v) for v, r in RULES)
    steps, before = [], ("CAST(1 AS DOUBLE) / 65536", "CAST(1 AS DOUBLE) / 65536")
    for k in range(order + 1):
        end, ctx = f"substr(x.gram, {order - k + 1}, {k + 1})", f"substr(x.gram, {order - k + 1}, {k})"
        steps.append(f"""e{k} AS (SELECT substr(gram, {order - k + 1}, {k + 1}) AS e, sum(a) AS a, sum(r) AS r FROM t GROUP BY 1),
c{k} AS (SELECT substr(e, 1, {k}) AS c, sum(a) AS ta, sum(r) AS tr, count(*) FILTER (a > 0) AS da, count(*) FILTER (r > 0) AS dr FROM e{k} GROUP BY 1),
p{k} AS (SELECT x.gram, CASE WHEN ta > 0 THEN (e.a + da * {before[0]}) / (ta + da) ELSE {before[0]} END AS pa, CASE WHEN tr > 0 THEN (e.r + dr * {before[1]}) / (tr + dr) ELSE {before[1]} END AS pr
  FROM {'t' if k == 0 else f'p{k - 1}'} x JOIN e{k} e ON e.e = {end} JOIN c{k} c ON c.c = {ctx})""")
        before = ("x.pa", "x.pr")
    return f"""WITH u AS (
  SELECT page_id, coalesce(url, '') AS text, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages
), h AS (
  SELECT page_id, text, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), hits AS (
  SELECT h.*, r.own || r.tail AS rule, r.verdict FROM h LEFT JOIN (VALUES {rules}) AS r(own, tail, verdict) ON (h.host = r.own OR ends_with(h.host, '.' || r.own)) AND starts_with(h.path, r.tail)
  QUALIFY row_number() OVER (PARTITION BY h.page_id, h.text ORDER BY length(r.own || r.tail) DESC NULLS LAST) = 1
), texts AS (
  SELECT text, count(*) AS times, any_value(CASE WHEN verdict IS NULL THEN 0 WHEN substr(md5(text), 1, 1) IN ('0', '1', '2') THEN 1 ELSE 2 END) AS role, any_value(verdict = 'allow') AS accepted FROM hits GROUP BY text
), g AS (
  SELECT text, substr(repeat(chr(2), {order}) || text || chr(3), CAST(i AS BIGINT), {order + 1}) AS gram, CASE WHEN role = 2 AND accepted THEN times ELSE 0 END AS a, CASE WHEN role = 2 AND NOT accepted THEN times ELSE 0 END AS r
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM texts)
), t AS (
  SELECT gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY gram
), {", ".join(steps)},
scores AS (
  SELECT text, round(sum(ln(pa) - ln(pr)) / count(*), 6) AS score FROM g JOIN p{order} USING (gram) GROUP BY text
), hist AS (
  SELECT greatest(least(floor(score * {BINS}), {BINS * RANGE}), -{BINS * RANGE}) AS bin, count(*) FILTER (accepted) AS yes, count(*) FILTER (NOT accepted) AS no FROM texts JOIN scores USING (text) WHERE role = 1 GROUP BY 1
), gains AS (
  SELECT bin, sum(yes) OVER () AS yes, sum(no) OVER () AS no, coalesce(sum(yes) OVER b, 0) AS missed, coalesce(sum(no) OVER b, 0) AS caught FROM hist WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT coalesce((SELECT bin / {BINS} FROM gains WHERE yes > 0 AND no > 0 ORDER BY round((yes - missed) / yes + caught / no, 10) DESC, bin LIMIT 1), 0) AS threshold
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score, CAST(threshold AS DOUBLE) AS threshold FROM hits JOIN scores USING (text), cut"""


OP2_SQL = _sql()
