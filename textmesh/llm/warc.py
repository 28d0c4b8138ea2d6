"""Not-modified revisit records resolved to the response they refer to.

A revisit takes the latest response of its canonical URL with an earlier time
(as-of join), if its validators agree: an entity tag is compared weakly, a
modification date exactly, a payload digest exactly; a validator that either
side lacks is not compared, and one difference is a mismatch.  Of the revisit's
headers only `PERMITTED` replace those of the response.

The as-of join works on distinct (URL, time) pairs, which partial aggregates
make.  Times are cut into about sqrt(range) buckets: the latest response of
each (URL, bucket) is found first, a window over a URL's buckets carries it
on, and a window inside (URL, bucket) does the rest.  So one URL with a third
of all records is spread over its buckets, and no window holds more rows than
there are buckets, or seconds in one.

Defined results: a record without URL or time, and a revisit before any
response, stays `unresolved`; of several responses of one URL and second the
largest record_id counts; of rows that repeat a response's record_id the least
in order of validators, headers and payload; repeated revisit rows give repeated
results; null headers are no headers, an empty payload is one; a payload of any
length is passed on whole; times are whole seconds; no records give no rows;
only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmesh.llm.common import checkpoint, partitions

#: Revisits of one response that a task joins with it.
CROWD = 256
#: Header fields that a 304 answer may update (RFC 9110, 15.4.5), and Last-Modified.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, `www.`, default port, tracking parameters and
    closing slash; host in lower case; parameters in order."""
    plain = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(plain, "^[^/?]*", 0), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, "[?](.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def as_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """(url, time, record_id) for each distinct (url, time) of left: the
    record of right with the latest earlier time."""
    marks = right.groupBy("url", "time").agg(F.max("record_id").alias("record_id"))
    asked = left.select("url", "time", F.lit(None).cast("long").alias("record_id"), F.lit(1).alias("asked"))
    points = marks.withColumn("asked", F.lit(0)).unionByName(asked).groupBy("url", "time").agg(F.max("record_id").alias("record_id"), F.max("asked").alias("asked"))
    span = points.agg(F.min("time"), F.max("time")).first()
    width = max(1, math.isqrt(max(1, (span[1] or 0) - (span[0] or 0))))
    points = points.withColumn("bucket", F.floor(F.col("time") / width))
    by_bucket = points.groupBy("url", "bucket").agg(F.max(F.when(F.col("record_id").isNotNull(), F.struct("time", "record_id"))).alias("latest"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_bucket.select("url", "bucket", F.last("latest.record_id", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("url", "bucket").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    near = points.withColumn("near", F.last("record_id", ignorenulls=True).over(inside))
    return near.where("asked = 1").join(carried, ["url", "bucket"]).select("url", "time", F.coalesce("near", "carried").alias("record_id"))


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit record.

    records: record_id long, kind (`response` or `revisit`), uri, time (long,
    seconds), etag, last_modified, digest, headers map<string,string> with
    names in lower case, payload.  Result: record_id, canonical_url, time,
    refers_to, outcome (`resolved`, `mismatch`, `unresolved`), headers and
    payload (null unless resolved).
    """
    r = records.select(F.col("record_id").cast("long").alias("record_id"), "kind", canonical_url(F.col("uri")).alias("url"), F.col("time").cast("long").alias("time"), "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload")
    full = r.where("kind = 'response' and url is not null and time is not null and record_id is not null")
    revisits = r.where("kind = 'revisit'").drop("payload", "kind")
    asked = revisits.where("url is not null and time is not null")
    found = as_of(asked.select("url", "time"), full.select("url", "time", "record_id")).withColumnRenamed("record_id", "refers_to")
    held = full.groupBy("record_id").agg(F.min(F.struct("etag", "last_modified", "digest", F.map_entries("headers").alias("entries"), "payload")).alias("full")).withColumnRenamed("record_id", "refers_to")
    met = checkpoint(revisits.join(checkpoint(found), ["url", "time"], "left"))
    # a response that many revisits refer to is copied, and they are dealt over the copies
    most = partitions(r.sparkSession)
    crowd = met.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowd = checkpoint(crowd.select("refers_to", F.least(F.ceil(F.col("n") / CROWD).cast("int"), F.lit(most)).alias("copies")))
    met = met.join(crowd, "refers_to", "left").withColumn("copy", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id"), "copies").cast("int"))).drop("copies")
    held = held.join(crowd, "refers_to", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    j = met.join(held, ["refers_to", "copy"], "left")
    wrong = _differs(_weak(F.col("etag")), _weak(F.col("full.etag"))) | _differs(F.col("last_modified"), F.col("full.last_modified")) | _differs(F.col("digest"), F.col("full.digest"))
    outcome = F.when(F.col("refers_to").isNull(), "unresolved").when(wrong, "mismatch").otherwise("resolved")
    new = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    old = F.map_filter(F.map_from_entries("full.entries"), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    ok = F.col("outcome") == "resolved"
    return j.withColumn("outcome", outcome).select(
        "record_id", F.col("url").alias("canonical_url"), "time", "refers_to", "outcome",
        F.when(ok, F.map_concat(old, new)).alias("headers"), F.when(ok, F.col("full.payload")).alias("payload"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Web captures made of `pages`, for the query: nine pages of ten (page_id
    mod 10 is not 3) are responses at minute page_id; every page is asked for
    again 5,000 minutes later.  The second answer repeats the page's validators,
    but for page_id mod 4 = 0 it has another entity tag, for 1 none."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day-"), F.floor(F.col("page_id") / 1440).cast("string"))
    first = pages.where("page_id % 10 <> 3").select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), (F.col("page_id") * 60).alias("time"),
        tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day, F.lit("etag"), tag).alias("headers"), F.col("html").alias("payload"),
    )
    told = F.when(F.col("page_id") % 4 == 0, F.lit('"other"')).when(F.col("page_id") % 4 != 1, F.concat(F.lit("W/"), tag))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url").alias("uri"), ((F.col("page_id") + 5000) * 60).alias("time"),
        told.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/none"), F.lit("date"), F.concat(day, F.lit("-again"))).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def op5_warc_revisits(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    r = resolve_revisits(captures(pages))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return r.select(
        ((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "canonical_url", "time", F.expr("cast(refers_to div 2 as bigint)").alias("refers_to"), "outcome",
        F.array_join(entries, ";").alias("headers"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.md5("payload").alias("payload_md5"),
    )


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain FROM pages
), c AS (
  SELECT page_id, html, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day-' || CAST(page_id // 1440 AS VARCHAR) AS day,
    regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '[?](.*)$', 1), '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_'))), '&') AS query
  FROM u
), d AS (
  SELECT page_id, html, tag, day, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url FROM c
), full_ AS (
  SELECT canonical_url, page_id * 60 AS time, max(page_id) AS rid FROM d WHERE page_id % 10 <> 3 GROUP BY ALL
), again AS (
  SELECT page_id, canonical_url, (page_id + 5000) * 60 AS time, day,
    CASE WHEN page_id % 4 = 0 THEN '"other"' WHEN page_id % 4 <> 1 THEN tag END AS told FROM d
), j AS (
  SELECT a.*, (SELECT max_by(f.rid, f.time) FROM full_ f WHERE f.canonical_url = a.canonical_url AND f.time < a.time) AS refers_to FROM again a
), k AS (
  SELECT j.*, d.html, d.tag, d.day AS old_day,
    CASE WHEN refers_to IS NULL THEN 'unresolved' WHEN told IS NOT NULL AND told <> d.tag THEN 'mismatch' ELSE 'resolved' END AS outcome
  FROM j LEFT JOIN d ON d.page_id = j.refers_to
)
SELECT page_id, canonical_url, time, refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || day || '-again;etag=' || tag END AS headers,
  CASE WHEN outcome = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS payload_bytes,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
FROM k
"""
