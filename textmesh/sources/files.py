"""Sources and sinks: pattern lists, corpora, word lists, fixtures, receipts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that a literal pattern escapes.
ESCAPED = "\\.*+?[]()|^$-{}"

FIXTURE = "schema_version int, case_id string, compatibility_tier string, expectation string, patterns array<struct<pattern_id: bigint, utf16: array<int>>>, input_utf16 array<int>"


def read_patterns(spark: SparkSession, path: str, ascii_only: bool = False) -> DataFrame:
    """ordinal, pattern_id and pattern of a file of lines `id<TAB>pattern`.

    A line has exactly one tab, a positive id below 2**32 that no other line
    has, and a pattern that isn't empty; a closing carriage return is dropped.
    The first bad line raises ValueError, and so does a file without lines.
    """
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    value = F.regexp_replace("value", "\r$", "")
    parts = F.split(value, "\t", -1)
    rows = lines.select("ordinal", F.size(parts).alias("n"), parts[0].alias("id"), F.try_element_at(parts, F.lit(2)).alias("pattern")).orderBy("ordinal").collect()
    out, seen = [], set()
    for k, r in enumerate(rows, 1):
        if r.n != 2 or not r.id.isascii() or not r.id.isdigit() or not 0 < int(r.id) < 1 << 32 or not r.pattern:
            raise ValueError(f"line {k} isn't an id, a tab and a pattern")
        if int(r.id) in seen:
            raise ValueError(f"line {k} repeats the id {r.id}")
        if ascii_only and not r.pattern.isascii():
            raise ValueError(f"line {k} isn't ASCII")
        seen.add(int(r.id))
        out.append((k - 1, int(r.id), r.pattern))
    if not out:
        raise ValueError("no patterns")
    return spark.createDataFrame(out, "ordinal int, pattern_id long, pattern string")


def read_corpus(spark: SparkSession, path: str, ascii_only: bool = True) -> DataFrame:
    """Each file as one text; ascii_only raises at the first other one."""
    df = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    if ascii_only:
        df = df.withColumn("text", F.when(F.octet_length("text") == F.length("text"), F.col("text")).otherwise(F.raise_error(F.lit("the corpus isn't ASCII"))))
    return df


def read_word_patterns(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n words of a list in byte order, as literal patterns with the
    ids 1 to n: lines are trimmed, blank and repeated ones dropped."""
    words = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("word")).where("word <> ''").distinct().orderBy("word").limit(n).collect()
    if len(words) < n:
        raise ValueError(f"the list has {len(words)} words, not {n}")
    return spark.createDataFrame([(k, escape(r.word)) for k, r in enumerate(words, 1)], "pattern_id long, pattern string")


def escape(text: str) -> str:
    """The pattern that matches just this text."""
    return "".join({"\n": "\\n", "\t": "\\t", "\r": "\\r", "\f": "\\f"}.get(c, "\\" + c if c in ESCAPED else c) for c in text)


def expand_corpus(text: str, size: int) -> str:
    """The text, repeated up to `size` UTF-8 bytes, cut between characters."""
    if not text:
        raise ValueError("an empty text can't be repeated")
    raw = text.encode()
    return (raw * (size // len(raw) + 1))[:size].decode("utf-8", "ignore")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Strict JSON lines of semantic cases; empty lines don't count.  A line
    that is no such object, lacks a field, has another or one of another type
    raises ValueError with its number.  Fixtures are small: the lines are read
    in order, on the driver."""
    fields = {f.name: f.dataType for f in StructType.fromDDL(FIXTURE).fields}
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    rows = []
    for k, r in enumerate(lines, 1):
        if not r.value:
            continue
        try:
            got = json.loads(r.value)
            if not isinstance(got, dict) or got.keys() != fields.keys():
                raise ValueError(f"the fields are {sorted(got) if isinstance(got, dict) else type(got).__name__}")
            units = [got["input_utf16"], *(p["utf16"] for p in got["patterns"])]
            if any(p.keys() != {"pattern_id", "utf16"} for p in got["patterns"]) or any(type(u) is not int or not 0 <= u < 1 << 16 for x in units for u in x):
                raise ValueError("patterns or units are of another form")
            if type(got["schema_version"]) is not int or any(not isinstance(got[c], str) for c in ("case_id", "compatibility_tier", "expectation")):
                raise ValueError("a field has another type")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"line {k} is no fixture: {e}") from None
        rows.append(tuple([(p["pattern_id"], p["utf16"]) for p in got[c]] if c == "patterns" else got[c] for c in fields))
    return spark.createDataFrame(rows, FIXTURE)


def write_receipt(df: DataFrame, path: str, **facts) -> None:
    """One JSON object for each row, nulls included, with the facts told."""
    df.withColumns({k: F.lit(v) for k, v in facts.items()}).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
