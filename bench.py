"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from textmesh import queries as Q  # noqa: E402
from textmesh.operators import scan as sc  # noqa: E402
from textmesh.plans.matcher import MatcherBuilder  # noqa: E402
from textmesh.sources import generators  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session():
    s = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def dictionary(spark, n):
    """Patterns of the n first distinct words of the documents, in byte order."""
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w")).where(F.length("w") > 3).distinct().orderBy("w").limit(n)
    return [(k, r.w) for k, r in enumerate(words.collect(), 1)]


def timed(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 3)


def scenario(spark, make, n, size, parts):
    """A generated text, as four rows for each part of the cluster (64 MiB on
    eight); throughput counts the texts' bits over the scan.  Cold: workers
    have the matcher, but no states yet."""
    patterns, text, events = make(n, size)
    m = MatcherBuilder().add_all(patterns).build()
    df = spark.range(4 * parts, numPartitions=parts).withColumn("text", F.lit(text))
    bits = len(text) * 8 * 4 * parts / 1e6
    cold = timed(sc.counts(df, m))
    s = timed(sc.counts(df, m))
    return s, round(bits / s, 1), round(bits / cold, 1)


def main():
    spark = session()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    out, mbit, cold = {}, {}, {}
    Q.flagship(spark, SF).collect()
    for name in ("doc_counts", "membership", "literal_all_starts", "word_boundary", "many_patterns", "case_insensitive_class", "top_patterns", "leftmost_longest"):
        timed(Q.QUERIES[name](spark, SF))
        out[name] = timed(Q.QUERIES[name](spark, SF))
    t = time.time()
    Q.flagship(spark, SF).collect()
    out["flagship"] = round(time.time() - t, 3)
    words = dictionary(spark, 1000)
    plain = MatcherBuilder().add_all(words).build()
    bound = MatcherBuilder().add_all([(k, rf"\b{w}\b") for k, w in words]).build()
    for name, m in (("words_1000", plain), ("bound_words_1000", bound)):
        timed(sc.counts(docs, m))
        out[name] = timed(sc.counts(docs, m))
        mbit[name] = round(size * 8 / out[name] / 1e6, 1)
    parts = int(CPUS)
    for name, make, n in (("literal_sparse_10000", generators.literal_sparse, 10_000), ("literal_dense_10000", generators.literal_dense, 10_000), ("mixed_sparse_10000", generators.mixed_sparse, 10_000), ("word_assertions_1000", generators.word_assertions, 1000)):
        out[name], mbit[name], cold[name] = scenario(spark, make, n, 2 << 20, parts)
    sf = re.search(r"sf([0-9.]+)", SF)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "mbit_per_s": mbit, "cold_mbit_per_s": cold, "sf": float(sf[1]) if sf else SF}))


if __name__ == "__main__":
    main()
