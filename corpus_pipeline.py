"""Five corpus operators in a row over `documents`.

Each stage takes the rows that its predecessor kept; all but the last return
the columns of documents, whatever others there are and whatever their names.

Defined results: a null or empty text passes toxicity (unless the model's
constant says otherwise) and decontamination, is one group with the other texts
without words in near-dedup, loses nothing in substring dedup and has no ids.
Of near-duplicates the document with the smallest doc_id stays; rows that
repeat it stay with it, and a row without doc_id only if its group has none.
Repeated rows are otherwise judged alike.  Texts of any length go whole.  An
empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmesh.llm.common import checkpoint_base
from textmesh.llm.decontam import drop_contaminated
from textmesh.llm.simhash import drop_near_duplicates
from textmesh.llm.spiece import encode_checked
from textmesh.llm.substring import strip_repeats
from textmesh.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are cut out."""
    out = strip_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return encode_checked(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Models and fingerprints have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written to the shared folder, so
    that a lost executor costs one stage's tasks at most.  A stage's input is
    removed once its result is written; what the last stage reads stays."""
    base = f"{checkpoint_base(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                _remove(spark, f"{base}/{k - 1}")
    return docs
