"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir), and its result is written and read again
as the next one's docs.  All but the last return the columns of documents.

Every stage takes an empty table and gives one.  Null and empty texts are scored as
no text, are near-duplicates of nothing, hold no benchmark passage and no secret, and
count in mixing like all others.  Rows without an id are judged by the classifier, the
secret scan and mixing; the near-duplicates and the decontamination, which name
documents by id, let them stay.  Rows that repeat an id stay or go together there.
Long texts are read whole.  Further columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, mixing, neardup, quality, secrets
from skein.llm._common import table, unused, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id."""
    name = unused(docs, "extra")
    extra = neardup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(extra, F.col("doc_id") == F.col(name), "left_anti")


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return secrets.drop_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in a stream mixed to the target weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", neardup_stage),
    ("decontamination", decontam_stage),
    ("secret scan", secrets_stage),
    ("mixing", mix_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
