"""Reading vectors and trials; files in ``skein.sources.files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def slice_range(vectors: DataFrame, start: int, count: int) -> DataFrame:
    """Rows [start, start + count); count 0 means all from start.  The range reaches the scan."""
    rows = vectors.where(F.col("vec_id") >= start)
    return rows.where(F.col("vec_id") < start + count) if count else rows


def union_files(parts: list[DataFrame], offsets: list[int]) -> DataFrame:
    """Several files as one relation; ids become global by each file's offset."""
    out = None
    for part, offset in zip(parts, offsets, strict=True):
        part = part.withColumn("gid", F.col("vec_id") + offset)
        out = part if out is None else out.unionByName(part)
    return out


def gather(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "vec_id", "left_semi")


def parse_trials(text: str) -> list[tuple[int, int, int]]:
    """(trial, nc1, nc2) from pairs of lines that a blank line ends; nc1 of 0 is skipped, a negative one stops."""
    out, pair = [], []
    for line in text.split("\n"):
        if line.strip():
            pair.append(int(line))
            continue
        if len(pair) >= 2:
            if pair[0] < 0:
                break
            if pair[0] > 0:
                out.append((len(out), pair[0], pair[1]))
        pair = []
    return out
