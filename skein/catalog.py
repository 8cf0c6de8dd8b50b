"""The registered queries and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from skein import sources
from skein.operators.index import Index
from skein.plans import oracle
from skein.plans.queries import QUERIES


def _ready(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver was started elsewhere."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_INDEXES: dict = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's vectors: where executors share ``spark.checkpoint.dir`` it is built and stored once in a session, else computed anew."""
    _ready(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    vectors = sources.read_vectors(spark, f"{sf_dir}/embeddings.parquet")
    if not shared:
        return Index(vectors)
    key = (spark.sparkContext.applicationId, shared, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = Index(vectors, store=f"{shared}/skein-index/{uuid.uuid4().hex}")
    return _INDEXES[key]


def _run(f: Callable[[Index], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(index(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(QUERIES["rerank_knn"], spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
