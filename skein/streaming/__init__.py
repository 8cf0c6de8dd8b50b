"""Queries that arrive as a stream, against a static index (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from skein.operators.index import Index


def search_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch (vec_id, embedding) of queries is searched exactly; results go to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        n = rows.count()
        if not n:
            return
        own = Index(index.raw, index.config)
        asked = Index(rows, index.config)
        own.queries = asked.vectors.selectExpr("vec_id AS qid", "v AS qv")
        sink(own.exact(index.config.k), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
