"""Connected components of links.

Each task first joins the links it holds into stars by itself, so that up to
``LINKS`` links, the most that one task gets, need nothing more.  While the stars
of several tasks meet, alternating large-star and small-star steps follow; both
are a grouped minimum and a join.  The minima are written before they are joined,
so that the join can split the edges of a node that has very many.  The edges in
hand are written to the shared folder after each step, and nothing but counts
reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._common import removed, written

LINKS = 1 << 20
_EDGES = "a long, b long"


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id that it reaches) over the links a[i], b[i], without the least ids themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while True:
        x, y = least[a], least[b]
        differ = x != y
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(least, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (least[least] != least).any():
            least = least[least]
    some = least != np.arange(len(ids))
    return ids[some], ids[least[some]]


def _stars_of_task(batches):
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    a, b = local_stars(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether each id has one edge up at most, and none if there are edges up to it."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    most = ends.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0))).first()[0]
    return (most or 0) <= 1


def _alternate(edges: DataFrame) -> DataFrame:
    # large star: each neighbour above a node is tied to the least of the node and its neighbours
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = written(large, "large-stars")
    # small star: a node and its neighbours below it are tied to the least of them
    below = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "stars")
    removed(edges, least, large, below)
    return out


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """id, component: the smallest id that can be reached, for each id of a link (a, b) but the smallest ones themselves."""
    links = links.where("a <> b").select(*(F.col(c).cast("long").alias(c) for c in "ab"))
    # a bound on the links of a task: each part holds its share of the links, whatever the number of tasks before
    parts = -(-links.count() // most)
    dealt = links.coalesce(1) if parts <= 1 else links.repartition(2 * parts)
    edges = written(dealt.mapInArrow(_stars_of_task, _EDGES), "stars")
    while parts > 1 and not _are_stars(edges):
        edges = _alternate(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
