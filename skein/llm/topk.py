"""Exact top-k search with multi-resolution segment statistics (operator 5).

Vectors are cut into segments; a segment is summed up by its mean and its
deviation.  For two vectors x, y the squared distance is at least
``sum m*((mean_x-mean_y)**2 + (dev_x-dev_y)**2)`` over the segments of m
distance is an upper bound of the score.  Levels run from one segment to segments of two components; a level
is computed for the candidates that the coarser ones have left to some query of
64, and exact scores for the pairs that are left at the end alone.

Candidates are packed in blocks and dealt to shards of a bounded number of rows,
queries to bounded groups; each shard meets each group in one task, which keeps
a running top k whose k-th score is the bar for the blocks that follow.  The
results of the shards are merged by a grouped top k.

Vectors that are null or empty, or hold null or non-finite components, take no
part; vectors of different lengths are not compared.  Whole numbers of components
are limited to +-2**62, and scores to what a long holds.  Ties go to the smaller
id.  Rows without an id take no part; repeated ids count as separate rows.  Tables
without rows give none.  Only the two columns named are read, so others may have
any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._common import prepare, table, written

ROWS = 4096
GROUP = 4096
SHARD = 1 << 14
FIRST = 256
_PACK = "dim int, ids binary, data binary"


def _pack(rows: int):
    """Rows to blobs of at most ``rows`` vectors of one length, as 64-bit integers."""

    def run(batches):
        kept: dict[int, list] = {}

        def blob(dim, items):
            ids, data = np.array([i for i, _ in items], np.int64), np.stack([v for _, v in items])
            order = np.argsort(ids, kind="stable")
            kind = "<i2" if np.abs(data).max() < 1 << 15 else "<i8"
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([data[order].astype(kind).tobytes()])], names=["dim", "ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                x = np.asarray(v, np.float64)
                items = kept.setdefault(len(x), [])
                items.append((i, np.clip(np.floor(x * 256), -(2.0**62), 2.0**62)))
                if len(items) >= rows:
                    yield blob(len(x), items)
                    kept[len(x)] = []
        for dim, items in kept.items():
            if items:
                yield blob(dim, items)

    return run


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(m)*mean and sqrt(m)*deviation by segment: dot products of these rows bound dot products of x."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(cuts).astype(np.float64)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.concatenate([total / np.sqrt(sizes), np.sqrt(np.maximum(square - total * total / sizes, 0))], axis=1)


def _levels(dim: int) -> list[int]:
    """Numbers of segments from one to half the components."""
    out = [1]
    while out[-1] * 4 < dim // 2:
        out.append(out[-1] * 4)
    return out if dim < 4 else [*out, dim // 2]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of one vector with rows; in doubles where no sum can leave the exact range."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * len(q)
    if top < 1 << 53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if top < 1 << 63:
        return c @ q
    big = np.array([min(max(sum(x * y for x, y in zip(q.tolist(), row, strict=True)), -(2**63)), 2**63 - 1) for row in c.tolist()], object)
    return big.astype(np.int64)


def _best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, by score and then smaller id."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    return order[rank < k]


class _Group:
    """The running top k of one group of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.cuts = _levels(q.shape[1])
        self.levels = [_stats(q.astype(np.float64), s) for s in self.cuts]
        self.bar = np.full(len(ids), -np.inf)
        self.met = 0  # candidates seen
        self.counted = np.zeros(len(self.cuts) + 1, np.int64)  # pairs in all, and left after each level
        self.who, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        if self.met < FIRST:  # nothing to compare with yet: the first candidates are met without bounds
            self._take(np.ones((len(self.ids), min(FIRST, len(ids))), bool), 0, ids[:FIRST], c[:FIRST])
            self.met += min(FIRST, len(ids))
            ids, c = ids[FIRST:], c[FIRST:]
        self.met += len(ids)
        if not len(ids):
            return
        stats = [_stats(c.astype(np.float64), s) for s in self.cuts]
        for lo in range(0, len(self.ids), 64):
            rows = slice(lo, min(lo + 64, len(self.ids)))
            alive = np.ones((rows.stop - lo, len(ids)), bool)
            self.counted[0] += alive.size
            for n, (q, s) in enumerate(zip(self.levels, stats, strict=True)):
                # a level is computed for the candidates that some query of these still has
                at = np.flatnonzero(alive.any(axis=0))
                bound = q[rows] @ s[at].T
                slack = 1e-9 * (np.abs(bound).max(initial=1) + 1) + 0.5
                alive[:, at] &= bound + slack >= self.bar[rows, None]
                self.counted[n + 1] += alive.sum()
            self._take(alive, lo, ids, c)

    def _take(self, alive: np.ndarray, lo: int, ids: np.ndarray, c: np.ndarray) -> None:
        """Exact scores of the pairs that are left, of the queries from ``lo``."""
        who, found, score = [self.who], [self.found], [self.score]
        for i, row in enumerate(alive):
            at = np.flatnonzero(row & (ids != self.ids[lo + i]))
            exact = _exact(self.q[lo + i], c[at])
            good = exact >= self.bar[lo + i]
            who.append(np.full(int(good.sum()), lo + i))
            found.append(ids[at[good]])
            score.append(exact[good])
        who, found, score = np.concatenate(who), np.concatenate(found), np.concatenate(score)
        best = _best(who, score, found, self.k)
        self.who, self.found, self.score = who[best], found[best], score[best]
        count = np.bincount(self.who, minlength=len(self.ids))
        last = np.full(len(self.ids), np.inf)
        np.minimum.at(last, self.who, self.score)
        self.bar = np.maximum(self.bar, np.where(count >= self.k, last, -np.inf))

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.who]), pa.array(self.found), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def _unpack(dim: int, ids, data) -> tuple[np.ndarray, np.ndarray]:
    ids, data = np.frombuffer(ids.as_buffer(), np.int64), data.as_buffer()
    kind = "<i2" if data.size == 2 * dim * len(ids) else "<i8"
    return ids, np.frombuffer(data, kind).reshape(len(ids), dim).astype(np.int64)


def _search(k: int):
    """One running group at a time: rows come sorted by it, and its queries first."""

    def run(batches):
        group = None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, asks, ids, data = (batch.column(name)[row] for name in ("dim", "asks", "ids", "data"))
                if asks.as_py():
                    if group is not None:
                        yield group.rows()
                    group = _Group(*_unpack(dim.as_py(), ids, data), k)
                else:
                    group.add(*_unpack(dim.as_py(), ids, data))
        if group is not None:
            yield group.rows()

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of the highest integer inner product, the query's own id apart."""
    spark = prepare(candidates.sparkSession)

    def usable(df):
        x = F.col("v")
        fine = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)

    # Group and shard numbers grow with the tables, so that no task does.
    shards = -(-candidates.count() // SHARD) or 1
    groups = -(-queries.count() // GROUP) or 1
    rows = usable(candidates).mapInArrow(_pack(ROWS), _PACK).select("dim", "ids", "data", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("r"))
    asked = usable(queries).repartition(groups, "id").mapInArrow(_pack(GROUP), _PACK).select("dim", F.xxhash64("ids").alias("g"), "ids", "data")
    # The stated queries against all rows, in blocks: each group is sent to each shard once, and each block to each group.
    asked = written(asked, "queries").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    plan = rows.join(asked.select("dim", "r", "g"), ["dim", "r"]).select("dim", "g", "r", F.lit(False).alias("asks"), "ids", "data")
    plan = plan.unionByName(asked.select("dim", "g", "r", F.lit(True).alias("asks"), "ids", "data"))
    plan = plan.repartition("dim", "g", "r").sortWithinPartitions("dim", "g", "r", F.desc("asks"))
    found = plan.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
