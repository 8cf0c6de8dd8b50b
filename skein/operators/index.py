"""Pivots, sketches, buckets, projections and codes of a table of vectors."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import functions as X
from skein.config import SearchConfig
from skein.functions import kernels


def medians(rows: DataFrame, key: str, value: str) -> list[float]:
    """The median of value for each key, in the order of keys: exact, from counts of distinct values."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    got = counted.groupBy(key).agg(F.percentile(value, 0.5, F.col("n")).alias("m")).orderBy(key).collect()
    return [float(r["m"]) for r in got]


class Index:
    """What the driver holds is bounded by the configuration: pivots, radii, quantizer parameters and the lowest vectors.

    Vectors of another length, and those that hold null or non-finite elements, are left out (``table`` still has them).
    Pivots are the vectors of the lowest ids, unless given as arrays (such as ``skein.sources.pivots`` reads); a table of
    fewer vectors uses them again, and an empty one gives empty results.

    With ``store``, a folder that all executors share, everything that a search reads is computed once and written there,
    clustered by sketch: one pass over the vectors, and then only scans of the columns that are needed.
    """

    def __init__(self, vectors: DataFrame, config: SearchConfig = SearchConfig(), store: str | None = None, pivots: np.ndarray | None = None, radii: list[float] | None = None, parts: np.ndarray | None = None):
        self.config, self.store, self.table = config, store, vectors
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        self.raw = vectors.where((F.size("embedding") == config.dim) & ~odd & F.col("vec_id").isNotNull())
        given = {"pivots": pivots, "radii": radii, "parts": parts}
        self.__dict__.update({k: v for k, v in given.items() if v is not None})

    @cached_property
    def _quantized(self) -> DataFrame:
        return self.raw.select(F.col("vec_id").cast("long").alias("vec_id"), X.quantize(F.col("embedding"), self.config.factor).alias("v"))

    @cached_property
    def _measured(self) -> DataFrame:
        """vec_id, v, d, s: in one pass, and written if there is a store"""
        c = self.config
        rows = kernels.measured(self._quantized, self.pivots, self.parts, [c.axes(p) for p in range(c.parts)])
        return self._stored(rows, "measured")

    @cached_property
    def _built(self) -> DataFrame:
        """vec_id, v, d, s, sketch, c: clustered by sketch if there is a store"""
        rows = self._measured.select("vec_id", "v", "d", "s", self._sketch().alias("sketch"), self._coded().alias("c"))
        return self._stored(rows.repartitionByRange("sketch").sortWithinPartitions("sketch", "vec_id") if self.store else rows, "built")

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        if not self.store:
            return rows
        rows.write.mode("errorifexists").parquet(f"{self.store}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.store}/{name}")

    @cached_property
    def vectors(self) -> DataFrame:
        """vec_id, v"""
        return self._built.select("vec_id", "v") if self.store else self._quantized

    @cached_property
    def lowest(self) -> list:
        """The vectors of the lowest ids, as many as queries or pivots need."""
        c = self.config
        return self._quantized.orderBy("vec_id").limit(max(c.nq, c.w + c.parts)).collect()

    def _asked(self, rows: DataFrame) -> DataFrame:
        """The rows of the queries: the lowest ids; their number is a parameter."""
        return rows.where(F.col("vec_id").isin([r["vec_id"] for r in self.lowest[: self.config.nq]]))

    @cached_property
    def queries(self) -> DataFrame:
        """qid, qv"""
        rows = [(r["vec_id"], r["v"]) for r in self.lowest[: self.config.nq]]
        return self.raw.sparkSession.createDataFrame(rows, "qid long, qv array<int>")

    @cached_property
    def axis_medians(self) -> list[float]:
        return medians(self._quantized.select(F.posexplode("v").alias("j", "x")), "j", "x") or [0.0] * self.config.dim

    def centres(self, first: int, n: int) -> np.ndarray:
        """Pivot centres: n of the lowest vectors, each axis at its extreme on the side of the median."""
        if not self.lowest:
            return np.full((n, self.config.dim), 127.0)
        rows = [self.lowest[(first + k) % len(self.lowest)]["v"] for k in range(n)]
        return np.where(np.array(rows) < np.array(self.axis_medians), -127, 127).astype(np.float64)

    @cached_property
    def pivots(self) -> np.ndarray:
        return self.centres(0, self.config.w)

    @cached_property
    def distances(self) -> DataFrame:
        """vec_id, d: squared distance to each pivot"""
        return self._built.select("vec_id", "d") if self.store else kernels.pivot_distances(self._quantized, self.pivots)

    @cached_property
    def radii(self) -> list[float]:
        rows = self._measured if self.store else self.distances
        return medians(rows.select(F.posexplode("d").alias("p", "x")), "p", "x") or [0.0] * self.config.w

    def _sketch(self) -> Column:
        r = F.transform(F.arrays_zip(F.col("d"), X.array(self.radii).alias("r")), lambda x: F.when(x["d"] < x["r"], F.lit(1)).otherwise(F.lit(0)))
        return F.aggregate(r, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("p")), lambda a, x: F.struct((a["s"] + F.call_function("shiftleft", x.cast("long"), a["p"])).alias("s"), (a["p"] + 1).alias("p")), lambda a: a["s"])

    @cached_property
    def sketches(self) -> DataFrame:
        """vec_id, sketch: bit p tells whether a vector is within radius p"""
        return self._built.select("vec_id", "sketch") if self.store else self.distances.select("vec_id", self._sketch().alias("sketch"))

    @cached_property
    def buckets(self) -> DataFrame:
        """sketch, n: the buckets that are not empty"""
        rows = self.sketches.groupBy("sketch").agg(F.count("*").alias("n"))
        return self._stored(rows, "buckets")

    @cached_property
    def query_distances(self) -> DataFrame:
        return self._asked(self.distances).withColumnRenamed("vec_id", "qid")

    def context(self, power: float = 1.0) -> DataFrame:
        """qid, sketch, bd (distance to each boundary, truncated), rank (of each pivot by bd)"""
        w = self.config.w
        rows = self.query_distances.withColumn("r", X.array(self.radii))
        near = "abs(sqrt(d[p]) - sqrt(r[p]))"
        rows = rows.withColumn("bd", F.expr(f"transform(sequence(0, {w - 1}), p -> cast({near if power == 1 else f'pow({near}, {power}D)'} AS int))"))
        rows = rows.withColumn("by", F.expr("array_sort(transform(bd, (x, p) -> struct(x AS b, p AS p)))"))
        rows = rows.withColumn("rank", F.expr(f"transform(sequence(0, {w - 1}), p -> cast(array_position(transform(by, x -> x.p), p) AS int) - 1)"))
        return rows.select("qid", self._sketch().alias("qs"), "bd", "rank")

    @cached_property
    def priorities(self) -> DataFrame:
        """qid, sketch, n and what orders buckets: prio, pinf, ham, pt, high.  The stated queries against all buckets."""
        w = self.config.w
        rows = self.buckets.join(F.broadcast(self.context()), F.lit(True)).withColumn("m", F.expr("sketch ^ qs"))
        rows = rows.select("qid", "sketch", "n", "m", "bd", "rank", X.bits("m", "bd", w).alias("prio"), X.bits("m", "bd", w, "max").alias("pinf"), F.bit_count("m").cast("long").alias("ham"), X.permuted("m", "rank", w).alias("pt"))
        high = F.expr(f"aggregate(sequence(0, {w - 1}), 0L, (a, p) -> if(getbit(m, p) = 1 AND rank[p] >= 3, a + bd[p], a))")
        return rows.select("qid", "sketch", "n", "prio", "pinf", "ham", "pt", high.alias("high"))

    @cached_property
    def members(self) -> DataFrame:
        """qid, vec_id and the order of its bucket"""
        return self.priorities.join(self.sketches, "sketch")

    @cached_property
    def parts(self) -> np.ndarray:
        return self.centres(self.config.w, self.config.parts)

    @cached_property
    def projections(self) -> DataFrame:
        """vec_id, s: the truncated distance to each projection pivot, over its axes"""
        c = self.config
        if self.store:
            return self._built.select("vec_id", "s")
        return kernels.pivot_distances(self._quantized, self.parts, [c.axes(p) for p in range(c.parts)], root=True).withColumnRenamed("d", "s")

    @cached_property
    def quantizer(self) -> tuple[float, float, float, float]:
        """avg, deviation, slice and offset, from the queries' projections"""
        c = self.config
        x = self._asked(self._measured if self.store else self.projections).select(F.explode("s").alias("x"))
        r = x.agg(F.count("*").alias("n"), F.sum("x").alias("a"), F.sum(F.col("x") * F.col("x")).alias("b")).first()
        if not r["n"]:
            return 0.0, 0.0, 0.0, 0.0
        avg = r["a"] / r["n"]
        sd = max(r["b"] / r["n"] - avg * avg, 0.0) ** 0.5
        return avg, sd, 2 * c.q_range * sd / c.codes, avg - c.q_range * sd

    def _code(self, x: str, codes: int, slice_: float, offset: float) -> str:
        inner = f"cast(greatest(cast({x} AS double) - {offset!r}D, 0.0D) / {slice_!r}D AS long)" if slice_ else "0L"
        return f"cast(least({codes - 1}L, {inner}) AS int)"

    def _coded(self) -> Column:
        _, _, slice_, offset = self.quantizer
        return F.expr(f"transform(s, x -> {self._code('x', self.config.codes, slice_, offset)})")

    @cached_property
    def codes(self) -> DataFrame:
        """vec_id, c: the code of each projection"""
        return self._built.select("vec_id", "c") if self.store else self.projections.select("vec_id", self._coded().alias("c"))

    @cached_property
    def tables(self) -> DataFrame:
        """qid, t: for each part and code the truncated power of the distance to the middle of the code's cell"""
        c, (_, _, slice_, offset) = self.config, self.quantizer
        cell = f"((k + 0.5D) * {slice_!r}D + {offset!r}D)"
        t = F.expr(f"transform(s, x -> transform(sequence(0, {c.codes - 1}), k -> cast(pow(abs(cast(cast(x AS double) - {cell} AS long)), {c.p2}D) AS long)))")
        return self._asked(self.projections).select(F.col("vec_id").alias("qid"), t.alias("t"))

    def first(self, rows: DataFrame, n: int, *order: str) -> DataFrame:
        """The n first rows of each query."""
        by = Window.partitionBy("qid").orderBy(*(F.expr(o) for o in order))
        return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)

    def whole_buckets(self, rows: DataFrame, n: int, order: str = "prio", weight: str = "n") -> DataFrame:
        """Whole levels of ``order`` until their weights reach n."""
        levels = rows.groupBy("qid", order).agg(F.sum(weight).alias("m"))
        levels = levels.withColumn("cum", F.sum("m").over(Window.partitionBy("qid").orderBy(order))).where(F.col("cum") - F.col("m") < n)
        return rows.join(levels.select("qid", order), ["qid", order])

    def second(self, candidates: DataFrame) -> DataFrame:
        """candidates with d2, the table distance of the codes"""
        rows = candidates.select("qid", "vec_id").join(self.codes, "vec_id").join(F.broadcast(self.tables), "qid")
        return rows.select("qid", "vec_id", self._table_distance())

    def rerank(self, candidates: DataFrame, k: int) -> DataFrame:
        """qid, rank, vec_id, dist: the k nearest of the candidates"""
        rows = candidates.select("qid", "vec_id").join(self.vectors, "vec_id").join(F.broadcast(self.queries), "qid")
        rows = rows.select("qid", "vec_id", X.l2sq(F.col("qv"), F.col("v")).alias("dist"))
        return self.first(rows, k, "dist", "vec_id").select("qid", "rank", "vec_id", "dist")

    def exact(self, k: int) -> DataFrame:
        got = self.queries.orderBy("qid").collect()  # as many as the parameter nq says
        if not got:
            return self.queries.selectExpr("qid", "cast(0 AS int) AS rank", "qid AS vec_id", "0L AS dist")
        found = kernels.nearest(self.vectors, np.array([r["qid"] for r in got], np.int64), np.array([r["qv"] for r in got], np.float64), k)
        return self.first(found, k, "dist", "vec_id").select("qid", "rank", "vec_id", "dist")

    def double_filter(self, nc1: int | None = None, nc2: int | None = None) -> DataFrame:
        """qid, rank, vec_id, d2: the nc2 best by table distance among the buckets that reach nc1"""
        kept = self.whole_buckets(self.priorities, nc1 or self.config.nc1).select("qid", "sketch")
        if not self.store:
            return self.first(self.second(kept.join(self.sketches, "sketch")), nc2 or self.config.nc2, "d2", "vec_id")
        # the sketch, the codes and the id stand in one row: one scan of three columns
        rows = kept.join(self._built.select("sketch", "vec_id", "c"), "sketch").join(F.broadcast(self.tables), "qid")
        return self.first(rows.select("qid", "vec_id", self._table_distance()), nc2 or self.config.nc2, "d2", "vec_id")

    def _table_distance(self) -> Column:
        return F.expr("aggregate(transform(c, (k, p) -> t[p][k]), 0L, (a, x) -> a + x)").alias("d2")

    def search(self) -> DataFrame:
        return self.rerank(self.double_filter(), self.config.k)
