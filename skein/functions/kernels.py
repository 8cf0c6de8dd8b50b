"""Numpy kernels over Arrow batches: one pass over the vectors, no shuffle.

The small side (pivots, queries) is bounded by the configuration and travels
with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def pivot_distances(vectors: DataFrame, centres: np.ndarray, ranges: list[tuple[int, int]] | None = None, root: bool = False) -> DataFrame:
    """(vec_id, d): squared distances to each centre, over all axes or those of its range; with ``root``, their truncated roots."""
    dim = centres.shape[1]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if ranges is None:
                d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
            else:
                d = np.stack([((x[:, s : s + n] - c[s : s + n]) ** 2).sum(1) for c, (s, n) in zip(centres, ranges, strict=True)], 1)
            d = np.floor(np.sqrt(d)) if root else d
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.rint(d).astype(np.int64))], names=["vec_id", "d"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, d array<long>")


def measured(vectors: DataFrame, pivots: np.ndarray, parts: np.ndarray, ranges: list[tuple[int, int]]) -> DataFrame:
    """(vec_id, v, d, s): in one pass the squared distances to the pivots, and the truncated distances to the parts over their ranges."""
    dim = pivots.shape[1]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
            s = np.floor(np.sqrt(np.stack([((x[:, a : a + n] - c[a : a + n]) ** 2).sum(1) for c, (a, n) in zip(parts, ranges, strict=True)], 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_lists(np.rint(y).astype(np.int64)) for y in (d, s))], names=["vec_id", "v", "d", "s"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<int>, d array<long>, s array<long>")


def nearest(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(qid, vec_id, dist): each task's k nearest of every query, ties to the smaller id; to be merged by a grouped top k."""
    dim = queries.shape[1]

    def run(batches):
        best_d, best_i = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                x = _matrix(part.column(1), dim)
                d = np.rint((queries * queries).sum(1)[:, None] - 2 * queries @ x.T + (x * x).sum(1)[None, :]).astype(np.int64)
                d = np.concatenate([best_d, d], 1)
                i = np.concatenate([best_i, np.broadcast_to(part.column(0).to_numpy(), (len(ids), part.num_rows))], 1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])), pa.array(best_i.reshape(-1)), pa.array(best_d.reshape(-1))], names=["qid", "vec_id", "dist"])

    return vectors.select("vec_id", "v").mapInArrow(run, "qid long, vec_id long, dist long")
