"""Windows of L consecutive units (words or bytes), and the anchors that name them.

A window's anchor is the least hash among its runs of k units.  Equal windows
have equal anchors, and neighbouring windows mostly share one, so a document has
far fewer anchors than windows.  An anchor that only one document has rules out
all its windows.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._bytes import BYTE, blocks, gram_hashes, longs, sliding_min, span_hashes, words
from skein.llm._common import freed_shuffles, partitions, written


@dataclass(frozen=True)
class Unit:
    """What windows are made of: ``size`` units a window, anchors from runs of ``gram`` units."""

    words: bool
    size: int
    gram: int


@dataclass
class Block:
    """The windows of a block of rows that lie within one row."""

    first: int  # of the batch's rows
    buf: np.ndarray
    offsets: np.ndarray
    symbols: np.ndarray
    cuts: np.ndarray  # of symbols, by row
    at: np.ndarray  # first symbol of each window
    bounds: np.ndarray  # of windows, by row
    runs: np.ndarray  # first window of each run of neighbours in a row that share an anchor
    run_row: np.ndarray
    run_anchor: np.ndarray

    def spread(self, of_runs: np.ndarray) -> np.ndarray:
        """A value of each run, for each window."""
        return np.repeat(of_runs, np.diff(np.append(self.runs, len(self.at))))


def windows(column: pa.Array, unit: Unit):
    for first, buf, offsets in blocks(column):
        n = len(offsets) - 1
        if unit.words:
            starts, ends, row = words(buf, offsets)
            symbols, cuts = span_hashes(buf, starts, ends), np.searchsorted(row, np.arange(n + 1))
        else:
            symbols, cuts = BYTE[buf], offsets
        least = sliding_min(gram_hashes(symbols, unit.gram), unit.size - unit.gram + 1)
        count = np.maximum(np.diff(cuts) - unit.size + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(bounds[-1]) + np.repeat(cuts[:-1] - bounds[:-1], count)
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = least[1:] != least[:-1]
        new[bounds[:-1][count > 0]] = True
        runs = np.flatnonzero(new)
        yield Block(first, buf, offsets, symbols, cuts, at, bounds, runs, np.searchsorted(bounds, runs, side="right") - 1, least[runs])


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """(h, doc_id): the anchors of each document, without repeats within a block."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in windows(batch.column(1), unit):
                order = np.lexsort((b.run_row, b.run_anchor))
                h, row = b.run_anchor[order], b.run_row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(longs(h[new])), pa.array(ids[b.first + row[new]], pa.int64())], names=["h", "doc_id"])

    return docs.mapInArrow(run, "h long, doc_id long")


def buckets(docs: DataFrame, each: int = 1 << 26) -> int:
    """Buckets for the anchors of ``docs``: as many as shuffle partitions, more where the texts have over ``each`` bytes for one."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(spark), min(size // each, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))))


def write_run(anchored: DataFrame, spark: SparkSession, n: int, ordered: bool = True) -> str:
    """An immutable run: a table in ``n`` buckets of h, one file each, ``ordered`` by h.  Runs join each other without a shuffle."""
    name = f"skein_run_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        rows = anchored.repartition(n, "h").write.bucketBy(n, "h")
        (rows.sortBy("h", "doc_id") if ordered else rows).saveAsTable(name)
    return name


@contextmanager
def runs_in_order(spark: SparkSession):
    """Within this block, the order of a run's files counts, so that a merge join does not sort them."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def with_anchors(docs: DataFrame, found: DataFrame, name: str, *more: Column) -> DataFrame:
    """(doc_id, text, hs, and aggregates ``more``): the documents that have rows (doc_id, h) in ``found``, with these; a written table."""
    lists = found.groupBy("doc_id").agg(F.collect_list("h").alias("hs"), *more)
    return written(docs.join(lists, "doc_id").select("doc_id", "text", *lists.columns[1:]), name, "zstd")


def candidate_windows(batch: pa.RecordBatch, unit: Unit):
    """For each block of (doc_id, text, hs): the block and which of its runs have an anchor among hs."""
    lists = batch.column(2)
    flat, off = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    off = off - off[0]
    for b in windows(batch.column(1), unit):
        hit = np.zeros(len(b.runs), bool)
        cuts = np.searchsorted(b.run_row, np.arange(len(b.offsets)))
        for r in range(len(b.offsets) - 1):
            lo, hi = cuts[r], cuts[r + 1]
            if lo < hi:
                mine = np.sort(flat[off[b.first + r] : off[b.first + r + 1]])
                at = np.searchsorted(mine, b.run_anchor[lo:hi])
                at[at == len(mine)] = 0
                hit[lo:hi] = mine[at] == b.run_anchor[lo:hi]
        yield b, hit
