"""Substring dedup with a log-structured fingerprint index (operator 4).

The index holds sorted immutable runs of fingerprints of earlier documents, at
first one run for each batch.  Fingerprints are the anchors of 13-word windows (see
``_windows``), a fifth as many as windows, and without loss: equal windows have
equal anchors.  A new batch's run is merge-joined with the earlier runs and with
itself; as runs are bucketed and sorted by fingerprint this needs no shuffle.
Where an anchor is met again, all windows that it names are verified: their
128-bit fingerprints, of two independent hashes of its words, are compared between
the batch and the documents that were met.  When a level holds ``FANOUT`` runs they
become one run of the next level, so a row is rewritten once a level.

A window counts as seen if an earlier batch has it, or a document of the same
batch with a smaller id.  Rows without an id have no place in this order and are
left out.  A null text has no words.  Rows that repeat an id are one document:
none of them precedes another.  An empty table gives one, texts of any length are read
whole, and further columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._bytes import gram_hashes, longs, span_hashes, words
from skein.llm._common import id_text, prepare, removed, table, written
from skein.llm._windows import Unit, anchors, buckets, candidate_windows, runs_in_order, windows, with_anchors, write_run

WORDS = Unit(words=True, size=13, gram=5)
FANOUT = 4
EARLIER = -(2**63)


class FingerprintIndex:
    """Give it batches with ``add``; each returns what is new in its documents."""

    def __init__(self, spark: SparkSession, unit: Unit = WORDS):
        self.spark, self.unit = prepare(spark), unit
        self.levels: list[list[str]] = [[]]
        self.buckets = 0
        self.docs: list[DataFrame] = []

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of the batch."""
        docs = id_text(docs).where(F.col("doc_id").isNotNull())
        self.buckets = self.buckets or buckets(docs)
        run = write_run(anchors(docs, self.unit), self.spark, self.buckets)
        new = self.spark.table(run)
        met = new.groupBy("h").agg((F.min("doc_id") < F.max("doc_id")).alias("again"))
        for i, old in enumerate(self.runs):
            met = met.join(self.spark.table(old).groupBy("h").agg(F.lit(True).alias(f"in{i}")), "h", "left")
        again = F.coalesce("again", F.lit(False))
        for i in range(len(self.runs)):
            again = again | F.col(f"in{i}").isNotNull()
        met = met.where(again).select("h")
        with runs_in_order(self.spark):
            mine = with_anchors(docs, new.join(met, "h").select("doc_id", "h"), "batch-candidates")
        prints, used = self._prints(mine, False), [mine]
        if self.runs:
            theirs = [self.spark.table(old).join(met, "h").select("doc_id", "h") for old in self.runs]
            found = theirs[0]
            for t in theirs[1:]:
                found = found.unionByName(t)
            history = self.docs[0]
            for d in self.docs[1:]:
                history = history.unionByName(d)
            with runs_in_order(self.spark):
                theirs = with_anchors(history, found, "history-candidates")
            prints = prints.unionByName(self._prints(theirs, True))
            used.append(theirs)
        seen = prints.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("f1", "f2", "first")
        seen = written(seen, "seen")
        flagged = self._prints(mine, False).join(seen, ["f1", "f2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("f1").alias("prints"))
        flagged = written(flagged, "flagged")
        removed(seen, *used)
        self.levels[0].append(run)
        self.docs.append(docs)
        self.compact()
        return docs.join(flagged, "doc_id", "left").select("doc_id", "text", "prints").mapInArrow(self._keep(), "doc_id long, n_words long, n_removed long, kept binary")

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next."""
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= FANOUT:
                rows = self.spark.table(full[0])
                for name in full[1:]:
                    rows = rows.unionByName(self.spark.table(name))
                merged = write_run(rows, self.spark, self.buckets)
                self._drop(full)
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
            level += 1

    def close(self) -> None:
        """Remove the runs."""
        self._drop(self.runs)
        self.levels = [[]]

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _prints(self, found: DataFrame, earlier: bool) -> DataFrame:
        unit = self.unit

        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for b, hit in candidate_windows(batch, unit):
                    at = b.at[b.spread(hit)]
                    row = np.searchsorted(b.cuts, at, side="right") - 1
                    starts, ends, _ = words(b.buf, b.offsets)
                    f1 = gram_hashes(b.symbols, unit.size)[at]
                    f2 = gram_hashes(span_hashes(255 - b.buf, starts, ends), unit.size, 1)[at]
                    who = np.full(len(at), EARLIER) if earlier else ids[b.first + row]
                    yield pa.RecordBatch.from_arrays([pa.array(longs(f1)), pa.array(longs(f2)), pa.array(who, pa.int64())], names=["f1", "f2", "doc_id"])

        return found.select("doc_id", "text", "hs").mapInArrow(run, "f1 long, f2 long, doc_id long")

    def _keep(self):
        unit = self.unit

        def run(batches):
            for batch in batches:
                lists, rows = batch.column(2), []
                for b in windows(batch.column(1), unit):
                    prints = longs(gram_hashes(b.symbols, unit.size))
                    raw = b.buf.tobytes()
                    for r in range(len(b.offsets) - 1):
                        kept = raw[b.offsets[r] : b.offsets[r + 1]].split()
                        n = len(kept)
                        flagged = lists[b.first + r]
                        if flagged.is_valid:
                            at = b.at[b.bounds[r] : b.bounds[r + 1]]
                            at = at[np.isin(prints[at], flagged.values.to_numpy())] - b.cuts[r]
                            edge = np.zeros(n + 1, np.int64)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + unit.size, -1)
                            kept = list(compress(kept, (np.cumsum(edge)[:n] == 0).tolist()))
                        rows.append((n, n - len(kept), b" ".join(kept)))
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

        return run


def dedup_substrings(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the documents given to an index in ``batches`` ranges of ascending ids."""
    spark = docs.sparkSession
    docs = id_text(docs)
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index, out = FingerprintIndex(spark), None
    lo, hi = (0, 0) if lo is None else (lo, hi)
    cuts = [lo + (hi + 1 - lo) * i // batches for i in range(batches + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = index.add(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
        out = part if out is None else out.unionByName(part)
    index.close()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s
), m AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN m USING (g) WHERE doc_id > first
), n AS (
  SELECT doc_id, count(*) AS n, list(k) AS k FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: k IS NULL OR NOT list_contains(k, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""
