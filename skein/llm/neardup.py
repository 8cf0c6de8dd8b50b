"""MinHash near-duplicates (operator 9).

A document's set holds its distinct shingles of k lower-cased words.  Sets are
sketched by one-permutation hashing: one hash for each shingle, whose top bits
name a bin and whose minimum fills it; empty bins borrow from others in a random
order of their own (optimal densification).  Bands of the bins give buckets.

Documents with equal sets are merged first, so that a group of exact copies is
one representative.  In each bucket a star of candidate edges joins one hub, the
least id, to the rest, and every edge is confirmed on the full sets.  A star can
miss a link between two members that are both unlike the hub.  So representatives
that share two or more buckets, apart from hubs, whose members are still in
different components are compared across components by an exact prefix filter: of
sets in order of rising shingle frequency, alike ones share one of the first
shingles (a fifth of them and one).  There is no cap on buckets or partners.  With
32 bands of 4 rows, a pair at the threshold of 0.8 meets in fewer than two with a
chance of 1e-6.

Null or wordless texts have an empty set and link with nothing; an empty table
gives no rows.  Long texts are worked through in blocks.  Rows that repeat an id
are one document: they share a component, and each of their texts links.  Rows
without an id are left out.  Only the two columns named are read, so others may
have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._bytes import BASE, SLAB, U64, blocks, gram_hashes, list_array, longs, mix, span_hashes, words
from skein.llm._common import arrow_batches, id_text, prepare, removed, table, written
from skein.llm._graph import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, k: int):
    """For each block of rows: (row of each shingle hash, hash), sorted by both, without repeats, and the number of rows."""
    for _, buf, offsets in blocks(column, SLAB):
        n = len(offsets) - 1
        starts, ends, row = words(buf, offsets)
        h = span_hashes(buf, starts, ends, lower=True)
        grams = gram_hashes(h, k)
        keep = row[: len(grams)] == row[k - 1 :]
        at, grams = row[: len(grams)][keep], grams[keep]
        count = np.bincount(row, minlength=n)
        first = np.searchsorted(row, np.arange(n))
        for size in range(1, k):
            short = np.flatnonzero(count == size)
            whole = np.full(len(short), size, U64)
            for j in range(size):
                whole = mix(whole * U64(BASE) ^ h[first[short] + j])
            at, grams = np.append(at, short), np.append(grams, whole)
        order = np.lexsort((grams, at))
        at, grams = at[order], grams[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (grams[1:] != grams[:-1])
        yield at[new], grams[new], n


def signatures(at: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """The densified one-permutation sketch of each row; rows without shingles stay empty."""
    sig = np.full((n, BINS), EMPTY)
    bins = (grams >> U64(64 - 7)).astype(np.int64)
    cell = at * BINS + bins
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    sig.reshape(-1)[cell[first]] = grams[first]
    full = sig != EMPTY
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        probe = mix(cols.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt * 0xD1B54A32D192ED03 % 2**64)) >> U64(64 - 7)
        probe = probe.astype(np.int64)
        good = full[rows, probe]
        sig[rows[good], cols[good]] = sig[rows[good], probe[good]]
        rows, cols, attempt = rows[~good], cols[~good], attempt + 1
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U64)[None, :] * U64(0xA0761D6478BD642F) + U64(1)
    for r in range(ROWS):
        key = mix(key ^ sig[:, r::ROWS]) + U64(r)
    return key


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            ids, lo = batch.column(0), 0
            for at, grams, n in shingle_sets(batch.column(1), k):
                size = np.bincount(at, minlength=n)
                # two independent sums over the set name it
                a, b = np.zeros(n, U64), np.zeros(n, U64)
                np.add.at(a, at, mix(grams ^ U64(0x5851F42D4C957F2D)))
                np.add.at(b, at, mix(grams + U64(0x14057B7EF767814F)))
                keys = band_keys(signatures(at, grams, n))
                some = size > 0
                flat = pa.array(longs(keys[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(size), pa.array(longs(a)), pa.array(longs(b)), list_array(flat, np.where(some, BANDS, 0))],
                    names=["doc_id", "n_shingles", "s1", "s2", "keys"],
                )
                lo += n

    return run


def _sets(k: int):
    """(doc_id, text) to rep, one (a hash of the set) and set (its shingles in order, as bytes)."""

    def run(batches):
        for batch in batches:
            lo = 0
            for at, grams, n in shingle_sets(batch.column(1), k):
                cuts = np.searchsorted(at, np.arange(n + 1))
                blobs = [grams[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)]
                one = np.zeros(n, U64)
                np.add.at(one, at, mix(grams))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(longs(one)), pa.array(blobs, pa.binary())], names=["rep", "one", "set"])
                lo += n

    return run


def _confirm(percent: int):
    """Edges with both sets to the edges whose sets are alike enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), U64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _shingles(batches):
    """(rep, component, one, set) to a row for each shingle; rows of one id may have several sets, which ``one`` tells apart."""
    for batch in batches:
        size = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False) // 8
        flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
        row = pa.array(np.repeat(np.arange(len(size)), size))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), batch.column(2).take(row), pa.array(np.repeat(size, size), pa.int64()), pa.array(flat)], names=["rep", "component", "one", "size", "shingle"])


def _prefix_pairs(wanted: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): pairs of ``wanted`` (rep, component) across components that share a shingle of their prefixes; and the tables that this reads."""
    rows = written(wanted.join(sets, "rep").select("rep", "component", "one", "set").mapInArrow(_shingles, "rep long, component long, one long, size long, shingle long"), "shingles")
    common = written(rows.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("mixed")), "frequencies")
    order = Window.partitionBy("rep", "one").orderBy("df", "shingle")
    prefix = rows.join(common, "shingle").select("*", F.row_number().over(order).alias("at")).where(f"mixed AND at <= size - ceil({percent} * size / 100.0D - 1e-9D) + 1").select("rep", "component", "size", "shingle", "at")
    prefix = written(prefix, "prefixes")
    x, y = (prefix.select("shingle", F.col("rep").alias(n), F.col("component").alias(f"c{n}"), F.col("size").alias(f"s{n}"), F.col("at").alias(f"at{n}")) for n in "ab")
    # what follows the first shingle that two sets share bounds how many they can share
    enough = f"(1 + least(sa - ata, sb - atb)) * {100 + percent} >= {percent} * (sa + sb)"
    return x.join(y, "shingle").where(f"a < b AND ca <> cb AND {enough}").select("a", "b").distinct(), [rows, common, prefix]


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    with arrow_batches(prepare(docs.sparkSession)):
        return _near_duplicates(docs, k, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    sketched = written(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "sketches")
    some = sketched.where("n_shingles > 0")
    # equal sets are one representative; a written table, unlike one still to be aggregated, lets a join on it split a large group
    reps = written(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "representatives")
    of = some.select("doc_id", "n_shingles", "s1", "s2").join(reps.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "n_shingles", "rep")
    of = written(of.unionByName(sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))), "of")
    # rows of one id with different sets tie the representatives of these
    tied = written(of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("doc_id", "b"), "tied")
    ties = of.join(tied, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()

    buckets = reps.select("rep", F.explode("keys").alias("bucket"))
    hubs = written(buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    members = written(buckets.join(hubs, "bucket").where("rep <> hub"), "members")
    removed(sketched, reps)
    wanted = members.select("rep").unionByName(hubs.select(F.col("hub").alias("rep"))).distinct()
    sets = docs.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_sets(k), "rep long, one long, set binary")
    sets = written(sets.dropDuplicates(["rep", "one"]), "sets")

    def confirmed(edges: DataFrame) -> DataFrame:
        edges = edges.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
        return written(edges.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "links")

    links = confirmed(members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    labels = components(links.unionByName(ties) if tied.take(1) else links)
    # where only the hub and one other meet, nothing is left to compare
    parted = members.where("n > 2").select("bucket", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parted = written(parted, "parted")
    mixed = written(parted.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket"), "mixed")
    left = parted.join(mixed, "bucket").groupBy("rep", "component").agg(F.count("*").alias("n")).where("n > 1").select("rep", "component")
    left = written(left, "left")
    if left.take(1):
        pairs, read = _prefix_pairs(left, sets, percent)
        new = confirmed(pairs)
        removed(*read)
        if new.take(1):
            # the components so far, as stars, stand for all links before
            labels = components(new.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    removed(hubs, members, sets, parted, mixed, left)
    out = of.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM s
  UNION
  SELECT p.y, r.c FROM r JOIN p ON p.x = r.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
