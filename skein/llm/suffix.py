"""Suffix-array dedup by the difference-cover algorithm (operator 3).

Bytes covered by a 50-byte string that also starts in an earlier document are
removed.  Only strings whose anchor (see ``_windows``) two documents have can
repeat; neighbouring strings of one anchor form a segment, and equal segments
are one.  Segments are dealt out by anchor, so equal strings meet; those of an
anchor with many documents are cut further, and dealt out, by a second anchor.
Equal segments become one in each task before they are dealt out, and again after.
Each task sorts the suffixes of its segments, some megabytes of whole anchors at a time:
suffixes at positions that are no multiple of three are sorted by their triples,
named, and sorted by recursion on the names; the others follow from one byte and
the rank of their successor, and both lists are merged.  Neighbours in the suffix
array with 50 equal bytes are one string, whose first document is the least.

Rows without an id have no place in the order and are left out.  A null text is
empty.  Rows that repeat an id are one document: none precedes another.  An empty
table gives one, texts of any length are read whole, and further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._bytes import U64, blocks, gram_hashes, list_array, longs, mix, sliding_min, span_hashes
from skein.llm._common import id_text, prepare, removed, table, written
from skein.llm._windows import Block, Unit, anchors, buckets, candidate_windows, with_anchors, write_run

BYTES = Unit(words=False, size=50, gram=20)
PIECE = 1 << 18
PILE = 1 << 16  # documents of an anchor for each part that its segments are dealt into
HELD = 1 << 25  # bytes of segments in which a task looks for equal ones before they are dealt out


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, names from 1, number of names)."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    names = np.empty(len(k), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * (int(b.max(initial=0)) + 1) + b


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of symbols >= 1."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:].tolist())), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # one sample past the end keeps the two halves of the names apart
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = int(t.max()) + 1
    if top < 1 << 20:
        keys = (t[sample] * top + t[sample + 1]) * top + t[np.minimum(sample + 2, n + 2)]
        if top**3 < 1 << 31:
            keys = keys.astype(np.int32)
    else:
        keys = _pairs(_names(_pairs(t[sample], t[sample + 1]))[1], t[np.minimum(sample + 2, n + 2)])
    order, names, count = _names(keys)
    if count < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sa = sample[order]
    sa = sa[sa < n]
    zero = np.arange(0, n, 3)
    k1 = _pairs(t[zero], rank[zero + 1])
    by = np.argsort(k1)
    zero = zero[by]
    is_one = sa % 3 == 1
    a, b = sa[is_one], sa[~is_one]
    # sort keys for either comparison, over all suffixes at once so that they compare
    base = int(rank.max()) + 1
    z1, s1 = t[zero] * base + rank[zero + 1], t[a] * base + rank[a + 1]
    head = np.concatenate([t[zero] * top + t[zero + 1], t[b] * top + t[b + 1]])
    if top >= 1 << 15:
        head = _names(head)[1]
    z2, s2 = head[: len(zero)] * base + rank[zero + 2], head[len(zero) :] * base + rank[b + 2]
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + np.searchsorted(s1, z1) + np.searchsorted(s2, z2)] = zero
    before = np.empty(len(sa), np.int64)
    before[is_one] = np.searchsorted(z1, s1)
    before[~is_one] = np.searchsorted(z2, s2)
    out[np.arange(len(sa)) + before] = sa
    return out


def first_documents(joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments lie in ``joined``, each followed by a byte that is none of theirs.

    (positions, documents): where strings of ``size`` bytes start, in order, and the
    least document of each string over all segments.
    """
    symbols = joined.astype(np.int64) + 2
    symbols[starts + lengths] = 1  # no byte
    sa = suffix_array(symbols)
    owner = np.repeat(np.arange(len(starts)), lengths + 1)
    whole = (starts + lengths)[owner] - np.arange(len(joined)) >= size
    sa = sa[whole[sa]]
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    words = np.ndarray(len(joined), np.uint64, padded, strides=(1,)).copy()  # the eight bytes from each place on
    equal = np.ones(max(0, len(sa) - 1), bool)
    for lo in (*range(0, size - 7, 8), size - 8):
        word = words[sa + lo]
        equal &= word[1:] == word[:-1]
    least = np.empty(len(joined), np.int64)
    if len(sa):
        runs = np.flatnonzero(np.concatenate([[True], ~equal]))
        least[sa] = np.repeat(np.minimum.reduceat(firsts[owner[sa]], runs), np.diff(np.append(runs, len(sa))))
    at = np.flatnonzero(whole)
    return at, least[at]


def _keys(buf: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two independent hashes of each segment."""
    return pa.array(longs(span_hashes(buf, a, z))), pa.array(longs(span_hashes(255 - buf, a, z)))


def _stretches(b: Block, hit: np.ndarray, frequent: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, row and key of each segment; ``frequent`` has (h, parts) of anchors that are dealt into parts."""
    first, last = b.runs[hit], np.append(b.runs[1:], len(b.at))[hit] - 1
    row, key = b.run_row[hit], b.run_anchor[hit]
    items = frequent.slice(b.first, len(b.offsets) - 1).flatten()
    if not len(items):
        return first, last, row, key
    hs, at = np.unique(pc.struct_field(items, "h").to_numpy(zero_copy_only=False).view(U64), return_index=True)
    parts = pc.struct_field(items, "parts").to_numpy(zero_copy_only=False)[at]
    at = np.minimum(np.searchsorted(hs, key), len(hs) - 1)
    parts = np.where(hs[at] == key, parts[at], 1).astype(U64)
    second = sliding_min(gram_hashes(b.symbols, unit.gram, 1), unit.size - unit.gram + 1)
    length = last - first + 1
    owner = np.repeat(np.arange(len(first)), length)
    window = np.arange(len(owner)) + np.repeat(first - (np.cumsum(length) - length), length)
    part = second[b.at[window]] % parts[owner]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    cut = np.flatnonzero(new)
    owner, part = owner[cut], part[cut]
    return window[cut], window[np.append(cut[1:], len(window)) - 1], row[owner], np.where(part > 0, mix(key[owner] + part), key[owner])


def _combined(pieces):
    """Rows (h, doc_id, segment) to (h, segment, first, last), with equal segments of some megabytes as one."""
    held, size = [], 0

    def flush():
        rows = pa.Table.from_batches(held).group_by(["h", "segment"]).aggregate([("doc_id", "min"), ("doc_id", "max")])
        return rows.select(["h", "segment", "doc_id_min", "doc_id_max"]).rename_columns(["h", "segment", "first", "last"]).combine_chunks().to_batches()

    for piece in pieces:
        held.append(piece)
        size += piece.nbytes
        if size > HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _segments(unit: Unit, place: bool):
    """(doc_id, text, hs, frequent) to segments: (h, segment, first, last), or (k1, k2, doc_id, start)."""

    def each(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b, hit in candidate_windows(batch, unit):
                if not hit.any():
                    continue
                first, last, row, key = _stretches(b, hit, batch.column(3), unit)
                who = pa.array(ids[b.first + row], pa.int64())
                a, z = b.at[first], b.at[last] + unit.size
                if place:
                    yield pa.RecordBatch.from_arrays([*_keys(b.buf, a, z), who, pa.array(a - b.offsets[row])], names=["k1", "k2", "doc_id", "start"])
                else:
                    raw = b.buf.tobytes()
                    pieces = [raw[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(longs(key)), who, pa.array(pieces, pa.binary())], names=["h", "doc_id", "segment"])

    return each if place else lambda batches: _combined(each(batches))


def _sorted_strings(size: int):
    """Rows (h, segment, first, last) sorted by h to rows (k1, k2, runs): stretches of strings whose first document is earlier than ``last``."""

    def solve(rows: pa.Table):
        lengths, raw = [], []
        for chunk in rows["segment"].chunks:
            _, off, data = chunk.buffers()
            off = np.frombuffer(off, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            lengths.append(np.diff(off).astype(np.int64))
            raw.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]])
        lengths, raw = np.concatenate(lengths), np.concatenate(raw)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        joined = np.zeros(len(raw) + len(lengths), np.uint8)
        joined[np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)] = raw
        firsts, lasts = rows["first"].to_numpy(), rows["last"].to_numpy()
        at, least = first_documents(joined, starts, lengths, firsts, size)
        owner = np.searchsorted(starts, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        cut = np.flatnonzero(new)
        end = at[np.append(cut[1:], len(at)) - 1] + 1
        good = least[cut] < lasts[owner[cut]]
        cut, end = cut[good], end[good]
        count = np.bincount(owner[cut], minlength=len(starts))
        begin = starts[owner[cut]]
        runs = pa.StructArray.from_arrays([pa.array(at[cut] - begin), pa.array(end - begin), pa.array(least[cut])], fields=list(kind))
        some = pa.array(count > 0)
        out = pa.RecordBatch.from_arrays([*_keys(joined, starts, starts + lengths), list_array(runs, count)], names=["k1", "k2", "runs"])
        return out.filter(some)

    kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64())])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            h = held["h"].to_numpy()
            last = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last anchor may go on
            step = max(1, len(h) * PIECE // max(1, held.nbytes))
            lo = 0
            while lo < last:
                hi = min(last, int(np.searchsorted(h, h[min(lo + step, last)])))
                hi = hi if hi > lo else min(last, int(np.searchsorted(h, h[lo], side="right")))
                yield solve(held.slice(lo, hi - lo))
                lo = hi
            held = held.slice(lo)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _cut(batches):
    """(doc_id, text, spans) to doc_id, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        rows, lists = [], batch.column(2)
        for first, buf, offsets in blocks(batch.column(1)):
            raw = buf.tobytes()
            for r in range(len(offsets) - 1):
                text, spans, end = raw[offsets[r] : offsets[r + 1]], 0, 0
                parts, removed = [], 0
                if lists[first + r].is_valid:
                    items = lists[first + r].values
                    for a, b in sorted(zip(items.field(0).to_pylist(), items.field(1).to_pylist(), strict=True)):
                        if a > end or not spans:
                            parts.append(text[end:a])
                            spans += 1
                            removed += b - a
                            end = b
                        elif b > end:
                            removed += b - end
                            end = b
                parts.append(text[end:])
                rows.append((len(text), removed, spans, b"".join(parts)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_suffixes(docs: DataFrame, unit: Unit = BYTES, pile: int = PILE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row."""
    spark = prepare(docs.sparkSession)
    docs = id_text(docs).where(F.col("doc_id").isNotNull())
    n = buckets(docs)
    run = write_run(anchors(docs, unit), spark, n, ordered=False)
    rows = spark.table(run)
    # distinct anchors spread evenly, so a bucket's share of them is bounded like its texts (see ``buckets``): a map holds it
    met = rows.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), (F.count("*") / pile).cast("long").alias("parts")).where("x < y")
    frequent = F.collect_list(F.when(F.col("parts") > 0, F.struct("h", (F.col("parts") + 1).alias("parts")))).alias("frequent")
    found = with_anchors(docs, rows.join(met.hint("shuffle_hash"), "h").select("doc_id", "h", "parts"), "suffix-candidates", frequent)
    spark.sql(f"DROP TABLE IF EXISTS {run}")
    # dealt out by h first, so that grouping by (h, segment) needs no shuffle of its own
    dealt = found.mapInArrow(_segments(unit, False), "h long, segment binary, first long, last long").repartition(n, "h")
    alike = dealt.groupBy("h", "segment").agg(F.min("first").alias("first"), F.max("last").alias("last")).sortWithinPartitions("h")
    strings = written(alike.mapInArrow(_sorted_strings(unit.size), "k1 long, k2 long, runs array<struct<a:long,b:long,first:long>>"), "strings")
    places = found.mapInArrow(_segments(unit, True), "k1 long, k2 long, doc_id long, start long")
    spans = places.join(strings.hint("merge"), ["k1", "k2"]).select("doc_id", "start", F.explode("runs").alias("x")).where("doc_id > x.first")
    spans = spans.select("doc_id", (F.col("start") + F.col("x.a")).alias("a"), (F.col("start") + F.col("x.b") + (unit.size - 1)).alias("b"))
    spans = written(spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    removed(found, strings)
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), m AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), f AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g JOIN m USING (g) WHERE doc_id > first
), r AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR before + 50 < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f
), s AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, k
), t AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS cut, count(*) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(cut, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN t.doc_id IS NULL THEN sha256(unhex(x)) ELSE sha256(unhex(
    array_to_string(list_transform(range(0, len(a) + 1), lambda j:
      substr(x, 2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END + 1, 2 * (CASE WHEN j = len(a) THEN n ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))), ''))) END AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
