"""Quality classifier: a byte-level convolutional network in numpy (operator 8).

Learned filters run over the bytes of the whole document.  Their responses are
max-pooled over overlapping chunks (512 positions, 256 apart); each chunk gives
a logit, which also knows how full the chunk is, and the mean of a document's chunk logits its one probability.

It is fitted on a bounded sample of labelled rows: ``rows`` (documented
parameter) labelled documents of the smallest hash of the id among those not
held out, less those whose texts would take it beyond ``size`` bytes in all (the
second one).  Each of these is read whole, in all its chunks.  Scoring covers
every byte of every document.  A document is held out if crc32 of its id as text
leaves 1 modulo 3.  Only the text is an input of a score.

Null and empty texts are scored as one window of zero bytes, a text shorter than
a filter is padded with zero bytes.  Without labelled rows of both classes every
score is the share of good labels, or 1 without any label.  An empty table gives
no rows, repeated rows a row each, and long texts are scored in bounded pieces.
Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._bytes import blocks
from skein.llm._common import bounded_batches, id_text, prepare, table

ROWS, BYTES, STRIDE = 4000, 64 << 20, 256
WIDTH, FILTERS, DIMS = 5, 16, 6
SPAN = 2 * STRIDE + WIDTH - 1


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS: embedding times filter, by offset and byte
    shift: np.ndarray
    weight: np.ndarray
    bias: float
    fuller: np.ndarray  # added to weight and bias in proportion to how full a chunk is
    constant: float | None = None


def _logits(m: Model, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
    h = np.tanh(pooled + m.shift)
    return h @ m.weight + m.bias + fill * (h @ m.fuller[:-1] + m.fuller[-1])


def _cells(size: np.ndarray):
    """Of texts of so many bytes (WIDTH at least): cells of STRIDE filter positions in all, and of each chunk its first cell, its last, its text and its fill."""
    valid = size - WIDTH + 1
    cells = -(-valid // STRIDE)
    first = np.concatenate([[0], np.cumsum(cells)])[:-1]
    chunks = np.maximum(cells - 1, 1)
    owner = np.repeat(np.arange(len(size)), chunks)
    lo = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    hi = np.minimum(lo + 1, cells[owner] - 1)
    fill = (np.minimum((hi + 1) * STRIDE, valid[owner]) - lo * STRIDE) / (2 * STRIDE)
    return cells, first[owner] + lo, first[owner] + hi, owner, fill


def _best(tables: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, where) of each filter over each cell, some cells at a time."""
    value, where = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
    for i in range(0, len(starts), 64):
        at = starts[i : i + 64, None] + np.minimum(np.arange(STRIDE)[None, :], lengths[i : i + 64, None] - 1)
        conv = tables[0].take(buf[at], axis=0)
        for k in range(1, WIDTH):
            conv += tables[k].take(buf[at + k], axis=0)
        best = conv.argmax(axis=1)
        value[i : i + 64] = np.take_along_axis(conv, best[:, None, :], 1)[:, 0]
        where[i : i + 64] = np.take_along_axis(at, best, 1)
    return value, where


def fit(texts: list[np.ndarray], y: np.ndarray, steps: int = 900, batch: int = 32, seed: int = 7) -> Model:
    """texts: the bytes of each document, all chunks of which take part; y: 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        return Model(*(np.zeros(0),) * 3, 0.0, np.zeros(1), float(y.mean()) if len(y) else 1.0)
    texts = [t if len(t) >= WIDTH else np.concatenate([t, np.zeros(WIDTH - len(t), np.uint8)]) for t in texts]
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.5, (256, DIMS)),
        "w": rng.normal(0, 0.5, (WIDTH, DIMS, FILTERS)),
        "c": np.full(FILTERS, -1.0),
        "v": rng.normal(0, 0.3, FILTERS),
        "b": np.zeros(1),
        "u": np.zeros(FILTERS + 1),
    }
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    f = np.arange(FILTERS)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(y), batch)
        seen = [texts[i] for i in pick]
        # some documents are seen as a short piece only, so that few bytes are no sign of either class
        for d in np.flatnonzero(rng.random(batch) < 0.4).tolist():
            size = min(len(seen[d]), max(WIDTH, int(np.exp(rng.uniform(np.log(WIDTH), np.log(SPAN))))))
            start = int(rng.integers(0, len(seen[d]) - size + 1))
            seen[d] = seen[d][start : start + size]
        size = np.array([len(t) for t in seen])
        offsets = np.cumsum(size) - size
        cells, lo, hi, owner, fill = _cells(size)
        inside = (np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)) * STRIDE
        buf = np.concatenate([*seen, np.zeros(WIDTH, np.uint8)]).astype(np.intp)
        tables = np.einsum("bd,kdf->kbf", p["e"], p["w"]).astype(np.float32)
        value, where = _best(tables, buf, np.repeat(offsets, cells) + inside, np.minimum(STRIDE, np.repeat(size - WIDTH + 1, cells) - inside))
        pooled = np.maximum(value[lo], value[hi])
        at = np.where(value[lo] >= value[hi], where[lo], where[hi])
        count = np.bincount(owner, minlength=batch)
        h = np.tanh(pooled + p["c"])
        own = p["v"] + fill[:, None] * p["u"][:-1]
        z = np.bincount(owner, (h * own).sum(1) + p["b"][0] + fill * p["u"][-1], batch) / count
        dz = ((1 / (1 + np.exp(-z)) - y[pick]) / batch / count)[owner]
        dm = dz[:, None] * own * (1 - h * h)
        g = {"v": h.T @ dz, "u": np.append(h.T @ (dz * fill), dz @ fill), "b": np.array([dz.sum()]), "c": dm.sum(0)}
        dt = np.stack([np.bincount((buf[at + k] * FILTERS + f).ravel(), dm.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
        g["e"] = np.einsum("kbf,kdf->bd", dt, p["w"])
        g["w"] = np.einsum("bd,kbf->kdf", p["e"], dt)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, grad in g.items():
            grad = grad + 1e-4 * p[k]
            a, b = moment[k]
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    tables = np.einsum("bd,kdf->kbf", p["e"], p["w"]).astype(np.float32)
    return Model(tables, p["c"].astype(np.float32), p["v"].astype(np.float32), float(p["b"][0]), p["u"].astype(np.float32))


def _maxima(m: Model, buf: np.ndarray, cuts: np.ndarray, end: int) -> np.ndarray:
    """Filter maxima over the positions between successive cuts, a bounded piece at a time."""
    out = np.empty((len(cuts), FILTERS), np.float32)
    i = 0
    while i < len(cuts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + (1 << 17))))
        stop = int(cuts[j]) if j < len(cuts) else end
        part = buf[cuts[i] : stop + WIDTH - 1].astype(np.intp)
        n = stop - int(cuts[i])
        conv = m.tables[0].take(part[:n], axis=0)
        for k in range(1, WIDTH):
            conv += m.tables[k].take(part[k : k + n], axis=0)
        out[i:j] = np.maximum.reduceat(conv, cuts[i:j] - cuts[i], axis=0)
        i = j
    return out


def score_block(m: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of each document of a block."""
    n = len(offsets) - 1
    if m.constant is not None:
        return np.full(n, m.constant)
    size = np.diff(offsets)
    logit = np.empty(n)
    for i in np.flatnonzero(size < WIDTH).tolist():
        x = np.zeros(WIDTH, np.uint8)
        x[: size[i]] = buf[offsets[i] : offsets[i + 1]]
        logit[i] = _logits(m, _maxima(m, x, np.array([0]), 1), np.array([1 / (2 * STRIDE)]))[0]
    rows = np.flatnonzero(size >= WIDTH)
    if len(rows):
        valid = size[rows] - WIDTH + 1
        cells = -(-valid // STRIDE)
        first = np.concatenate([[0], np.cumsum(cells + 1)])
        # each document: its cells, then a gap where windows would leave it
        inside = np.arange(first[-1]) - np.repeat(first[:-1], cells + 1)
        gap = inside == np.repeat(cells, cells + 1)
        cuts = np.repeat(offsets[rows], cells + 1) + np.where(gap, np.repeat(valid, cells + 1), inside * STRIDE)
        pooled = _maxima(m, np.concatenate([buf, np.zeros(WIDTH, np.uint8)]), cuts, len(buf))
        # a chunk is two cells; a document of one cell is one chunk
        lone = np.repeat(cells, cells + 1) == 1
        last = inside == np.repeat(cells, cells + 1) - 1
        chunk = ~gap & (~last | lone)
        at = np.flatnonzero(chunk)
        both = np.where(lone[at][:, None], pooled[at], np.maximum(pooled[at], pooled[np.minimum(at + 1, len(pooled) - 1)]))
        width = np.append(np.diff(cuts), 0)
        fill = (width[at] + np.where(lone[at], 0, width[np.minimum(at + 1, len(width) - 1)])) / (2 * STRIDE)
        z = _logits(m, both, fill)
        owner = np.repeat(np.arange(len(rows)), cells + 1)[at]
        logit[rows] = np.bincount(owner, z, len(rows)) / np.bincount(owner, minlength=len(rows))
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = BYTES, label_col: str = "quality") -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, of at most ``size`` bytes in all; each one whole."""
    bounded_batches(prepare(docs.sparkSession))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    # at most ``rows`` rows of four numbers
    found = docs.join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    chosen = []
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= rows and r["size"] <= size:
            rows, size = rows - r["n"], size - r["size"]
            chosen.append((r["doc_id"], r["y"]))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int")
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.encode("text", "UTF-8").alias("text")).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["text"])))
    return fit([np.frombuffer(bytes(r["text"]), np.uint8) for r in sample], np.array([r["y"] for r in sample], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for batch in batches:
            out = [score_block(model, buf, offsets) for _, buf, offsets in blocks(batch.column(1), 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    bounded_batches(prepare(docs.sparkSession))
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose score is at least ``least``."""
    bounded_batches(prepare(docs.sparkSession))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = [score_block(model, buf, offsets) for _, buf, offsets in blocks(batch.column(at), 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(out) >= least)) if out else batch

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
