"""Files of vectors, pivots, buckets, answers and results, as tables and back.

Small files (pivots, answers, results) are one piece of text each; they are read through Spark, so any of its stores will
do, and cut into rows with SQL functions.  Large tables are Parquet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A pivot element that takes part, and the one that is left out.
EXTREME = 127


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), cells: the lines of one file in order, without empty ones."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return rows.where(F.trim("text") != "").select("line", F.transform(F.split("text", ","), lambda x: F.trim(x)).alias("cells"))


# --- pivots: line 0 holds the type, the number of parts and maybe a rotation, line 1 squared radii, then one centre a line


def read_pivots(spark: SparkSession, path: str) -> DataFrame:
    """p, radius, c: squared radius and centre of each pivot; also of files with a rotation on the first line."""
    rows = _lines(spark, path)
    radii = rows.where("line = 1").select(F.posexplode("cells").alias("p", "r")).select("p", F.col("r").cast("long").alias("radius"))
    centres = rows.where("line > 1").select((F.col("line") - 2).alias("p"), F.transform("cells", lambda x: x.cast("int")).alias("c"))
    return centres.join(radii, "p", "left").select("p", "radius", "c")


def read_projection_pivots(spark: SparkSession, path: str) -> DataFrame:
    """p, c: centres alone; the line of radii is passed over."""
    return read_pivots(spark, path).select("p", "c")


def read_rotation(spark: SparkSession, path: str) -> DataFrame:
    """pos, src: for each axis of the rotated vector the axis that it comes from; no rows for a file without a rotation."""
    rows = _lines(spark, path).where("line = 0").select(F.posexplode(F.slice("cells", 3, 1 << 20)).alias("pos", "src"))
    return rows.where("src <> ''").select("pos", F.col("src").cast("int").alias("src"))


def pivot_type(spark: SparkSession, path: str) -> tuple[int, int]:
    """(type, parts) of a pivot file; one part if none is named."""
    cells = _lines(spark, path).where("line = 0").first()["cells"]
    return int(cells[0]), int(cells[1]) if len(cells) > 1 and cells[1] else 1


def pivot_arrays(pivots: DataFrame) -> tuple[np.ndarray, list[float]]:
    """Centres and radii as an ``Index`` takes them; as many rows as a sketch has bits."""
    rows = sorted(pivots.collect(), key=lambda r: r["p"])
    return np.array([r["c"] for r in rows], np.float64), [float(r["radius"] or 0) if "radius" in r else 0.0 for r in rows]


def pivot_text(pivots: DataFrame, kind: int, parts: int = 1, rotation: list[int] | None = None) -> DataFrame:
    """value: the lines of a pivot file, in order, in one row; without radii (a projection) these are zeros."""
    radius = F.col("radius") if "radius" in pivots.columns else F.lit(0)
    one = pivots.agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce(radius.cast("long"), F.lit(0)).alias("r"), "c"))).alias("x"))
    text = lambda a: F.array_join(F.transform(a, lambda y: y.cast("string")), ",")
    head = ",".join(str(v) for v in (kind, parts, *(rotation or [])))
    return one.select(F.array_join(F.concat(F.array(F.lit(head), text(F.col("x.r"))), F.transform("x", lambda y: text(y["c"]))), "\n").alias("value"))


# --- vectors


def read_ftr(spark: SparkSession, *paths: str) -> DataFrame:
    """vec_id, v: files of a header of four 32-bit numbers (element size, dimension, rows, extra bytes) and rows of bytes with a 32-bit id.

    Each file is one task's work; there should be as many files as the cluster has use for.
    """

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                size, dim, n, extra = (int(x) for x in raw[:16].view("<i4"))
                whole = raw[16 : 16 + n * (size * dim + extra)].reshape(n, size * dim + extra)
                for lo in range(0, n, 65536):
                    part = whole[lo : lo + 65536]
                    v = np.ascontiguousarray(part[:, : size * dim]).view(f"<i{size}").astype(np.int32)
                    ids = np.ascontiguousarray(part[:, size * dim : size * dim + 4]).view("<u4")[:, 0].astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["vec_id", "v"])

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(rows, "vec_id long, v array<int>")


def ftr_files(vectors: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """file, content: quantized vectors (vec_id, v) as the bytes of such files, at most ``rows`` vectors each."""

    def pack(batches):
        held: list = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= rows:
                yield _ftr(held[:rows])
                held = held[rows:]
        if held:
            yield _ftr(held)

    def _ftr(part):
        v = np.array([x for _, x in part], np.int8)
        ids = np.array([[i] for i, _ in part], "<u4").view(np.uint8)
        head = np.array([1, v.shape[1], len(part), 4], "<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([int(part[0][0])]), pa.array([head + np.concatenate([v.view(np.uint8), ids], 1).tobytes()])], names=["file", "content"])

    return vectors.select("vec_id", "v").mapInArrow(pack, "file long, content binary")


# --- buckets


def bucket_tables(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, runs): vec_id by position in the order of sketches, as (sketch, vec_id), and (sketch, n) of the buckets that are not empty."""
    return sketches.select("sketch", "vec_id"), sketches.groupBy("sketch").agg(F.count("*").alias("n"))


def write_buckets(sketches: DataFrame, path: str) -> None:
    """Both tables, clustered by sketch, so that row groups of other buckets are skipped; never over existing ones."""
    for name, rows in zip(("idx", "runs"), bucket_tables(sketches), strict=True):
        rows.repartitionByRange("sketch").sortWithinPartitions(*rows.columns).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_buckets(spark: SparkSession, path: str, form: str = "compact") -> DataFrame:
    """compact: sketch, n of buckets that are not empty; ids: sketch, vec_id."""
    return spark.read.parquet(f"{path}/{'idx' if form == 'ids' else 'runs'}")


def dense_buckets(runs: DataFrame, w: int) -> DataFrame:
    """sketch, n, pos of all 2^w sketches, empty ones too; for the widths of a dense table (w up to 30)."""
    if w > 30:
        raise ValueError("a dense table has 2^w rows; w is at most 30")
    high = max(0, w - 10)
    rows = runs.sparkSession.range(1 << w).select(F.col("id").alias("sketch")).join(runs, "sketch", "left").select("sketch", F.coalesce("n", F.lit(0)).alias("n"), F.shiftright("sketch", high).alias("part"))
    sums = rows.groupBy("part").agg(F.sum("n").alias("m"))  # 1024 rows
    sums = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    here = F.sum("n").over(Window.partitionBy("part").orderBy("sketch")) - F.col("n")
    return rows.withColumn("here", here).join(F.broadcast(sums), "part").select("sketch", "n", (F.col("before") + F.col("here")).alias("pos"))


def bucket_cursor(spark: SparkSession, path: str):
    """(sketch, n) one after the other, in the order of sketches, a partition at a time."""
    for r in read_buckets(spark, path).orderBy("sketch").toLocalIterator():
        yield r["sketch"], r["n"]


# --- answers and results


def read_answers(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """qid, rank, vec_id, dist: the true neighbours, after two lines of headings: number, id, and for each neighbour number, distance and id.

    ``k`` of 1 gives the nearest alone, None all that the file has.
    """
    triple = lambda j: F.struct((j + 1).alias("rank"), F.get("cells", 2 + 3 * j).cast("long").alias("vec_id"), F.get("cells", 3 + 3 * j).cast("double").alias("dist"))
    rows = _lines(spark, path).where("line > 1").withColumn("m", F.expr("cast((size(cells) - 2) div 3 AS int)")).where("m > 0")
    rows = rows.select(F.get("cells", F.lit(1)).cast("long").alias("qid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), triple)).alias("x")).select("qid", "x.*")
    return rows if k is None else rows.where(F.col("rank") <= k)


def answer_text(answers: DataFrame, name: str = "queries") -> DataFrame:
    """value: the lines of such a file, in one row; ids there are counted from 1."""
    by_query = answers.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("x"))
    cells = F.transform("x", lambda y: F.concat(F.lit(", "), y["vec_id"].cast("string"), F.lit(", "), F.format_string("%.6f", y["dist"].cast("double")), F.lit(", "), (y["vec_id"] + 1).cast("string")))
    lines = by_query.select("qid", F.array_join(cells, "").alias("text"), F.size("x").alias("k"))
    one = lines.agg(F.array_sort(F.collect_list(F.struct("qid", "text"))).alias("x"), F.coalesce(F.max("k"), F.lit(0)).alias("k"))
    heads = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: F.format_string(", NN[%d]_idx, NN[%d]_dist, NN[%d]_id", j, j, j))
    head = F.concat(F.lit("q_number, q_id"), F.when(F.col("k") > 0, F.array_join(heads, "")).otherwise(F.lit("")))
    body = F.transform("x", lambda y, i: F.concat(i.cast("string"), F.lit(","), y["qid"].cast("string"), y["text"]))
    return one.select(F.array_join(F.concat(F.array(F.lit(f"answer for {name}"), head), body), "\n").alias("value"))


def _pairs(shift: int) -> Column:
    return F.array_join(F.transform("x", lambda y: F.concat((y["vec_id"] + shift).cast("string"), F.lit(", "), y["dist"].cast("string"))), ",")


def result_lines(found: DataFrame, layout: str = "ids", truth: DataFrame | None = None) -> DataFrame:
    """qid, line: the neighbours of each query (qid, rank, vec_id, dist) in one of three layouts.

    ids: ids from 1; distances: without the truth, ids from 1 and distances; evaluated: the true nearest (qid, vec_id,
    dist) and its distance first, ids from 0; nearest: query, id from 0 and distance of the nearest alone.
    """
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("x"))
    if layout == "ids":
        return rows.select("qid", F.array_join(F.transform("x", lambda y: (y["vec_id"] + 1).cast("string")), ", ").alias("line"))
    if layout == "distances":
        return rows.select("qid", F.concat(F.lit("secret, secret, "), _pairs(1)).alias("line"))
    if layout == "nearest":
        return rows.select("qid", F.concat_ws(",", "qid", F.col("x")[0]["vec_id"], F.col("x")[0]["dist"]).alias("line"))
    if layout != "evaluated":
        raise ValueError(layout)
    truth = truth.select("qid", F.col("vec_id").alias("near"), F.col("dist").alias("far"))
    return rows.join(truth, "qid", "left").select("qid", F.concat(F.concat_ws(",", F.coalesce(F.col("near").cast("string"), F.lit("")), F.coalesce(F.col("far").cast("string"), F.lit(""))), F.lit(","), _pairs(0)).alias("line"))


HEADING = "nearest_idx, nearest_dist, ans_idx[0], ans_dist[0], ans_idx[1], ans_dist[1], ... "


def free_path(spark: SparkSession, path: str) -> str:
    """``path``, or with _1, _2 and so on before its ending, so that nothing is overwritten."""
    stem, dot, ending = path.rpartition(".") if "." in path.rpartition("/")[2] else (path, "", "")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    n, out = 0, path
    while files.exists(spark._jvm.org.apache.hadoop.fs.Path(out)):
        n += 1
        out = f"{stem}_{n}{dot}{ending}"
    return out


def write_results(found: DataFrame, path: str, layout: str = "ids", truth: DataFrame | None = None) -> str:
    """The lines in the order of queries, with a heading where the layout has one; the path that was free."""
    path = free_path(found.sparkSession, path)
    lines = result_lines(found, layout, truth).select("qid", "line")
    if layout in ("distances", "evaluated"):
        lines = found.sparkSession.createDataFrame([(None, HEADING)], "qid long, line string").unionByName(lines)
    lines.orderBy(F.asc_nulls_first("qid")).select("line").write.mode("errorifexists").text(path)
    return path


def write_rows(rows: DataFrame, path: str) -> str:
    """A summary or a table of costs as CSV with a heading; the path that was free."""
    path = free_path(rows.sparkSession, path)
    rows.write.mode("errorifexists").option("header", "true").csv(path)
    return path
