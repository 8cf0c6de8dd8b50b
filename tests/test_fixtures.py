"""Odd tables of vectors, and files of pivots, vectors, buckets, answers and results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import functions as X
from skein.config import SearchConfig
from skein.operators.index import Index
from skein.plans.queries import QUERIES
from skein.sources import files

SMALL = SearchConfig(dim=8, w=4, parts=4, nq=3, nc1=20, nc2=10, k=5)


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def near(vectors, q, k, factor=220.0):
    whole = [np.clip(np.trunc(np.float32(v) * np.float32(factor)), -127, 127).astype(int) for v in vectors]
    return sorted((int(((whole[q] - w) ** 2).sum()), i) for i, w in enumerate(whole))[:k]


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_tables_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)) * 0.3
    x = Index(table(spark, v, 1000), SMALL)
    got = x.exact(5).orderBy("qid", "rank").collect()
    assert [(r["dist"], r["vec_id"] - 1000) for r in got if r["qid"] == 1000] == (near(v, 0, 5) if n else [])
    found = x.search().collect()
    assert len({r["qid"] for r in found}) == min(n, 3) and all(r["rank"] <= 5 for r in found)
    assert QUERIES["enum_sketches"](x).count() <= 3 * 16 and QUERIES["summary"](x).count() == 1


def test_ties_go_to_the_smaller_id(spark):
    v = np.repeat(np.random.default_rng(1).normal(size=(10, 8)) * 0.3, 2, axis=0)
    got = Index(table(spark, v), SMALL).exact(5).where("qid = 1").orderBy("rank").collect()
    assert [r["vec_id"] for r in got[:2]] == [0, 1] and got[0]["dist"] == got[1]["dist"] == 0


def test_a_distance_equal_to_the_radius_is_outside(spark):
    v = np.zeros((5, 8))
    pivots = np.zeros((4, 8))
    pivots[:, 0] = 2.0
    x = Index(table(spark, v), SMALL, pivots=pivots, radii=[4.0, 4.5, 3.0, 5.0])
    assert {r["sketch"] for r in x.sketches.collect()} == {0b1010}


def test_odd_vectors_are_left_out(spark):
    v = [[0.1] * 8, None, [0.1] * 7, [0.1] * 7 + [None], [0.1] * 7 + [float("nan")], [float("inf")] * 8, [0.2] * 8]
    x = Index(table(spark, v), SMALL)
    assert sorted(r["vec_id"] for r in x.vectors.collect()) == [0, 6]
    assert QUERIES["scan_vectors"](x).count() == 7


def test_one_bucket_comes_whole(spark):
    x = Index(table(spark, np.full((40, 8), 0.1)), SMALL)
    assert x.buckets.count() == 1 and x.whole_buckets(x.priorities, 20).agg({"n": "max"}).first()[0] == 40


def test_wide_sketches(spark):
    c = SearchConfig(dim=64, w=40, parts=8, nq=2, nc1=30, nc2=20, k=5)
    v = np.random.default_rng(3).normal(size=(200, 64)) * 0.1
    x = Index(table(spark, v), c)
    assert x.sketches.agg({"sketch": "max"}).first()[0] >= 1 << 33
    assert {r["count"] for r in x.search().groupBy("qid").count().collect()} == {5}
    with pytest.raises(ValueError, match="listed"):
        QUERIES["enum_sketches"](x)


def test_sketches_of_least_priority_are_all_found(spark):
    x = Index(table(spark, np.random.default_rng(4).normal(size=(100, 8)) * 0.3), SMALL)
    bds = {r["qid"]: (r["qs"], r["bd"]) for r in x.context().collect()}
    m = int(20 / (100 / 16))
    for q, (qs, bd) in bds.items():
        want = sorted((sum(b for p, b in enumerate(bd) if (s ^ qs) >> p & 1), s) for s in range(16))[:m]
        got = sorted((r["prio"], r["sketch"]) for r in QUERIES["enum_sketches"](x).where(F.col("qid") == q).collect())
        assert got == want


def test_pivot_files(spark, tmp_path):
    text = "2, 1,2,0,1\n10,20,30\n-127,127,0\n127,127,127\n0,0,-127\n"
    path = tmp_path / "pivots.csv"
    path.write_text(text)
    p = files.read_pivots(spark, str(path))
    centres, radii = files.pivot_arrays(p)
    assert centres.tolist() == [[-127, 127, 0], [127, 127, 127], [0, 0, -127]] and radii == [10, 20, 30]
    assert sorted(map(tuple, files.read_rotation(spark, str(path)).collect())) == [(0, 2), (1, 0), (2, 1)]
    assert files.pivot_type(spark, str(path)) == (2, 1)
    assert files.read_projection_pivots(spark, str(path)).columns == ["p", "c"]
    assert files.pivot_text(p, 2, 1, [2, 0, 1]).first()["value"].replace(" ", "") == text.replace(" ", "").strip()
    assert files.pivot_text(p.drop("radius"), 3).first()["value"].split("\n")[:2] == ["3,1", "0,0,0"]


def test_vector_files(spark, tmp_path):
    rows = [(i * 7, [(i * j) % 255 - 127 for j in range(6)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    for r in files.ftr_files(df, 16).collect():
        (tmp_path / f"{r['file']}.ftr").write_bytes(bytes(r["content"]))
    assert sorted((r["vec_id"], r["v"]) for r in files.read_ftr(spark, str(tmp_path)).collect()) == rows


def test_bucket_tables(spark, tmp_path):
    s = spark.createDataFrame([(i, i * i % 11) for i in range(40)], "vec_id long, sketch long")
    files.write_buckets(s, str(tmp_path / "b"))
    with pytest.raises(Exception, match="exists"):
        files.write_buckets(s, str(tmp_path / "b"))
    count = {r["sketch"]: r["n"] for r in files.read_buckets(spark, str(tmp_path / "b")).collect()}
    assert list(files.bucket_cursor(spark, str(tmp_path / "b"))) == sorted(count.items())
    assert files.read_buckets(spark, str(tmp_path / "b"), "ids").count() == 40
    dense = [(r["n"], r["pos"]) for r in files.dense_buckets(files.read_buckets(spark, str(tmp_path / "b")), 5).orderBy("sketch").collect()]
    n = [count.get(k, 0) for k in range(32)]
    assert dense == list(zip(n, [0, *itertools.accumulate(n)][:32], strict=True))


def test_answer_files(spark, tmp_path):
    truth = spark.createDataFrame([(q, r, 10 * q + r, 0.5 * r) for q in (4, 9) for r in (1, 2, 3)], "qid long, rank int, vec_id long, dist double")
    path = tmp_path / "answers.csv"
    path.write_text(files.answer_text(truth).first()["value"] + "\n")
    assert path.read_text().split("\n")[2] == "0,4, 41, 0.500000, 42, 42, 1.000000, 43, 43, 1.500000, 44"
    assert sorted(map(tuple, files.read_answers(spark, str(path)).collect())) == sorted(map(tuple, truth.collect()))
    assert files.read_answers(spark, str(path), 1).count() == 2


def test_results_never_overwrite(spark, tmp_path):
    found = spark.createDataFrame([(q, r, q + r, 100 * r) for q in (0, 1) for r in (1, 2)], "qid long, rank int, vec_id long, dist long")
    path = str(tmp_path / "result.csv")
    paths = [files.write_results(found, path, kind, found.where("rank = 1")) for kind in ("ids", "distances", "evaluated")]
    assert [p.rpartition("/")[2] for p in paths] == ["result.csv", "result_1.csv", "result_2.csv"]
    lines = ["\n".join(r["value"] for r in spark.read.text(p).collect()) for p in paths]
    assert lines[0] == "2, 3\n3, 4" and lines[1].split("\n")[1] == "secret, secret, 2, 100,3, 200" and lines[2].split("\n")[2] == "2,100,2, 100,3, 200"
    assert files.write_rows(found, path).endswith("_3.csv")


def test_bits_intervals_and_mixed_codes(spark):
    df = spark.createDataFrame([(5, [1, 2, 3, 7, 8, 20], [3, 1, 5, 2, 7])], "m long, a array<int>, c array<int>")
    r = df.select(X.has_bit(F.col("m"), 2).alias("h"), X.with_bit(F.col("m"), 1).alias("s"), X.with_bit(F.col("m"), 0, False).alias("u"), X.intervals(F.col("a")).alias("i")).first()
    assert (r["h"], r["s"], r["u"]) == (True, 7, 4) and [tuple(x) for x in r["i"]] == [(1, 3), (7, 2), (20, 1)]
    widths, t = [2, 3, 3, 2, 3], [[10 * p + v * v for v in range(8)] for p in range(5)]
    got = df.select(X.pack_mixed("c", widths).alias("b"), F.array(*(F.array(*map(F.lit, row)) for row in t)).alias("t")).select("b", X.folded("t", widths).alias("f")).select(X.folded_distance("b", "f").alias("d"))
    assert got.first()["d"] == sum(t[p][c] for p, c in enumerate([3, 1, 5, 2, 7]))


def test_a_pivot_counts_only_extreme_axes(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [127, 0, -127, 127])], "v array<int>, c array<int>")
    v, c = F.col("v"), F.col("c")
    r = df.select(X.l2sq_pivot(v, c).alias("a"), X.l2sq_pivot(v, c, [0, 1]).alias("b"), X.l2sq_pivot(v, c, None, 2, 2).alias("d")).first()
    assert tuple(r) == (126**2 + 130**2 + 123**2, 126**2, 130**2 + 123**2)
