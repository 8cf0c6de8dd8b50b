import numpy as np
import pytest
from conftest import DATA, oracle, same

from skein import catalog, sources
from skein import functions as X
from skein.config import SearchConfig
from skein.operators.index import Index
from skein.plans.queries import QUERIES, TRIALS


@pytest.fixture(scope="module")
def index(spark):
    return catalog.index(spark, DATA)


@pytest.fixture(scope="module")
def unstored(spark):
    catalog._ready(spark)
    return Index(spark.read.parquet(f"{DATA}/embeddings.parquet"))


@pytest.mark.parametrize("name", ["rerank_knn", "filter_budget", "build_qsmap", "bucket_csr", "query_ctx", "smap", "exact_knn"])
def test_an_index_that_is_not_stored_gives_the_same(index, unstored, name):
    assert index.store and not unstored.store
    same(QUERIES[name](unstored).toPandas(), QUERIES[name](index).toPandas())


@pytest.mark.parametrize("nc1", [37, 250, 400])
def test_hamming_selection_gives_as_many_as_asked(spark, index, nc1):
    """FACTOR times the mean number of buckets holds nc1 vectors and more, or what the buckets in question hold."""
    x = Index(index.table, SearchConfig(nc1=nc1))
    mean = x.buckets.agg({"n": "avg"}).first()[0]
    over = x.first(x.priorities, int(int(nc1 / mean) * 2.0), "ham", "pt").groupBy("qid").agg({"n": "sum"})
    held = {r["qid"]: r["sum(n)"] for r in over.collect()}
    got = {r["qid"]: r["count"] for r in QUERIES["enum_hamming_select"](x).groupBy("qid").count().collect()}
    assert got == {q: min(nc1, n) for q, n in held.items()}


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(index, name):
    same(QUERIES[name](index).toPandas(), oracle(catalog.oracle_sql()[name], DATA))


@pytest.mark.parametrize("n, rows", [(25_600, 10), (25_601, 0)])
def test_sketches_of_a_larger_table_equal_their_sql(spark, tmp_path, n, rows):
    """Up to nc1 * 2^w vectors one sketch of each query is listed, beyond that none."""
    from pyspark.sql import functions as F

    few = spark.read.parquet(f"{DATA}/embeddings.parquet")
    more = few.crossJoin(spark.range(-(-n // few.count()))).withColumn("vec_id", few.vec_id + few.count() * F.col("id")).drop("id")
    more.where(F.col("vec_id") < n).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["enum_sketches"](Index(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))).toPandas()
    assert len(got) == rows
    same(got, oracle(catalog.oracle_sql()["enum_sketches"], str(tmp_path)))


def test_whole_budgets_are_exact(spark):
    x = Index(spark.read.parquet(f"{DATA}/embeddings.parquet"), SearchConfig(nc1=10_000, nc2=10_000))
    same(x.search().toPandas(), x.exact(10).toPandas())


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_unpack_reverts_pack(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(rng.integers(0, 1 << bits, 13).tolist(),) for _ in range(20)]
    df = spark.createDataFrame(rows, "c array<int>").withColumn("b", X.pack("c", bits)).withColumn("u", X.unpack("b", bits, 13))
    assert all(r["c"] == r["u"] for r in df.collect())


def test_orders_are_permutations(spark):
    from pyspark.sql import functions as F

    got = [r["g"] for r in spark.range(256).select(X.inverse_gray(F.col("id"), 8).alias("g")).collect()]
    assert sorted(got) == list(range(256))
    gray = {i ^ (i >> 1): i for i in range(256)}
    assert got == [gray[i] for i in range(256)]


def test_trials():
    assert sources.parse_trials(TRIALS) == [(0, 60, 30), (1, 100, 30), (2, 200, 40)]
    assert sources.parse_trials("5\n6") == []


def test_config_is_checked():
    for bad in ({"w": 0}, {"k": 50}, {"bits": 9}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    assert [SearchConfig(dim=10, parts=3).axes(p) for p in range(3)] == [(0, 4), (4, 3), (7, 3)]


def test_quantize_truncates_and_clips(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([([0.0151, -0.0151, 0.9, -0.9],)], "e array<float>").select(X.quantize(F.col("e"), 220.0).alias("v")).first()
    assert row["v"] == [3, -3, 127, -127]
