import os
import sys

import duckdb
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    d = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(d / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{d}/shared")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "pages", "benchmark", "labels"):
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            path = f"{sf_dir}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).to_numpy().tolist())) for x in (a, b)]
    assert rows[0] == rows[1]
