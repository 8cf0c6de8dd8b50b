"""Odd tables in each stage of the pipeline."""

import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm import CASES, P1, documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", ["empty", "odd"])
def test_stages_take_odd_tables(spark, tmp_path, name):
    texts, ids = CASES[name]
    table = documents(texts, ids)
    n = len(texts)
    table = table.append_column("extra", pa.array(range(n), pa.int64())).append_column("bad", pa.array(["x"] * n, pa.string()))
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": pa.array([P1 + " rather", None])}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for stage, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and (stage == "mixing" or out.columns == docs.columns)
        kept[stage] = sorted(r["doc_id"] for r in out.collect())
    assert kept["quality classifier"] == kept["secret scan"] == kept["mixing"] == list(range(n))  # without labels all are good
    if n:
        assert set(range(n)) - set(kept["near-duplicates"]) == {6, 7, 10, 11}  # copies, one of them in capitals, and with a word more
        assert {5, 6, 7, 10} & set(kept["decontamination"]) == set() and {0, 1, 2, 3, 4} <= set(kept["decontamination"])
