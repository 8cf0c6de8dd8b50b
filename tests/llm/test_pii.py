"""Spans beyond the base kinds on planted rows, and the query's digest against plain patterns."""

import hashlib
import os
import random
import re
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm import BASE, DATA, _pii

from skein.llm import pii

TRUE = [
    ("ssn", "My SSN is {}.", "123-45-6789"), ("ssn", "social security number: {}", "536-22-8712"), ("ssn", "taxpayer {} filed", "401-77-3920"), ("ssn", "{} is on file", "212-34-9981"),
    ("iban", "Pay to IBAN {} today", "DE89 3704 0044 0532 0130 00"), ("iban", "bank account {}", "FR1420041010050500013M02606"), ("iban", "transfer {} now", "GB29NWBK60161331926819"),
    ("tel", "call me at {} tonight", "(803) 555-5351"), ("tel", "phone: {}", "803 555-5351"), ("tel", "reach us, {}, any day", "212 555-0187"),
]
FALSE = [
    ("ssn", "part number {} shipped", "123-45-6789"), ("ssn", "order {} is late", "523-45-6781"), ("ssn", "the code 000 was {} there", "000-00-0000"), ("ssn", "invoice no. {}", "666-12-1234"), ("ssn", "SSN {}", "900-00-0000"),
    ("iban", "serial {} of the model", "XX12ABCD1234EFGH5678"), ("iban", "part {}", "QQ99AAAA9999BBBB1111"),
    ("tel", "order {} is late", "803 555-5351"), ("tel", "serial number {}", "212 555-0187"), ("tel", "version {}", "123 456-7890"),
]


@pytest.mark.parametrize("times,other", [(1, 0), (30, 200), (3, 2000)])
def test_planted_spans(spark, times, other):
    """Each template many times or once, in tables of few and of many other spans: the decisions are the same."""
    rng = random.Random(1)
    rows = [(k, kind, text.format(value), True) for k, (kind, text, value) in enumerate(TRUE * times)]
    rows += [(len(rows) + k, kind, text.format(value), False) for k, (kind, text, value) in enumerate(FALSE * times)]
    more = [(100_000 + k, "", rng.choice(["version {} out", "call {}", "order {}", "{}"]).format(f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"), None) for k in range(other)]
    docs = spark.createDataFrame([(i, t) for i, _, t, _ in rows + more], "doc_id long, text string")
    got = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find_pii(docs).collect()}
    hit = [kind in got[i] for i, kind, _, true in rows if true]
    wrong = [kind in got[i] for i, kind, _, true in rows if true is False]
    assert sum(hit) >= 0.9 * len(hit) and sum(wrong) <= 0.1 * len(wrong)


def test_reliabilities_converge_and_keep_their_side():
    prior, odds = pii.reliabilities({})
    assert prior > 0
    same = pii.reliabilities({(1, 0, 0, -1, 0, 1): 1e6, (1, 0, 0, 0, 0, 1): 10.0})
    assert same == pii.reliabilities({(1, 0, 0, -1, 0, 1): 1e6, (1, 0, 0, 0, 0, 1): 10.0}, 2000)
    for f in pii.VOTES:
        assert same[1][f][1] >= 0 >= same[1][f][-1] or f == "far"
    assert same[1]["far"][-1] <= odds["far"][-1] / 2 + 1e-9


@pytest.mark.parametrize("texts", [[], [None, "", "a.b@c.de and +49 89 1234567", "1.2.3.4 " * 3, "é😀 4539 1488 0343 6467"], None], ids=["empty", "odd", "data"])
def test_query_digest_equals_plain_patterns(spark, tmp_path, texts):
    path = DATA
    if texts is not None:
        path = str(tmp_path)
        pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "found": pa.array([1] * len(texts)), "kind": pa.array(["x"] * len(texts))}), tmp_path / "documents.parquet")
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{path}/documents.parquet").to_pylist()}
    rows = pii.query(spark, path).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = _pii(text[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in re.split(",", r["spans"]) if s.split(":")[0] in BASE] == want
