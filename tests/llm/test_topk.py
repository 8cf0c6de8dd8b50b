"""Bounds prune where they can, and change no result."""

import numpy as np

from skein.llm import topk


def best(q, c, k):
    return [sorted((-(int(np.dot(x.astype(object), y.astype(object)))), i) for i, y in enumerate(c))[:k] for x in q]


def test_groups_prune_and_equal_brute_force():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 40)) * 300
    c = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 40)) * 20).astype(np.int64)
    q = np.floor(centres[rng.integers(0, 12, 90)] + rng.normal(size=(90, 40)) * 20).astype(np.int64)
    group = topk._Group(np.arange(10_000, 10_090), q, 5)
    for lo in range(0, 3000, 700):
        group.add(np.arange(lo, min(lo + 700, 3000)), c[lo : lo + 700])
    assert (np.diff(group.counted) <= 0).all() and group.counted[-1] < 0.2 * group.counted[0]
    got = {}
    for w, i, s in zip(group.who, group.found, group.score, strict=True):
        got.setdefault(int(w), []).append((-int(s), int(i)))
    assert [sorted(got[w]) for w in range(90)] == best(q, c, 5)


def test_large_components_do_not_overflow(spark):
    v = [[2.0**22, 1.0], [2.0**30, 2.0**30], [-(2.0**60), 1.0], [1.0, 2.0**21]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, df).collect()}
    whole = [[min(int(x * 256), 2**62) if x > 0 else max(int(x * 256), -(2**62)) for x in row] for row in v]
    for (a, b), score in got.items():
        assert score == min(max(sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), -(2**63)), 2**63 - 1)


def test_many_groups_and_shards(spark, monkeypatch):
    for name, n in (("ROWS", 16), ("GROUP", 8), ("SHARD", 64), ("FIRST", 4)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 7)) * 256) / 256
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole = (x * 256).astype(np.int64)
    for r in topk.top_k(df, df.where("vec_id % 9 = 0"), 3).groupBy("query_id").agg({"score": "sum", "vec_id": "sum"}).collect():
        want = [t for t in best(whole[[r["query_id"]]], whole, 4)[0] if t[1] != r["query_id"]][:3]
        assert (r["sum(score)"], r["sum(vec_id)"]) == (-sum(t[0] for t in want), sum(t[1] for t in want))
