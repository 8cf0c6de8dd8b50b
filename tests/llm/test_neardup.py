"""Near-duplicates against brute force: repeated ids, recall at the threshold, components over many tasks."""

import random

import numpy as np
import pytest

from skein.llm import _graph, neardup
from skein.llm._common import written


def brute(rows, k=4, percent=80):
    """component by row, over ids."""
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = top(rows[x][0]), top(rows[y][0])
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), top(i), top(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, neardup.near_duplicates(docs, k=4).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def words(seed, n, pool=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def test_repeated_ids_keep_all_links(spark):
    p, q = words(1, 60), words(2, 60)
    rows = [(5, p), (5, q), (7, p + " z"), (8, q + " z")]
    assert found(spark, rows) == brute(rows) and {r[2] for r in found(spark, rows)} == {5}


def test_random_tables_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = words(100 + g // 2, 70).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((rng.randrange(45), " ".join(w)))
    rows += [(90, None), (91, ""), (92, "a b"), (93, "A  B"), (3, "a b c d e f g")]
    assert found(spark, rows) == brute(rows)


def test_a_family_that_stars_miss(spark):
    """All share buckets with the hub but are unlike it; they are alike in pairs."""
    core = words(9, 60).split()
    rows = [(0, " ".join(core))]
    for g in range(8):
        w = core + words(50 + g, 40).split()  # 60 % like each other and the hub
        rows += [(2 * g + 1, " ".join(w)), (2 * g + 2, " ".join([*w, "end"]))]
    assert found(spark, rows) == brute(rows)


def test_pairs_at_the_threshold_share_buckets():
    """Recall of the buckets on random sets at similarity 0.8: two shared buckets or more."""
    rng = np.random.default_rng(8)
    at, grams, n = [], [], 0
    for _ in range(6000):
        u = rng.integers(0, 2**64, 10 * int(rng.integers(1, 9)), np.uint64)
        both, rest = u[: len(u) * 8 // 10], u[len(u) * 8 // 10 :]
        half = int(rng.integers(0, len(rest) + 1))
        for s in (np.concatenate([both, rest[:half]]), np.concatenate([both, rest[half:]])):
            grams.append(np.sort(s))
            at.append(np.full(len(s), n))
            n += 1
    keys = neardup.band_keys(neardup.signatures(np.concatenate(at), np.concatenate(grams), n))
    shared = (keys[::2] == keys[1::2]).sum(1)
    assert (shared < 2).sum() <= 1


@pytest.mark.parametrize("most", [7, 10**6])
def test_components_of_one_task_and_of_many(spark, most):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)]
    up = {x: x for pair in links for x in pair}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    df = written(spark.createDataFrame(links, "a long, b long"), "test-links")
    got = {r["id"]: r["component"] for r in _graph.components(df, most).collect()}
    assert got == {i: top(i) for i in up if top(i) != i}


def test_components_of_nothing(spark):
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
