"""The classifier reads whole texts, in fitting as in scoring, by one division into chunks."""

import numpy as np

from skein.llm import quality


def test_fitting_and_scoring_divide_alike():
    rng = np.random.default_rng(1)
    m = quality.Model(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype("f4"), rng.normal(size=quality.FILTERS), rng.normal(size=quality.FILTERS), 0.1, rng.normal(size=quality.FILTERS + 1))
    for n in (5, 6, 255, 259, 260, 261, 515, 516, 517, 5000, 70_001):
        text = rng.integers(0, 256, n, dtype=np.uint8)
        cells, lo, hi, owner, fill = quality._cells(np.array([n]))
        starts = np.arange(cells[0]) * quality.STRIDE
        value, where = quality._best(m.tables, np.append(text, np.zeros(quality.WIDTH, np.uint8)).astype(np.intp), starts, np.minimum(quality.STRIDE, n - quality.WIDTH + 1 - starts))
        z = quality._logits(m, np.maximum(value[lo], value[hi]), fill).mean()
        assert np.isclose(1 / (1 + np.exp(-z)), quality.score_block(m, text, np.array([0, n]))[0])
        assert where.max() == where.max(initial=0) <= n - quality.WIDTH


def test_a_sign_anywhere_in_a_long_text_is_learnt():
    """The classes differ in one stretch of 3000 bytes, anywhere in 20000."""
    rng = np.random.default_rng(2)
    texts, y = [], []
    for i in range(60):
        t = rng.integers(97, 110, 20_000, dtype=np.uint8)
        if i % 2:
            at = int(rng.integers(0, 17_000))
            t[at : at + 3000] = rng.integers(48, 58, 3000)
        texts.append(t)
        y.append(i % 2)
    m = quality.fit(texts, np.array(y, np.float64), steps=200, batch=8)
    scores = np.array([quality.score_block(m, t, np.array([0, len(t)]))[0] for t in texts])
    assert (scores[1::2] > 0.5).mean() > 0.9 and (scores[::2] < 0.5).mean() > 0.9


def test_bounds_of_the_sample_are_rows_and_bytes_of_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, y: seen.append((texts, y)))
    rows = [(i, "x" * (10 + i)) for i in range(200)] + [(200, "y" * 100_000), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    quality.train(docs, labels, rows=50)
    quality.train(docs, labels, size=3000)
    assert len(seen[0][0]) <= 50 and sum(map(len, seen[1][0])) <= 3000
    assert all(len(t) in {len(x or "") for _, x in rows} for texts, _ in seen for t in texts)
