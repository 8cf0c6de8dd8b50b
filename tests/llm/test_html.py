"""Wrappers decide what is main text; alignment against the plain table; long, odd and repeated pages."""

import functools
import random

import pytest

from skein.llm import htmltext


def texts(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name, value in more.items():
        df = df.selectExpr("*", f"{value} AS {name}")
    return {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}


#: Every page of another structure, so that only alignment brings its template text together.
OWN = "<body><article>{0}<p>own {1}</p>{2}<blockquote>Jetzt kaufen</blockquote><dl><dt>also {1}</dt><dd>By our staff</dd></dl></article></body>"
ROWS = [(i, "http://h.example/p", OWN.format(f"<h{i % 6 + 1}>head {i}</h{i % 6 + 1}>", i, f"<pre>code {i}</pre>" * (i % 2) + f"<figure>pic {i}</figure>" * (i // 6))) for i in range(12)]


def test_alignment_brings_template_text_of_different_structures_together(spark):
    want = {i: "\n".join([f"head {i}", f"own {i}", *[f"code {i}"] * (i % 2), *[f"pic {i}"] * (i // 6), f"also {i}"]) for i in range(12)}
    assert texts(spark, ROWS) == want


def test_without_wrappers_that_text_stays(spark, monkeypatch):
    """The same with each page's own stream in place of the host's wrapper."""
    monkeypatch.setattr(htmltext, "laid", lambda nodes, wrapper: [None] * len(htmltext.places(nodes)))
    assert all("Jetzt kaufen" in t and "By our staff" in t for t in texts(spark, ROWS).values())


def test_rounds_of_merging_give_the_same(spark):
    rows = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    found = htmltext.streams(htmltext.parsed(rows, "page_id", "url", "html"))
    few, many = (htmltext.wrappers(found, fan).collect() for fan in (2, 256))
    assert len(few) == len(many) == 1
    import json

    common = [sorted(tuple(p[2]) for p in htmltext.places(json.loads(w[0]["wrapper"])) if p[2] and p[3] == 12) for w in (few, many)]
    assert common[0] == common[1] and len(common[0]) == 2


def longest(a, b):
    @functools.cache
    def best(i, j):
        return 0 if i == len(a) or j == len(b) else max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if a[i] == b[j] else 0)

    return best(0, 0)


@pytest.mark.parametrize("space", [1 << 28, 6])
def test_common_subsequences_are_longest(monkeypatch, space):
    monkeypatch.setattr(htmltext, "SPACE", space)
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in "ab")
        got = htmltext._common(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == longest(tuple(a), tuple(b))
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_repeats_of_any_length_fold():
    # no stretch of differences of the Thue-Morse sequence is followed by itself
    turn = [bin(i + 1).count("1") % 2 - bin(i).count("1") % 2 + 2 for i in range(48)]
    stretch = "".join(f"<h{t}>t</h{t}>" for t in turn)
    nodes, blocks = htmltext.stream(f"<div>{stretch * 3}</div>")
    assert nodes[0] == "div" and nodes[1][0] == "+" and len(nodes) == 3
    assert len(blocks) == 3 * 48 and len({p for p, _ in blocks}) == len(htmltext.places(nodes)) > 24


def test_long_pages(spark):
    rng = random.Random(2)
    pages = []
    for i in range(2):
        parts = [rng.choice(["<p>a {0}</p>", "<h2>b {0}</h2>", "<ul><li>c {0}</ul>", "<pre>d {0}</pre>"]).format(k) for k in range(18_000)]  # some 50,000 nodes
        pages.append((i, "http://long.example/", f"<body><nav>menu</nav><article>{''.join(parts)}</article></body>"))
    got = texts(spark, pages)
    assert all(t.count("\n") == 17_999 and "menu" not in t for t in got.values())


def test_articles_keep_discussions_formulas_and_search_results(spark):
    html = "<body><div class='search-box'>find</div><article><h1>T</h1><section id='discussion'><p>we find</p></section><div class='search-results-section'>ten</div><p>a <math><mi>x</mi></math> &l<b>t;</b> &lt;</p><noscript>plain</noscript><div class='ad-box'>buy</div></article><div id='comment-list'>nice</div></body>"
    assert texts(spark, [(1, None, html)]) == {1: "T\nwe find\nten\na x &lt; <\nplain"}


def test_empty_tables_repeats_and_clashing_columns(spark):
    assert texts(spark, []) == {}
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (None, None, "<p>y</p>"), (2, None, None), (3, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS sid", "3 AS nodes", "4 AS blocks", "5 AS places", "6 AS text")
    got = sorted(((r["page_id"], r["text"]) for r in htmltext.extract(df).collect()), key=str)
    assert got == sorted([(1, "x"), (1, "x"), (None, "y"), (2, ""), (3, "")], key=str)
