"""HTML extraction on small pages; nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxjoin.llm import html, neighbours

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First   <i>para</i>&nbsp;graph.<br>
<p>Second &#233; <!-- no --> one</p><ul><li>item<li>other</ul><form><input value=x><button>Send</button></form>
<div class="comments"><p>A reader says so</p></div><p>Short.</p></article>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE) == "Head & line\nFirst para graph.\nSecond é one\nitem\nother\nShort."


def test_page_without_article():
    good = "The cat sat on the mat and it was there for a long time with all of the others."
    page = f"<body><div>Tiny</div><p>{good}</p><p>Short one.</p><p>{good}</p><div><a href=x>{good}</a></div><div>Foot</div>"
    assert html.main_text(page) == f"{good}\nShort one.\n{good}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "</p></p>", "<script>", "<a <b> c", "&#x110000; &bogus;", "<div " * 1000, "<p>" * 3000])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_extract(spark):
    rows = [(1, "u", PAGE, "x", 5), (2, None, None, "x", 5), (2, None, None, "x", 5), (None, "v", "<article><p>" + "word " * 50_000 + "</p></article>", "x", 5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id is None).n_chars == 249_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def vectors() -> list[tuple]:
    rnd = np.random.default_rng(4)
    x = np.round(rnd.normal(size=(300, 12)), 2).astype(np.float32)
    x[40:80] = x[7]  # copies tie
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 12), (1040, [1.0] * 11 + [float("nan")]), (1060, [1.0] * 11 + [None]), (1080, [float("inf")] * 12), (1100, [1.0] * 5), (1120, [2.0] * 5), (None, [1.0] * 12), (20, rows[20][1])]
    return rows


@pytest.mark.parametrize("block_bytes", [64, 8 << 20])
def test_nearest(spark, block_bytes):
    rows = vectors()
    made = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank string, score double").repartition(3)
    got = neighbours.nearest(made, F.col("vec_id") % 20 == 0, k=20, block_bytes=block_bytes)
    able = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    want = []
    for q, x in able:
        if q % 20 == 0:
            near = sorted(((sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in able if i != q and len(y) == len(x)), key=lambda p: (-p[0], p[1]))
            want.append((q, near))
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append(r)
    for q, near in want:
        found = sorted(by[q], key=lambda r: r["rank"])
        if sum(p == q for p, _ in able) == 1:
            assert [(r.vec_id, r.score) for r in found] == [(i, s) for s, i in near[:20]]
            assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
    assert neighbours.nearest(made.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(50, 64)), rnd.normal(size=(70, 64))
    s = neighbours.Search(np.arange(50), x, 5)
    s.visit(np.arange(100, 170), y)
    true = x @ y.T
    for i in range(50):
        assert sorted((-v for _, v in s.heaps[i])) == sorted((100 + np.argsort(-true[i])[:5]).tolist())
