"""Length, link density and stop-word density decide about blocks; names, quotes and nesting don't lead astray."""

import time

import pytest

from proxjoin.llm import html

PROSE = "The cat sat on the mat and it was there for a long time with all of the others."
LIST = "Alpha 12 | Bravo 14 | Charlie 19 | Delta 23 | Echo 31 | Foxtrot 44 | Golf 52"
LINKS = "".join(f"<li><a href=x>Go to the place of that number {i} and on from there to all others</a></li>" for i in range(3))
PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture
def whole(monkeypatch):
    def without(name, value, page):
        monkeypatch.setattr(html, name, value)
        out = html.main_text(page)
        monkeypatch.undo()
        return out

    return without


def test_each_measure_decides(whole):
    page = f"<body><div>{LIST} {LIST}</div><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p><ul>{LINKS}</ul><div>Tel 12 34</div></body>"
    want = f"{PROSE}\nShort one.\n{PROSE}"
    assert html.main_text(page) == want
    assert whole("STOP_WORDS", frozenset(), page) != want
    assert whole("LINKED", 2.0, page) != want
    assert whole("LONG", 0, page) != want


def test_measures_change_the_tables_pages(spark, whole):
    pages = [r.html for r in spark.read.parquet(PAGES).select("html").collect()]
    plain = [html.main_text(p) for p in pages]
    assert all(plain)
    # The pages' articles are marked, so length alone changes none of them.
    for name, value in (("STOP_WORDS", frozenset()), ("LINKED", 2.0)):
        assert sum(whole(name, value, p) != t for p, t in zip(pages, plain, strict=True)) > 100, name


@pytest.mark.parametrize("name", ["section-header", "reader-content", "share-price", "related-work", "page-header", "readable", "broadcast", "headline"])
def test_names_that_only_sound_alike(name):
    page = f'<body><nav><a href=/>Home</a></nav><div><h2 class="{name}">Head</h2><p class="{name}">{PROSE}</p><p>{PROSE}</p></div></body>'
    assert html.main_text(page) == f"Head\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("name", ["comments", "reader-comments", "commentList", "sidebar", "cookie-notice", "notice", "ad", "ad-slot", "newsletter-signup", "social", "share"])
def test_side_parts(name):
    side = f'<div class="{name}"><p>{PROSE}</p><p>Short.</p></div>'
    assert html.main_text(f"<body>{side}<article><h1>Head</h1><p>{PROSE}</p><p>Last.</p>{side}</article>{side}</body>") == f"Head\n{PROSE}\nLast."


def test_places():
    two = f"<article><h2>One</h2><p>{PROSE}</p></article><nav><a href=x>Menu of all that there is</a></nav><article><h2>Two</h2><p>Short.</p><p>{PROSE}</p></article>"
    assert html.main_text(f"<body>{two}</body>") == f"One\n{PROSE}\nTwo\nShort.\n{PROSE}"
    table = f"<article><p>{PROSE}</p><p>{LIST}</p><table><tr><td>{LIST}</td></tr></table></article>"
    assert html.main_text(f"<body>{table}<div>{LIST}</div></body>") == f"{PROSE}\n{LIST}\n{LIST}"
    assert html.main_text(f"<body><nav><a href=x>Menu</a></nav><article><header><h1>Head</h1></header><p>{PROSE}</p><footer>By me</footer></article></body>") == f"Head\n{PROSE}"
    assert html.main_text(f"<article><p>{LIST}</p></article>") == LIST
    other = "Кот сидел на ковре и долго смотрел в окно, пока за окном шёл снег и темнело небо."
    assert html.main_text(f"<body><ul><li><a href=x>Меню</a></li></ul><p>{other}</p></body>") == other
    assert html.main_text(f"<body><aside><p>{PROSE}</p></aside></body>") == PROSE  # nothing else is there


def test_quotes_in_attributes():
    rest = f"<p>{PROSE}</p></article>"
    for tag in ("<p data-x=it's>", "<p data-x='it\"s'>", '<p title="a > b">', "<p x=\"\" y='>'>", "<p 'odd\">", "<p =>", "<p a = 'b'>"):
        assert html.main_text(f"<article><p>{PROSE}</p>{tag}More of it.</p>{rest}") == f"{PROSE}\nMore of it.\n{PROSE}", tag


@pytest.mark.parametrize("page", [lambda n: "<b>x" * n + "</i>" * n, lambda n: "<div>x<b>" * n + "</i></b>" * n, lambda n: "<p>x" * n, lambda n: "<b>" * n + "<p>x</b>" * n, lambda n: '<a href="' * n, lambda n: "<p x=' y=\"" * n, lambda n: "<!-" * n, lambda n: "<" * n, lambda n: "&" * n, lambda n: "<script" * n])
def test_time_grows_with_the_page(page):
    html.main_text(page(100))
    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        html.main_text(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


STORY = ["The cat sat on the mat and it was there for a long time with all of the others in the house by the sea.", "This is another paragraph that was written by the people who have been in the house for a very long time."]
ABOUT = "We are the people who have been here for a long time and this is about us and all of the things that we do."


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<article class="post category-newsletter tag-cookies"><p>{0}</p><p>{1}</p></article><aside><p>{2}</p></aside>', [0, 1]),
        ('<div class="elementor-widget"><article><p>{0}</p><p>{1}</p></article></div>', [0, 1]),
        ('<article><p>{0}</p><p class="banner-text">{1}</p></article>', [0, 1]),
        ('<article><p>{0}</p><p class="banner">{1}</p></article>', [0]),
        ('<form action="x"><main><p>{0}</p><input><button>Send it now</button><p>{1}</p></main></form>', [0, 1]),
        ('<article><p>{0}</p></article><form><p>{1}</p><p>{2}</p></form>', [0]),
        ('<article><p>{0}</p></article><section class="replies"><p>{1}</p></section><div class="disclaimer"><p>{2}</p></div>', [0]),
        ('<article><p>{0}</p><div class="comments"><article><p>{1}</p></article><article><p>{2}</p></article></div></article>', [0]),
        ('<article><p>{0}</p><p>{1}</p></article><div class="comments"><article><p>{2}</p></article></div>', [0, 1]),
    ],
)
def test_names_yield_to_the_article(page, kept):
    texts = [*STORY, ABOUT]
    assert html.main_text(page.format(*texts)) == "\n".join(texts[k] for k in kept)
