"""Short blocks of pages without an article take the label of the nearest decided block."""

from proxjoin.llm import html

GOOD = "The cat sat on the mat and it was there for a long time with all of the others."
BAD = "<div><a href=x>Menu one two three</a></div>"


def test_headline_and_last_paragraph():
    assert html.main_text(f"<body><h1>Headline</h1><p>{GOOD}</p><p>The end.</p>") == f"Headline\n{GOOD}\nThe end."
    assert html.main_text(f"<body><h1>Menu</h1>{BAD}<p>{GOOD}</p>{BAD}<p>Foot</p>") == GOOD


def test_nearest_decided_block_counts():
    assert html.main_text(f"<body>{BAD}<p>One.</p><p>{GOOD}</p>") == f"One.\n{GOOD}"
    assert html.main_text(f"<body>{BAD}<p>One.</p><p>Two.</p><p>Three.</p><p>{GOOD}</p>") == f"Two.\nThree.\n{GOOD}"
