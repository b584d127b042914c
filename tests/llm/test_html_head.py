"""The end tag of head may be missing."""

import pytest

from confluo.llm.html_extract import extract_pages, parse

BODY = "<article><h1>Big news</h1><p>First line of some length and more text here.<p>Second one, with words. It goes on.</article>"
HEAD = '<html><head><meta charset="utf-8"><title>no</title><style>p {}</style><script>x("<p>")</script><link rel="a">'


@pytest.mark.parametrize("between", ["", "<body>", "</head>", "</head><body>", "\n<BODY class='a'>\n"])
def test_blocks_without_the_end_tag(between):
    want = [t for _, t in parse(f"<html><body>{BODY}")[1]]
    assert len(want) == 3
    assert [t for _, t in parse(f"{HEAD}{between}{BODY}")[1]] == want


def test_what_ends_a_head():
    texts = {"<head><title>no</title>Plain text": ["Plain text"], "<head>Plain <b>text</b>": ["Plain text"], "<head><head><body>a": ["a"], "<head><svg>no</svg><p>a": ["a"], "<head>\n<title>no</title>\n": []}
    for page, want in texts.items():
        assert [t for _, t in parse(page)[1]] == want


def test_page_without_the_end_tag(spark):
    rows = [(1, f"{HEAD}</head><body>{BODY}"), (2, f"{HEAD}<body>{BODY}"), (3, f"{HEAD}{BODY}")]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got[1].n_chars > 0 and got[2].text == got[3].text == got[1].text
