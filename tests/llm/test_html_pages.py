"""Main text of pages: broken and hostile markup, names taken whole, and the given pages against the standard library's parser."""

import time
from html.parser import HTMLParser

import duckdb
import pytest

from tributary.llm import html

LINKS = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"


def test_short_paragraphs_behind_links():
    text = "word " * 21
    assert html.main_text(f"<article><p><a href=x>only four linked words</a></p><p>{text}</p><p>The end.</p></article>") == f"only four linked words\n\n{text.strip()}\n\nThe end."
    assert html.main_text(f"<body>{LINKS}<div><p>{text}</p><p>{text}</p></div>") == f"{text.strip()}\n\n{text.strip()}"
    assert html.main_text(f"<body>{LINKS}<p>Short words here</p>{LINKS.replace('nav', 'div')}<p>{text}</p>") == text.strip()


@pytest.mark.parametrize(
    "page,want",
    [
        ("<title-x>foo</title-x><p>rest of the page</p>", "foo\n\nrest of the page"),
        ("<svg-icon></svg-icon><p>rest of the page</p>", "rest of the page"),
        ('<article><div class="side-by-side"><p>Hello there</p></div><div class="form"><p>A form of life</p></div></article>', "Hello there\n\nA form of life"),
        ('<article><header class="entry-header"><h1>Title</h1><p>by me</p></header><p>Body</p></article>', "Title\n\nBody"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "Let x=1 be"),
        ('<article><p>a <select><option>A<option>B</select> b <svg><path d="x"/></svg>c <button>Go</button> d</p></article>', "a b c d"),
        ("<article><p>open <button>Go</p><p>next</p></article>", "open\n\nnext"),
        ('<article><p title="a > b">quoted</p><p title="x>unclosed</p></article>', "quoted\n\nunclosed"),
        ("<p>a < b and c <3 d, said he</p>", "a < b and c <3 d, said he"),
        ("<article><p>cut <b", "cut"),
        ('<article><p>text</p><div class="cookieNotice">We use cookies</div><div class="ad-slot-300x250">Buy</div><ul class="comment-list"><li>Nice</li></ul><div role="search">Find</div></article>', "text"),
        ('<article><p>text</p><section class="sharing-economy"><p>stays</p></section></article>', "text\n\nstays"),
    ],
)
def test_markup(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("unit", ['<script x="', '<p title="', '<p title=">" ', "<", "</x>", "<div>x", "<ul><div><li>", '<a href="x>t</a>', "&amp", "<svg>", "<b x='\" ", 'class="class="'])
def test_a_megabyte_of_broken_markup(unit):
    began = time.process_time()
    html.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < (1 if unit == '<script x="' else 12)  # quadratic reading takes hours


class _Article(HTMLParser):
    """Text blocks of the article element of a well-formed page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.out = 0, [], []

    def cut(self):
        words = " ".join("".join(self.parts).split())
        self.parts = []
        if words and self.inside:
            self.out.append(words)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("a", "b"):
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "br"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.parts.append(data)


def test_given_pages_against_a_parser():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        parser = _Article()
        parser.feed(page)
        assert html.main_text(page) == "\n\n".join(parser.out)


def test_the_tree_looks_at_both_neighbours():
    def used(tree):
        return {html.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert {"shell", "in_article", "links", "links_before", "links_after"} <= used(html.default_tree())
