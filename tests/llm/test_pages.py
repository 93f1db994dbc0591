"""Main text against an independent reading of the given pages, without the elements that give it away, and on malformed pages."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from feltloom.llm import html

SF = "/root/testdata/sf0.001"


class Reading(HTMLParser):
    """The text of a page's article by the standard library's parser, cut at block-level tags."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.now, self.out = False, [], []
        self.feed(source or "")
        self.close()
        self.cut()

    def cut(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "i"):
            self.cut()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i"):
            self.cut()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]


def test_query_matches_an_independent_reading(spark, pages):
    got = html.op3_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    want = Counter(" ".join(Reading(x).out) for x in pages)
    assert Counter(r.text for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    # Both passes decide many blocks.
    assert sum(r.first_pass for r in got) > len(got) and sum(r.second_pass for r in got) > len(got)


def test_text_alone_decides_pages_without_telling_elements(pages):
    """No article, navigation, footer or class name is left: stop words, length, links and neighbours find most of the text."""
    found, shown, wanted = 0, 0, 0
    for x in pages:
        bare = re.sub(r"<(/?)(?:article|nav|footer|header|aside)\b", r"<\1div", x or "").replace('class="ad"', 'class="zz"')
        a, b = Counter(html.main_text(bare).split()), Counter(html.main_text(x).split())
        found, shown, wanted = found + (a & b).total(), shown + a.total(), wanted + b.total()
    assert found / shown > 0.95 and found / wanted > 0.85


def test_titles_captions_and_links_of_an_article_stay():
    article = "<nav><a href=/>Home</a></nav><article>{}</article><footer>Foot</footer>"
    for source, text in {
        '<h1 class="post-header">A title</h1><p>Text</p>': "A title Text",
        '<div class="article-header"><h1>A title</h1></div><p>Text</p>': "A title Text",
        "<figure><img src=x><figcaption>A caption</figcaption></figure><p>Text</p>": "A caption Text",
        '<p class="search-legal-side share tags">Text</p><p>© of a photograph</p>': "Text © of a photograph",
        "<p>Text</p><p>Of this <a href=x>the larger part</a> is links</p><p>End</p>": "Text Of this the larger part is links End",
        '<p>Text</p><div class="comments"><p>Reader</p></div><aside>Side</aside><form>Form</form><div role=navigation>Menu</div><p class="cookie-notice">Notice</p>': "Text",
    }.items():
        assert html.main_text(article.format(source)) == text, source


def test_text_and_links_overturn_elements():
    """Prose outside of the article is text, and in a sidebar no longer sure to be none; a list of links in the article is none."""
    prose = "This is what the people of the town said to one another when they came back from the market, and it was not what they had been told before they left. " * 4
    links = " ".join(f"<a href='/{i}'>Category number {i}</a>" for i in range(12))
    page = f"<body><div>{prose}</div><article><p>{prose}</p><div>{links}</div><p>{prose}</p></article><div class='sidebar'>{prose}</div><div class='sidebar'>Offer Sale Price Buy Cart</div></body>"
    found = html.labelled(page)
    assert [(b.label, b.by, b.main) for b in found] == [("good", 1, False), ("good", 1, True), ("bad", 1, True), ("good", 1, True), ("bad", 2, False), ("bad", 1, False)]
    p = html.Params()
    assert max(-p.boilerplate, -p.outside, p.inside) < p.stop_most + p.long_most


def test_neighbours_decide_short_blocks():
    prose = "<p>It is the case that the one and the other of them are in the house, and that it was not for the first time that they were there.</p>"
    page = f"<div><a href=a>One</a></div><div><a href=b>Two</a></div><p>Near links.</p><h2>A heading</h2>{prose}<p>Short.</p>{prose}<p>Last.</p><p><a href=c>Next</a></p>"
    labels = [(b.label, b.by) for b in html.labelled(page)]
    assert labels == [("bad", 1), ("bad", 1), ("bad", 2), ("good", 2), ("good", 1), ("good", 2), ("good", 1), ("bad", 2), ("bad", 1)]


@pytest.mark.parametrize("part", ["<script ", "<a ", '<a "', "<a href='\">", "<div>x", "</div>x", "<div>", "<p>x <b class=ad>", "<!--", "<", "&amp", "<svg>", "<li><a href=x>y"])
def test_malformed_pages_take_linear_time(part):
    began = time.time()
    html.main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 20
    html.main_text("<div>" * 50_000 + "</p>" * 50_000)
    assert time.time() - began < 25


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extracted(none).count() == 0
