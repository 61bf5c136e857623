"""The cut of a long page is that of its whole graph; it decides labels; whole pages equal a plain parse."""

import random
import re
import time
import tracemalloc
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from gymlake.llm.html_cut import BLOCK, DEFAULT, Model, block_costs, blocks_of, fit, label, main_text, minimum_cut, whole_cut

PAGES = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()


def test_parts_give_the_cut_of_the_whole():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 40)
        costs = [float(r.randint(-9, 9)) for _ in range(n)]
        edges = [(i, j, float(r.randint(1, 5))) for i in range(n) for j in range(i + 1, min(n, i + 4)) if r.random() < 0.6]
        assert whole_cut(costs, edges) == minimum_cut(costs, edges)


def test_a_long_undecided_page_is_one_graph(monkeypatch):
    """Blocks without a cost of their own follow the one at the far end, beyond any window."""
    from gymlake.llm import html_cut

    blocks = blocks_of("<div>" + "<p>x</p>" * 900 + "</div>")

    monkeypatch.setattr(html_cut, "block_costs", lambda blocks, model: [50.0] + [0.0] * (len(blocks) - 1))
    assert label(blocks) == [True] * 900


def unmarked(html):
    return re.sub(r"(</?)(article|nav|footer)", r"\1div", html).replace(' class="ad"', "")


def test_the_cut_flips_blocks_of_given_pages_and_is_right_more_often():
    """Pages whose marks are taken away, judged by the prior's weights: what lies close decides doubtful blocks."""
    model, alone, cut, flipped = Model(DEFAULT.weights, fit(PAGES).capacity), 0, 0, 0
    for html in PAGES:
        truth, blocks = [b.element.mark > 0 for b in blocks_of(html)], blocks_of(unmarked(html))
        costs, labels = [c > 0 for c in block_costs(blocks, model)], label(blocks, model)
        flipped += sum(x != y for x, y in zip(costs, labels, strict=True))
        alone += sum(x == y for x, y in zip(costs, truth, strict=True))
        cut += sum(x == y for x, y in zip(labels, truth, strict=True))
    assert flipped > 50 and cut - alone > 0.5 * flipped


def test_learned_costs_find_articles_without_marks():
    model = fit(PAGES[:150])
    for html in PAGES[150:]:
        assert label(blocks_of(unmarked(html)), model) == [b.element.mark > 0 for b in blocks_of(html)]


class Plain(HTMLParser):
    """The blocks inside article elements."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts, self.out = False, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_whole_pages_equal_a_plain_parse():
    model = fit(PAGES)
    for html in PAGES:
        plain = Plain()
        plain.feed(html)
        plain.flush()
        assert main_text(html, model) == "\n\n".join(plain.out)


def test_a_quote_that_is_never_closed_leaks_no_markup():
    text = "Hello there, this is a sentence of the article. " * 5
    assert main_text(f'<article><p class="foo>{text}</p></article>') == text.strip()
    assert "<" not in main_text(f"<article><p>{text}<a title='x>{text}</a></article>")


def test_memory_goes_with_the_page_not_with_its_depth():
    html = "<article>" + "<b><p>Some words of a paragraph.</p>" * 1900
    tracemalloc.start()
    assert len(blocks_of(html)) == 1900
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(html)
    assert fit([]).weights.tolist() == DEFAULT.weights.tolist() and fit([""]).weights.tolist() == DEFAULT.weights.tolist()


PARAGRAPHS = [f"This is paragraph {w} of the article, and it goes on for a while. It has a second sentence, too, so that it is clearly prose and not a label." for w in ("one", "two", "three", "four")]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = '<nav><a href="/a">Home</a> <a href="/b">About us</a></nav>'
FOOT = "<footer>&copy; Example. All rights reserved.</footer>"


@pytest.mark.parametrize("page", [
    '<div class="layout with-sidebar">{}</div>', '<div class="no-ads">{}</div>', '<div class="has-header">{}</div>', '<main class="post share-enabled">{}</main>', '<div class="post comments-open">{}</div>',
    '<div class="related-articles-page">{}</div>', '<form id="aspnetForm" action="x">{}</form>', '<div id="comments-page"><article>{}</article></div>', '<div class="header-wrapper"><div class="share"><main>{}</main></div></div>',
    "<article><header>{}</header></article>", '<section class="widget"><article class="post">{}</article></section>',
])
def test_wrappers_do_not_hide_the_article(page):
    model = fit(PAGES)
    html = f"<html><body>{MENU}{page.format(ARTICLE)}{FOOT}</body></html>"
    assert main_text(html, model) == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("rest", [
    '<div id="comments"><p>I liked this very much. It is the best that I have read. Thanks for it, and please write more of them.</p></div>' * 9, '<ol class="comment-list"><li><article class="comment-body"><p>I do not agree with this. It is wrong, and it is long. Please stop.</p></article></li></ol>' * 9,
    '<aside><article><p>You may also like this one. It is about other things, and it is on another page.</p></article></aside>', '<div class="sidebar"><p>Subscribe to our letter. It comes once a week, and it is free of charge.</p></div>', '<form><p>Write to us. We answer within a week, mostly.</p></form>',
    '<div class="cookie-notice"><p>We use cookies. By going on you agree to it, and to our terms of use.</p></div>', '<div class="top-ads"><p>Buy one now. It is cheap, and it is very good.</p></div>',
])
def test_what_stands_beside_the_article_stays_out(rest):
    model = fit(PAGES)
    assert main_text(f"<html><body>{MENU}<article>{ARTICLE}</article>{rest}{FOOT}</body></html>", model) == "\n\n".join(PARAGRAPHS)


def test_open_elements_take_linear_time():
    for part in ("<b><p>Some words of a paragraph.</p>", "<b></i><p>Words.</p>", "<div class=ad><p>Words.</p>", "<i></p>"):
        times = []
        for n in (4000, 16000):
            start = time.perf_counter()
            blocks_of(part * n)
            times.append(time.perf_counter() - start)
        assert times[1] < 12 * times[0] + 0.5, part
