"""Main text of web pages: smoothing and clusters by brute force, odd markup, depth."""

import math
import random
import time

import pytest

from fieldloom.llm import html_text


def brute_clusters(ratios, sigma=html_text.SIGMA, cut=html_text.CUT):
    reach = max(1, math.ceil(2 * sigma))
    level = []
    for i in range(len(ratios)):
        near = [(j, math.exp(-((i - j) ** 2) / (2 * sigma**2))) for j in range(len(ratios)) if abs(i - j) <= reach]
        level.append(sum(ratios[j] * w for j, w in near) / sum(w for _, w in near))
    mean = sum(level) / len(level)
    spread = math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    edge = min(cut * spread, max(level))
    return [x >= edge or x == pytest.approx(edge) for x in level]


def test_clusters_equal_brute_force():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 40):
        for _ in range(20):
            ratios = [rng.choice([0.0, rng.uniform(0, 10), rng.uniform(50, 300)]) for _ in range(n)]
            assert html_text.clusters(ratios) == brute_clusters(ratios)


@pytest.mark.parametrize("html", ["<p>Before the mark. <![foo[ x ]]> After it.</p>", "<p>Before the mark. <![if IE]> After it.</p>", "<p>Before the mark. <!odd> After it.</p>"])
def test_odd_declarations_are_skipped(html):
    assert html_text.main_text(html) == "Before the mark. After it."


@pytest.mark.parametrize("html", ["<![foo[", "a <![x", "<", "</", "<!--", "&#xFFFFFFFF;", "<p <p <p", "</div></div>text", "\x00<\x00>", "<![CDATA[x]]>y"])
def test_a_page_never_fails(html):
    assert isinstance(html_text.main_text(html), str)


@pytest.mark.parametrize("unit", ["<div>x y z ", "<x-a>x y z ", "<div><h1>x y z</h1>", "<ul><li><a>x y z</a>", "<b>x y z "])
def test_deep_pages_take_linear_time(unit):
    def seconds(n):
        begun = time.process_time()
        html_text.main_text(unit * n + "<p>plain words of a page</p>")
        return time.process_time() - begun

    seconds(500)
    assert seconds(20_000) < 30 * max(seconds(2_000), 0.02)


ARTICLE = (
    "<html><body><nav>Home News</nav><article><h1>Title</h1><p>Main words of the article are here, many of them indeed.</p>{}"
    "<p>More words of the article follow, as many as before.</p></article><footer>Imprint</footer></body></html>"
)
FIRST, LAST = "Title Main words of the article are here, many of them indeed.", "More words of the article follow, as many as before."


@pytest.mark.parametrize(("part", "kept"), [
    ('<div class="related-work"><p>Earlier work by others is told here.</p></div>', "Earlier work by others is told here."),
    ('<section id="notice-of-default"><p>What a notice says.</p></section>', "What a notice says."),
    ("<p>Text <a>linked whole paragraph title</a></p>", "Text linked whole paragraph title"),
    ('<div class="share-buttons"><p>Share this with all.</p></div>', ""), ('<div class="comments"><p>First!</p></div>', ""),
    ('<div class="ad"><p>Buy now.</p></div>', ""), ('<div id="newsletter-signup-form"><p>Join us.</p></div>', ""),
    ("<p><a>Read on</a></p>", ""), ("<ul><li><a>One</a></li><li><a>Two</a></li></ul>", ""),
])
def test_parts_of_an_article(part, kept):
    assert html_text.main_text(ARTICLE.format(part)) == " ".join(x for x in (FIRST, kept, LAST) if x)


def test_names_outside_an_article_count_by_one_word():
    page = "<body><div><p>Long main text of the page, many words of it.</p><p>Another long paragraph of the page.</p></div><div class='related-work'><p>Other things</p></div></body>"
    assert html_text.main_text(page) == "Long main text of the page, many words of it. Another long paragraph of the page."
