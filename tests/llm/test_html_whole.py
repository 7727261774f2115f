import random
import re
import time
from html import unescape

import pytest

from folioforge.llm import html_text

LONG = "A paragraph of the article, with commas, clauses, and words enough that it counts, " * 4


@pytest.mark.parametrize("n", [1, 3, 8, 30])
def test_an_article_stays_whole_at_every_length(n):
    body = "".join(f"<p>{LONG}</p>" for _ in range(n))
    page = f"<body><nav><a href=x>Menu</a></nav><article><header><h1>Title</h1></header><div class=content>{body}</div><ul><li>First point</li></ul><p>Short.</p></article></body>"
    got = html_text.extract(page).split("\n")
    assert got[0] == "Title" and got[-2:] == ["First point", "Short."] and len(got) == n + 3


def test_small_parts_between_and_beside_kept_siblings_stay():
    one, two = (f"<div class=content>{''.join(f'<p>{LONG}</p>' for _ in range(6))}</div>" for _ in range(2))
    links = "<ul><li><a href=a>Elsewhere</a></li><li><a href=b>More</a></li></ul>"
    page = f"<body><div><h2>Heading</h2>{one}bare text<table><tr><td>Cell</td></tr></table>{two}<p>End.</p>{links}<p>Far.</p></div></body>"
    got = html_text.extract(page).split("\n")
    assert [x for x in got if x != LONG.strip()] == ["Heading", "bare text", "Cell", "End."]


P = "<p>" + LONG + "</p>"


def test_title_lists_and_short_paragraphs_beside_the_container_stay():
    for before, after, texts in (("<h1>Title</h1>", "", ["Title"]), ("", "<p>Tiny.</p>", ["Tiny."]), ("<h2>Sub</h2>", "<ul><li>Point</li></ul><table><tr><td>1</td><td>2</td></tr></table>", ["Sub", "Point", "1", "2"])):
        got = html_text.extract(f"<body>{before}<div class=content>{P * 6}</div>{after}</body>").split("\n")
        assert [x for x in got if x != LONG.strip()] == texts


def test_quotes_in_bare_values_and_in_text_are_told_apart():
    assert html_text.extract(f"<article><p data-x=don't>It isn't lost, {LONG}</p><p title='a > b' lang=en/>Nor \"this\", {LONG}</p></article>").split("\n") == [f"It isn't lost, {LONG}".strip(), f'Nor "this", {LONG}'.strip()]


@pytest.mark.parametrize("name", ["share-of-market", "text notice-board", "legal-history", "searchlight", "commentary", "related-work", "header-files"])
def test_names_that_only_begin_like_furniture_stay(name):
    assert html_text.extract(f"<body><div>{P}<div class='{name}'>{P}</div>{P}</div></body>") == "\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize("name", ["share-buttons", "cookie-notice", "site-footer", "relatedPosts", "comments", "ad", "sidebar left", "nav-links", "search-form"])
def test_names_of_furniture_go(name):
    assert html_text.extract(f"<body><div>{P}<div class='{name}'>{P}</div>{P}</div></body>") == "\n".join([LONG.strip()] * 2)


def test_depth_has_no_limit():
    deep = "<div>" * 3000 + f"<nav><a href=x>Menu</a></nav><p>{LONG}</p><p>Two, {LONG}</p>" + "</div>" * 3000
    assert html_text.extract(deep) == f"{LONG.strip()}\nTwo, {LONG.strip()}"


@pytest.mark.parametrize("part", ["<a '", "<", "<p", "<!--", "</x>", "<div></i>", "<li>", "<b><div>", "<i></div>", "<td><table>", "<script>", '<a b="', "&", "<li><div>", "<i><table></i>", "<dt><li>"])
def test_hostile_pages_take_time_by_length(part):
    began = time.perf_counter()
    html_text.extract((part * (400_000 // len(part) + 1))[:400_000])
    assert time.perf_counter() - began < 12


def brute(page):
    """The article's text by plain substitution, for pages made of known parts."""
    page = re.search(r"<article>(.*)</article>", page, re.S)[1]
    page = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav).*?</\1>|<div class=ad>.*?</div>", "", page, flags=re.S)
    parts = re.split(r"</?(?:p|h1|h2|ul|li|table|tr|td|div|blockquote|pre)[^>]*>", page)
    return "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts) if x)


def test_made_pages_equal_plain_substitution():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "b&amp;w", "caf&eacute;,", "don't", "x &lt; y", "<b>bold</b>", "<a href='/q'>l</a>", "two\n lines", "&nbsp;gap", "<br>", "<i>it</i>,"])
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    kinds = [
        lambda: f"<p>{words(1, 60)}</p>", lambda: f"<p class=x>{words(20, 90)}", lambda: f"<h2>{words(1, 6)}</h2>", lambda: f"<ul><li>{words(1, 9)}<li>{words(1, 9)}</ul>",
        lambda: f"<table><tr><td>{words(1, 5)}<td>{words(1, 5)}</table>", lambda: f"<blockquote>{words(3, 40)}</blockquote>", lambda: f"<div><p>{words(5, 40)}</p></div>",
        lambda: "<script>var x = '<p>no</p>';</script>", lambda: f"<!-- {words(2, 5)} -->", lambda: f"<aside>{words(3, 30)}</aside>", lambda: f"<form><input>{words(2, 6)}</form>", lambda: f"<div class=ad>{words(4, 20)}</div>",
    ]
    for _ in range(300):
        body = "".join(rng.choice(kinds)() for _ in range(rng.randint(1, 14)))
        page = f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>{words(1, 5)}</h1><p>{words(30, 60)}</p>{body}</article><footer>{words(5, 30)}</footer></body></html>"
        assert html_text.extract(page) == brute(page), page


@pytest.mark.parametrize("words", [1, 3, 40, 400])
def test_a_widget_goes_however_short_the_article(words):
    article = "A line, of the article. " * words
    for name in ("widget", "social share", "disclaimer", "header banner"):
        page = f'<body><div class="{name}"><p>{"Text, of something else, that is long. " * 30}</p></div><div class="content"><h1>T</h1><p>{article}</p></div></body>'
        assert html_text.extract(page) == "T\n" + article.strip()
        alone = f'<body><div class="{name}"><p>{article}</p></div><p></p></body>'
        if words > 1:
            assert html_text.extract(alone) == article.strip()


def test_short_siblings_of_the_container_stay():
    long = "Some long, long paragraph of the article, with commas. " * 4
    page = "<div id=wrap><div>An opening.</div><div class=text><p>" + long + "</p></div><section>Short closing line.</section><div><a href=x>links alone</a></div></div>"
    assert html_text.extract(page) == "An opening.\n" + long.strip() + "\nShort closing line."
