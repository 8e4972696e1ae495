"""Articles in wrappers whose classes name the layout, and their lists and tables."""

import html
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from proofline.llm import html_text

PARAGRAPH = "This is a paragraph, with some words in it, and quite long; it goes on and on. " * 3
ARTICLE = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(5))
TEXT = "\n".join([PARAGRAPH.strip()] * 5)


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div id='page' class='with-comments'", "section class='share-free'", "div class='comments-open widget'"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrapped_articles_stay(wrapper, inner):
    page = f"<body><{wrapper}><{inner}>{ARTICLE}</{inner}><div class='comments'><p>Nice, thanks.</p></div></{wrapper.split()[0]}></body>"
    assert html_text.main_text(page) == TEXT


def test_the_title_in_an_entry_header_stays():
    assert html_text.main_text(f"<article><div class='entry-header'><h1>Title</h1></div>{ARTICLE}</article>") == "Title\n" + TEXT


def test_comments_stay_out_as_articles():
    assert html_text.main_text(f"<article>{ARTICLE}</article><ol class='comment-list'><li><article class='c'><p>{PARAGRAPH}</p></article></ol>") == TEXT


@pytest.mark.parametrize("around", ["article", "main", "div class=text", None])
def test_lists_and_tables_stay(around):
    items = "<ul>" + "<li>Twenty characters ok</li>" * 6 + "</ul>"
    cells = "<table><caption>Short</caption>" + "<tr><td>cell of text</td></tr>" * 20 + "</table>"
    start, end = (f"<{around}>", f"</{around.split()[0]}>") if around else ("", "")
    want = "\n".join([TEXT, *["Twenty characters ok"] * 6, "Short", *["cell of text"] * 20])
    assert html_text.main_text(f"<body>{start}{ARTICLE}{items}{cells}{end}</body>") == want


def test_names_that_only_contain_a_word_of_the_list_stay():
    page = f"<article><div class='article-header'><h1>Title</h1></div><div class='share-price'>{ARTICLE}</div><p class='section-notice'>It is noted, here.</p></article>"
    assert html_text.main_text(page) == f"Title\n{TEXT}\nIt is noted, here."


def test_inline_elements_that_are_left_out_part_no_paragraph():
    assert html_text.main_text("<p>one <svg><text>x</text></svg>two <button>Go</button>three</p>") == "one two three"


def meaningless(page, chance):
    """A page with a random word in the place of each class and id."""
    return re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="{"".join(chance.choices("bcdfgz", k=9))}"', page)


def of_article(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(filter(None, found))


def test_ratios_decide_without_names():
    """Names of classes and ids made meaningless: the given pages still give their articles, and the ratios reject what lies
    beside. With a plain element in the place of each article too, nine tenths of the pages still do; the others have an article
    of a line or two, no longer than the advert."""
    chance, right, rejected = random.Random(8), 0, 0
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        want, plain = of_article(page), meaningless(page, chance)
        assert html_text.main_text(plain) == want
        rejected += len(html_text.Page(plain).blocks) - want.count("\n") - 1
        right += html_text.main_text(plain.replace("<article>", "<div>").replace("</article>", "</div>")) == want
    assert rejected >= len(pages) and right >= 0.9 * len(pages)


def test_ratios_reject_what_lies_beside_the_text():
    """No names and no elements of fixed meaning at all: short texts and links beside an article go."""
    links = "<div>" + "<div><a href=x>A link to more</a></div>" * 12 + "</div>"
    page = f"<body><div><div>Site name</div></div>{links}<div>{ARTICLE}</div><div><div>All rights reserved.</div></div></body>"
    assert html_text.main_text(page) == TEXT
    found = html_text.Page(page)
    fused, threshold = html_text.ratios(found)
    assert sum(fused[b.path] < threshold for b in found.blocks) >= 13


def test_many_paths_take_linear_time():
    for page in ("".join(f"<p class=c{i}>some words, {i}.</p>" for i in range(50_000)), "".join(f"<div class=c{i}>some words, {i}." for i in range(50_000))):
        began = time.perf_counter()
        assert html_text.main_text(page).count("\n") >= 40_000  # of nested ones the outermost go
        assert time.perf_counter() - began < 30


def test_ratios_decide_on_the_given_pages(monkeypatch):
    """With the same ratio everywhere half of the given pages come out otherwise: the article's tag alone finds nothing."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    right = [html_text.main_text(page) for page in pages]
    assert right == [of_article(page) for page in pages]
    monkeypatch.setattr(html_text, "ratios", lambda page: ([1.0] * len(page.above), 1.0))
    assert sum(html_text.main_text(page) != text for page, text in zip(pages, right)) >= 0.5 * len(pages)


def test_an_embedded_article_is_not_the_page():
    inner = "<article class=q><p>An embedded post.</p></article>"
    found = html_text.main_text(f"<body><div class=story><p>{PARAGRAPH}</p>{inner}<p>{PARAGRAPH}</p></div></body>")
    assert [line for line in found.split("\n") if line != "An embedded post."] == [PARAGRAPH.strip()] * 2


def test_teasers_are_not_the_page():
    teasers = "".join(f"<article><h2>T{i}</h2><p>Teaser {i}, read on.</p></article>" for i in range(3))
    assert html_text.main_text(f"<body><div class=text>{ARTICLE}</div>{teasers}</body>") == TEXT


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_unnamed_comments_inside_an_article_go(outer):
    comments = "<section class=x1><h3>Ann</h3><p>Nice read, thanks.</p></section>" * 3
    assert html_text.main_text(f"<body><{outer}>{ARTICLE}{comments}</{outer}></body>") == TEXT


def test_short_blocks_of_an_article_stay():
    page = f"<article><h1>Title</h1><p class=lead>In short, it is so.</p>{ARTICLE}<h2>More</h2><p>A line, and more.</p><ul><li>one<li>two</ul></article>"
    assert html_text.main_text(page) == f"Title\nIn short, it is so.\n{TEXT}\nMore\nA line, and more.\none\ntwo"
