"""Main text of pages without a plain article, with comments, marks, links and broken elements."""

import time

import pytest

from gridlight.llm import html_text
from gridlight.llm.html_text import main_text

LONG = "The council met in the town hall and it was the first time that all of the members had been in the room since the vote, as the chair said to the press after the end of the long session on the new road and what it would do to the houses by the river."
MORE = "There was not much that they could do about the state of the bridge, but the engineer who had looked at it for two weeks said that it is safe for the time being and that the work on it can be done in the summer."


@pytest.mark.parametrize("attributes", ['title="The hidden valley"', 'data-note="a hidden one"', 'class="hidden-gems"', 'data-x=\'style="display:none"\''])
def test_hidden_in_a_value_hides_nothing(attributes):
    assert main_text(f"<article {attributes}><p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "aria-hidden='true'", 'style="color:red; display : none"', 'class="x" hidden'])
def test_hidden_elements(attributes):
    assert main_text(f"<article><p>{LONG}</p><p {attributes}>{MORE}</p></article>") == LONG


def test_titles_by_lines_and_lists_of_links_of_an_article_stay():
    page = f'<article><h1>Title</h1><p><a href="/j">By Jane Doe</a></p><p>{LONG}</p><h2>Sources</h2><ul><li><a href="/x">see report X</a></li><li><a href="/y">The second report on bridges</a></li></ul><p>{MORE}</p></article>'
    assert main_text(page).split("\n") == ["Title", "By Jane Doe", LONG, "Sources", "see report X", "The second report on bridges", MORE]
    assert main_text('<article><h1>Title</h1><ul><li><a href="/x">one</a></li></ul></article>') == "Title\none"


def test_comments_and_cards_in_articles_of_their_own():
    comments = f'<section class="comments"><article><p>{MORE}</p></article></section>'
    cards = f'<div class="related"><article><h3>Card</h3><p>{MORE}</p></article></div>'
    aside = f"<aside><article><p>{MORE}</p></article></aside>"
    for page in (f"<article><p>{LONG}</p></article>{comments}{cards}{aside}", f"<article><p>{LONG}</p>{comments}{cards}</article>", f"<main><article><p>{LONG}</p></article>{cards}</main>"):
        assert main_text(page) == LONG


@pytest.mark.parametrize("mark", ["comments-section", "user-comments", "ad-unit", "advert-box", "page-sidebar", "newsletter_box", "article-comments"])
def test_words_in_tokens_mark_furniture(mark):
    assert main_text(f'<article><p>{LONG}</p><div class="{mark}"><p>{MORE}</p></div></article>') == LONG


@pytest.mark.parametrize("token", ["has-sidebar", "no-comments", "comments-enabled", "sidebar-layout", "related-content", "shared", "adventure", "road-ahead"])
def test_tokens_that_mark_nothing(token):
    assert main_text(f'<article class="{token}"><p>{LONG}</p></article>') == LONG


def test_marks_and_unclosed_menus_around_the_whole_page():
    assert main_text(f'<div class="modal"><article><p>{LONG}</p></article></div>') == LONG
    assert main_text(f'<nav><a href="/">Home</a><article><p>{LONG}</p></article>') == LONG


@pytest.mark.parametrize("text", ["Совет собрался в ратуше, и впервые после голосования все члены были в зале, как сказал председатель прессе после долгого заседания о новой дороге и о том, что она изменит для домов у реки и для жителей старого квартала за мостом.", "Il consiglio si riunì nel municipio e per la prima volta dopo il voto tutti erano presenti in sala, disse il presidente alla stampa dopo una lunga seduta sulla nuova strada e sulle case vicino al fiume, mentre gli abitanti aspettavano fuori.", "市议会在市政厅开会，这是投票之后所有成员第一次都在场。主席在漫长的会议结束后对记者说，会议讨论了新的道路以及它对河边房屋的影响，居民们在外面等待结果，工程师说桥梁目前是安全的，工程可以在夏天进行，费用由城市承担，市长表示会继续听取居民的意见并在下个月公布详细的计划，同时也会对老城区的交通做出新的安排，让孩子们上学的路更加安全，商店的货物运输也不会因此受到影响，记者会在傍晚结束，大家随后离开了会场，雨也停了，街上又恢复了往日的平静，人们在桥边散步聊天。"])
def test_other_languages_outside_articles(text):
    page = f'<div><a href="/">Menu</a></div><div><p>{text}</p></div><div><a href="/a">one</a> <a href="/b">two</a></div>'
    assert main_text(page) == text


def test_broken_pages_take_linear_time():
    took = []
    for n in (4_000, 40_000):
        began = time.time()
        main_text("<div>" * n + "</p>" * n + "<b>" * n + "<li>x</li>" * n)
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.01)


def test_given_pages_by_their_own_articles(spark, data):
    """Every given page has one article; its blocks that aren't furniture are the text."""
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    for p in pages[:100]:
        blocks = html_text.blocks_of(p.html or "")
        assert main_text(p.html) == "\n".join(b.text for b in blocks if b.main and not b.furniture)
