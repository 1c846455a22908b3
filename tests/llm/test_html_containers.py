"""Which containers of a page fall away."""

import time

import pytest
from catalens.llm import html_text

MIXED = ("main-nav", "widget_text")
TEXT = "A sentence of the article that is long enough to win. " * 6


def text_of(body):
    return html_text.main_text(f"<html><body>{body}</body></html>", None)[0]


@pytest.mark.parametrize("name", ["content has-sidebar", "wrapper no-sidebar", "site header-fixed", "post comments-open", "elementor-widget-wrap", "page with-menu"])
def test_layout_words_in_a_wrapper_do_not_drop_the_article(name):
    assert text_of(f'<div class="{name}"><div class="part"><p>{TEXT}</p></div></div><div class="sidebar"><p>left</p></div>') == TEXT.strip()


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "page-header", "widget"])
@pytest.mark.parametrize("tag", ["main", "article"])
def test_what_holds_the_article_stays(name, tag):
    assert text_of(f'<div class="{name}"><{tag}><p>{TEXT}</p></{tag}><div class="comments"><p>{TEXT * 3}</p></div></div>') == TEXT.strip()


def test_most_of_the_text_stays_under_a_mixed_name():
    assert text_of(f'<div class="layout-sidebar-left"><p>{TEXT}</p></div><div class="site-footer"><p>foot</p></div>') == TEXT.strip()


@pytest.mark.parametrize("name", ["comments", "post-comments", "comments-area", "cookie-notice", "sidebar", "related-posts", "ad1", "widget_text", "main-nav"])
def test_boilerplate_still_falls(name):
    assert text_of(f'<div class="x"><p>{TEXT}</p><div class="{name}"><p>{TEXT if name in MIXED else TEXT * 3}</p></div></div>') == TEXT.strip()
    assert text_of(f'<div class="x"><article><p>{TEXT}</p></article><div class="{name}"><article class="comment-body"><p>{TEXT}</p></article></div></div>') == TEXT.strip()


def test_title_beside_a_long_content_is_kept():
    for tag in ("main", "div", 'div class="page"', "body"):
        assert text_of(f"<{tag}><h1>Title</h1><div class=content><p>{TEXT * 5}</p></div></{tag.split()[0]}>") == "Title\n" + (TEXT * 5).strip()


def test_both_parts_of_an_article_are_kept():
    parts = f'<div class="one"><p>{TEXT}</p></div><div class="two"><p>{TEXT * 2}</p></div>'
    for body in (parts, f'<div class="x">{parts}</div>', f"<article>{parts}</article>"):
        assert text_of(body) == TEXT.strip() + "\n" + (TEXT * 2).strip()


def test_a_long_list_in_an_article_does_not_take_its_heading():
    items = f"<ul><li>{TEXT * 20}</ul>"
    assert text_of(f"<article><h1>Title</h1><p>Intro</p>{items}</article>") == "Title\nIntro\n" + (TEXT * 20).strip()


def test_link_lists_are_not_climbed_to():
    links = "".join(f'<li><a href="/{k}">another page of this site</a></li>' for k in range(9))
    for body in (f'<div class="x"><div class="y"><ul>{links}</ul></div><div class="content"><p>{TEXT}</p></div></div>', f"<div><ul>{links}</ul></div><div class=content><p>{TEXT}</p></div>"):
        assert text_of(body) == TEXT.strip()


def test_a_host_path_is_climbed_from_on_each_page():
    page = f'<html><body><div class="x"><h1>Title</h1><div class="content"><p>{TEXT}</p></div></div><div class="y"><p>{TEXT * 2}</p></div></body></html>'
    assert html_text.main_text(page, "html>body>div.x>div.content") == ("Title\n" + TEXT.strip(), "html>body>div.x")


@pytest.mark.parametrize("body", ['<section class="related-work">%s</section>', '<div class="comment-free">%s</div>', '<div id="cookies-recipe">%s</div>', '<main><div class="notice-text">%s</div></main>', '<main><div class="article-social-policy">%s</div></main>'])
def test_a_word_of_an_aside_among_others_does_not_drop_the_article(body):
    assert text_of("<nav>menu</nav>" + body % f"<p>{TEXT}</p>" + '<div class="comments"><p>short</p></div>') == TEXT.strip()


def test_headings_of_an_article_header_are_kept():
    assert text_of(f"<header><h1>Site</h1></header><article><header><nav>menu</nav><h1>Title</h1><p>by me</p></header><p>{TEXT}</p></article>") == "Title\n" + TEXT.strip()


def test_cells_without_end_tags_lie_side_by_side():
    found = html_text.tree("<table><tr><td>a<td><div>b<tr><th>c<td><table><tr><td>d<td>e</table>f</table><p>g")
    assert [(found.path(at), text) for at, text, _ in found.blocks] == [("table>tr>td", "a"), ("table>tr>td>div", "b"), ("table>tr>th", "c"), ("table>tr>td>table>tr>td", "d"), ("table>tr>td>table>tr>td", "e"), ("table>tr>td", "f"), ("", "g")]


def test_quotes_count_after_an_equals_sign_only():
    assert text_of(f"""<p title=it's>{TEXT}</p><p title="a > b" class='x>y'>more</p>""") == TEXT.strip() + "\nmore"
    assert text_of(f"""<p>{TEXT}<a title="open>b</a> c""") == TEXT.strip() + " b c"


def test_equal_scores_go_to_the_path_that_is_smaller_step_by_step():
    links = "<a>some link</a>"
    assert html_text.vote(f"<div class=b>{links}</div><div class=a>{links}</div>")[0] == "div.a"


@pytest.mark.parametrize("page", ["<table>" + "<tr><td>x" * 33_000, "<div><p>t" * 30_000, "<div><a>x</a>" * 20_000, "<script '" * 33_000, '<a b="' * 50_000, "<a" * 150_000, "<!" * 150_000, "</1" * 100_000, "<style>" * 40_000, "<a " + "= " * 150_000])
def test_work_grows_with_the_page(page):
    began = time.process_time()
    html_text.main_text(page, None)
    assert time.process_time() - began < 5
