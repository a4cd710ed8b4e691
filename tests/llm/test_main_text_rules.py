"""Main text: what the contract says of articles, links, names and languages, and odd tables."""

from __future__ import annotations

from sentivote.llm import main_text

PROSE = "The board of the company met on Monday and it agreed that the price of the plant is to be paid in May."
MENU = "<nav><a href=a>Home</a> <a href=b>News</a></nav>"


def text_of(*parts):
    return main_text.main_text("<html><body>" + MENU + "".join(parts) + "<footer>All rights reserved</footer></body></html>")


def test_names_inside_an_article_count_as_a_whole():
    page = (
        f"<article><h1>Plans</h1><p>{PROSE}</p><h2 id='related-work'>Related work</h2><section class='search-results-analysis'><p>{PROSE}</p>"
        f"</section><div class='related-posts'><p>Other posts you may like</p></div><div id='comments'><p>{PROSE} Nice!</p></div></article>"
    )
    assert text_of(page) == f"Plans {PROSE} Related work {PROSE}"


def test_links_and_captions_inside_an_article_stay():
    page = (
        f"<article><h1><a href=x>A linked headline</a></h1><p>{PROSE}</p><figure><img src=x><figcaption>The old plant</figcaption></figure>"
        f"<p>{PROSE}</p><ol><li><a href=1>First report of the year</a></li><li><a href=2>Second report</a></li></ol></article>"
    )
    assert text_of(page) == f"A linked headline {PROSE} The old plant {PROSE} First report of the year Second report"


def test_a_heading_named_like_boilerplate_takes_its_neighbours_label():
    assert text_of(f"<article><p>{PROSE}</p><h2 id='search'>Search</h2><p>{PROSE}</p></article>") == f"{PROSE} Search {PROSE}"


def test_without_an_article_two_passes_decide():
    page = f"<div><h1>Plans</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div class=x><a href=a>One</a> <a href=b>Two</a></div><p>Tail</p>"
    # the heading has main text behind it and nothing before it, the short block lies between main text, the tail behind links
    assert text_of(page) == f"Plans {PROSE} Short one. {PROSE}"


def test_languages_without_known_stop_words():
    chinese = "公司董事会星期一开会并同意五月支付工厂的价格然后再讨论明年的计划以及新的市场。" * 3
    italian = "Il consiglio della società ha deciso lunedì che il prezzo dello stabilimento sarà pagato nel mese di maggio da tutti gli azionisti."
    for prose in (chinese, italian):
        page = f"<div><p>{prose}</p><p>{prose}</p></div><div><a href=a>{prose}</a></div>"
        assert text_of(page) == f"{prose} {prose}"


def test_odd_tables(spark, rows_of):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", 1, 2), (None, None, None, 1, 2), (2, "v", "", 1, 2), (1, "u", f"<article><p>{PROSE}</p></article>", 1, 2)]
    rows.append((3, "w", "<article><p>" + "word " * 300_000 + "</p></article>", 1, 2))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int, `a.b` int")
    got = rows_of(main_text.extracted(pages))
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got) == [(0, "", 0), (1, "u", len(PROSE)), (1, "u", len(PROSE)), (2, "v", 0), (3, "w", 1_499_999)]
    assert main_text.extracted(pages.limit(0)).count() == 0
