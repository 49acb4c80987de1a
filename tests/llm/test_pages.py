"""Main text of pages: nested blocks, names, broken and very long markup, odd tables."""

import time

import pytest
from evolens.llm import html_text

P = "Some words that stand in a paragraph of text."


@pytest.fixture(scope="module")
def weights():
    page = f"<body><nav><a href=x>One</a></nav><div class=ad>buy this now</div><article><h1>Title</h1><p>{P}<p>{P}</article><footer>end of page</footer></body>"
    return html_text.Weights(html_text.count_labelled(iter([page] * 50)))


def body(content):
    return f"<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav>{content}<footer>foot words</footer></body></html>"


@pytest.mark.parametrize(
    "content, expected",
    [
        (f"<article><div><p>{P}</p></div><div><p>tiny</p></div></article>", f"{P} tiny"),
        (f"<article><section>a</section><section>{P}</section><section>b c</section></article>", f"a {P} b c"),
        (f"<article><header>Head</header><p>{P}</p><input type=text><p>end</p></article>", f"Head {P} end"),
        (f"<article><svg width='1'/><p>{P}</p><iframe src=x /><title-bar>bar</title-bar><p>end</p></article>", f"{P} bar end"),
        (f"<article><style-guide>guide</style-guide><p>{P}</p></article>", f"guide {P}"),
        (f"<article><p class='market-share'>a</p><p class=navy>{P}</p><div class='related-work'>b</div></article>", f"a {P} b"),
        (f"<article><div class='ad-banner'>no</div><p>{P}</p><div class='site_footer x'>no</div><div id=comments>no</div></article>", P),
        (f"<article><div role='search'>no</div>{P}<aside>no</aside><p>yes</p><form>no</form></article><div>after</div>", f"{P} yes"),
        (f"<div><div><p>{P} {P}</p></div><div><p>Five more words stand here.</p></div></div>", f"{P} {P} Five more words stand here."),
        (f"<article><p title='a>b'>{P}<p>don't <p data-x=\"q>v\">w <b>x<i>y</b>z</i></article>", f"{P} don't w xyz"),
        (f"<article><p>{P}</div></p></span> 3 < 4 &amp; &lt;b&gt;<!-- no --><![CDATA[no]]></article>", f"{P} 3 < 4 & <b>"),
        (f"<article><nav>no<p>no</p></b></nav><p>{P}</article>", P),
        ("<article><p></p></article>", ""),
    ],
)
def test_content(weights, content, expected):
    assert html_text.extract(body(content), weights) == expected


@pytest.mark.parametrize(
    "part, n",
    [("<a ", 350_000), ("<", 1_000_000), ("<a b=\"", 170_000), ("<script>", 130_000), ("<div><nav>", 50_000), ("</p>", 250_000), ("<!--", 250_000), ("<p a", 250_000)],
)
def test_broken_pages_take_linear_time(weights, part, n):
    begin = time.process_time()
    html_text.extract(part * n, weights)
    assert time.process_time() - begin < 10


def test_unmatched_ends_take_linear_time(weights):
    begin = time.process_time()
    html_text.extract("<b><article>" + "<div>" * 50_000 + "</b>" * 50_000 + "</section>" * 50_000, weights)
    assert time.process_time() - begin < 10


def test_long_page_is_whole(weights):
    text = " ".join(f"w{i}" for i in range(200_000))
    assert html_text.extract(body(f"<article><p>{text}</p></article>"), weights) == text


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    page = body(f"<article><p>{P}</p></article>")
    rows = [(1, "u", page, "x", 0), (1, "u", page, "y", 0), (None, None, page, None, None), (3, "v", None, None, None), (4, "w", "", None, None)]
    pages = spark.createDataFrame(rows, schema)
    got = html_text.main_text(pages, html_text.train(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted([(1, "u", P, len(P))] * 2 + [(None, None, P, len(P)), (3, "v", "", 0), (4, "w", "", 0)], key=str)
    empty = pages.limit(0)
    assert html_text.main_text(empty, html_text.train(empty)).count() == 0
