"""Main text of pages: layouts with a known article, the pages of the tables, odd rows."""

import html
import re

import duckdb
import pytest
from pyspark.sql import types as T

from moodlens.llm.html_text import content_paths, extract, main_text, path_ratios, Page

from .conftest import SF

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
PARAGRAPHS = ["The first paragraph tells, in some detail, what the article is about. It has two sentences.",
              "A second one goes on; it links <a href='/x'>to a source</a>, and ends.", "Short.",
              "The last paragraph is long enough, again, to weigh something. It closes the text, as one would expect."]
WANT = "\n".join(["A headline", *(re.sub("<[^>]*>", "", p) for p in PARAGRAPHS)])
BODY = "<h1>A headline</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News, views.</a></li><li><a href=/a>About us</a></li></ul>"
COMMENTS = "".join(f"<div class='comment'><p>Reader {i} says, at great length, that this is a fine article. More of that, please, and soon.</p></div>" for i in range(9))
HEAD = "<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>if (a < b) x('</p>');</script></head>"

LAYOUTS = {
    "article": f"{HEAD}<body><nav>{MENU}</nav><div class=ad>Buy this, now. It is cheap, and good.</div><article>{BODY}</article><footer>&copy; us</footer></body></html>",
    "divs": f"{HEAD}<body><div id='header'><p>Our site, since 1999.</p></div><div id='menu'>{MENU}</div><div id='content'>{BODY}</div>"
            f"<div class='sidebar'><p>Popular, too: this one.</p></div><div class='footer'>Imprint.</div></body>",
    "unmarked menu": f"{HEAD}<body>{MENU}<div>{BODY}</div><div>{MENU}</div></body>",
    "menu in the article's own box": f"{HEAD}<body><main>{MENU}{BODY}</main></body>",
    "comments outweigh": f"{HEAD}<body class='single has-sidebar'><main>{BODY}<section id='comments'><h2>Comments</h2>{COMMENTS}</section></main></body>",
    "comments as articles": f"{HEAD}<body><article class='post has-sidebar tag-x'>{BODY}<ol class='comment-list'><li><article class='comment'>{COMMENTS}</article></li></ol></article></body>",
    "form and notice": f"{HEAD}<body><div class='cookie-notice'><p>We use cookies, as you know. Agree?</p></div><article>{BODY}"
                       "<form><p>Write to us, please.</p><input><button>Send</button></form><aside>See, too.</aside></article></body>",
    "header of the article": f"{HEAD}<body><header><p>Site name, motto.</p></header><article><header class='entry-header'><h1>A headline</h1>"
                             f"<div>12 May</div></header>{BODY[len('<h1>A headline</h1>'):]}</article></body>",
    "headline outside": f"{HEAD}<body><div>{MENU}</div><h1>A headline</h1><div class='story'>{BODY[len('<h1>A headline</h1>'):]}</div></body>",
    "no end tags": "<html><body><nav>" + MENU + "</nav><article><h1>A headline</h1>" + "".join(f"<p><b>{p}<br>" for p in PARAGRAPHS),
    "table": f"<table><tr><td><a href=/>Home</a></td><td>{BODY}</td></tr></table>",
    "hidden": f"{HEAD}<body><article>{BODY}<div hidden>Not seen.</div><p style='display: none'>Nor this.</p><template><p>No.</p></template></article></body>",
    "white space": f"{HEAD}<body><article>" + BODY.replace(" ", " \n\t ").replace("</p>", " </p>\n\n") + "<!-- note <p>no</p> --></article></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(LAYOUTS[name]) == WANT


def test_pages_of_the_tables():
    for source, in duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall():
        inner = re.search("<article>(.*)</article>", source, re.S)[1]
        parts = (html.unescape(re.sub("</?(?:b|br)>", "", x)) for x in re.split("</?(?:h1|p)>", inner))
        assert main_text(source) == "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_character_references_and_markup_in_text():
    assert main_text("<p>a &lt;b&gt; &amp;amp; &eacute; &#x4e2d; &zzz; 1 < 2 &amp") == "a <b> &amp; é 中 &zzz; 1 < 2 &"


def test_ratios_prefer_text_with_punctuation():
    leaves = Page(LAYOUTS["unmarked menu"]).leaves
    for leaf in leaves:
        leaf.path = (leaf.element.tag,)
    values = path_ratios(leaves)
    assert content_paths(values) == {("p",)} and values["p",] > 5 * values["li",]


def test_rows_and_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, " \n "), (None, "u", "plain  text"), (5, "u", "<p>same</p>"), (5, "u", "<p>same</p>"), (6, "u", "<nav>menu</nav>"),
            (7, "u", "<p>" + "word " * 200_000), (8, "u", "<!-- open"), (9, "u", "<p class='x"), (10, "u", "<div>" * 5000 + "deep"), (11, "u", "<script>x"),
            (12, "u", "<a href='q" * 2000)]
    from pyspark.sql import functions as F

    given = spark.createDataFrame(rows, PAGE).withColumns({"text": F.lit("mine"), "n_chars": F.lit(1), "path": F.lit("mine")})
    got = extract(given)
    assert sorted(got.columns) == ["n_chars", "page_id", "path", "text", "url"]
    found = {(r.page_id, r.text) for r in got.collect()}
    assert got.count() == len(rows)
    assert {(1, ""), (2, ""), (3, ""), (None, "plain text"), (5, "same"), (6, ""), (7, ("word " * 200_000).strip()), (8, ""), (10, "deep"), (11, "")} <= found
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert extract(spark.createDataFrame([], PAGE)).count() == 0
