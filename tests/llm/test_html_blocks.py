"""Main texts against planted pages whose articles are known, and the given pages against their article elements."""

import html
import random
import re

import pytest

import __spark_entry__ as entry
from tests.llm.edges import documents
from weblake.llm import html_blocks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark):
    return html_blocks.fit(spark)


def plain(page):
    """What the article element of a given page says, block by block."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(line for line in lines if line)


def test_query_equals_the_article_elements(spark):
    got = entry.queries()["op12_html_extraction"](spark, SMALL)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


SITE = """<!doctype html><html><head><title>T</title><style>p {}</style></head><body class="with-sidebar comments">
<header><div class="logo">My site</div></header><div id="cookie-banner"><p>We use cookies to make this site better for all of you, please
accept every one of them now.</p><button>Yes</button></div><ul id="menu"><li><a href="/">Home</a><li><a href="/b">About us</a></ul>
<main><article class="post"><header><h1>The &eacute;tat of things</h1></header><p>First, with <a href="x">one link</a> &amp; more
text &lt;b&gt; in it.<p>Second<br>line</b> <script>var x = "</p><p>no";</script>here.</p><div class="advert">Buy now, this is cheap</div>
<!-- <p>hidden</p> --><ul><li>item one<li>item two</ul><p>ok.</p><p hidden>not seen by readers</p>
<section class="comments"><p>I agree with all that was said here, as it is so very true and well written.</p>
<article class="comment"><p>Me too, and this is also quite a long comment on the article above.</p></article></section></article></main>
<aside><p>Read also what others have read this week, as we have much more of it</p></aside>
<form action="/s"><label>Search</label><select><option>a</option></select><textarea>t</textarea></form><footer>&copy; Site</footer></body></html>"""

CASES = [
    (SITE, "The état of things\nFirst, with one link & more text <b> in it.\nSecond line here.\nitem one\nitem two\nok."),
    ('<form id="page"><nav>a b</nav><article><p>Text in a form around the page.</p></article></form>', "Text in a form around the page."),
    ("<article><p>a < b &nbsp;&#233; &bogus; <p>last", "a < b é &bogus;\nlast"),
    ("<article><p>open <!-- never closed <p>x</p>", "open"), ("<article><p>x</p><script>never closed <p>y</p>", "x"),
    ("", ""), (None, ""), ("   \n", ""), ("<nav><a href='/'>x</a></nav>", ""), ("<p", ""),
    ('<article><p title="a > b">quoted</p></article>', "quoted"), ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ("<article>" + "</div>" * 3000 + "<p>after stray ends", "after stray ends"),
    ("<article><pre>a\n  b</pre><table><tr><td>c<td>d</table></article>", "a b\nc\nd"),
    ("<article>" + "<p>" + "long text " * 50_000 + "</p></article>", ("long text " * 50_000).strip()),
]


@pytest.mark.parametrize("page, text", CASES, ids=range(len(CASES)))
def test_planted_pages(tree, page, text):
    assert html_blocks.main_text(page, tree) == text


def test_without_marks_words_and_links_of_neighbours_tell(tree):
    words = lambda n: " ".join(["word"] * n)
    article = [words(7), words(50), words(40), words(60)]
    page = ('<table><tr><td><a href="1">One</a><br><a href="2">Two more</a></td><td><h1>' + "</h1><p>".join(article[:2]) + "</p><p>"
            + "</p><p>".join(article[2:]) + '</p></td></tr></table><p><a href="c">Contact</a></p>')
    assert html_blocks.main_text(page, tree) == "\n".join(article)


def test_held_out_blocks(tree):
    """Accuracy on invented pages of another seed, and what the neighbours' numbers are."""
    table = html_blocks.labelled(150, seed=9)
    right = [tree.keeps(row[:-1]) == bool(row[-1]) for row in table.itertuples(index=False)]
    assert sum(right) / len(right) > 0.98 and 0.1 < table["label"].mean() < 0.9
    found = html_blocks.blocks('<div><a href="x">one two</a> three four</div><p>five</p>')
    assert [f[:6] for f in html_blocks.features(found)] == [(4, 0.5, 0, 0, 1, 0), (1, 0, 4, 0.5, 0, 0)]


def test_any_bytes_parse(tree):
    """Random pieces of markup never fail, and text without markup is kept or dropped whole."""
    random.seed(4)
    pieces = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<", ">", "&amp;", "&#x;", "text ", "<script>", "</script>", "<!--", "-->",
              '"', "'", "<li>", "<table>", "<td", "</", "<br/>", "<![CDATA[x]]>", "<?php ?>", "<svg/>", "\x00", "😀", "<article>", "</article>"]
    for _ in range(400):
        page = "".join(random.choices(pieces, k=30))
        assert all(b.words and b.text == " ".join(b.text.split()) for b in html_blocks.blocks(page))
        html_blocks.main_text(page, tree)


def test_edges(spark, tree):
    """Null, empty, repeated and clashing rows, an empty table."""
    got = html_blocks.extract(documents(spark).selectExpr("*", "concat('<article><p>', text) as html"), tree=tree)
    assert got.columns == [*documents(spark).columns, "html"] and got.count() == documents(spark).count()
    for r in got.collect():
        assert r.text == " ".join((r.html or "").replace("<article><p>", "").replace("<|endoftext|>  <s>", "<|endoftext|>").split())
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string"), tree=tree).collect() == []
