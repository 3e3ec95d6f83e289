import html as stdlib_html
from html.parser import HTMLParser

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from weblake.functions import html as H
from weblake.functions.dates import first_date
from weblake.functions.selectors import compile_selector
from weblake.functions.text import (decode_entities, erase_marks, first_nonempty, first_quoted, flat_distinct,
                                    remove_space)
from weblake.operators import images as I, nodes as N, rules as R
from weblake.operators.links import hrefs


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://h/{i}/x", h) for i, h in enumerate(htmls)],
                                 "page_id bigint, url string, html string")


def one(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(expression).collect()]


def test_entities(spark):
    texts = ["a &amp; b", "&amp;lt;", "&#65;&#x42;&#X43;", "&eacute;&hellip;&nbsp;", "&nosuch; & &#0; &#55300;", "&#128512;",
             "no reference", "&quot;q&quot;", "&amp;#38;"]
    want = [stdlib_html.unescape(t) for t in texts]
    want[4] = texts[4]  # unknown and invalid references stay as written
    assert one(spark, decode_entities(F.col("t")), *texts) == want


def test_text_functions(spark):
    assert one(spark, erase_marks(F.col("t")), "a•b$c?d\\e'f\"g") == ["a b c?d e f g"]
    assert one(spark, remove_space(F.col("t")), " a\tb\n\x0b\f\rc d") == ["abc d"]
    assert one(spark, first_quoted(F.col("t")), "f('x','y')", "plain", "f('')", "it's") == ["x", "plain", "", "it's"]
    arrays = spark.sql("select array('', null, 'b', 'a', 'b') as x, array(array('b', ''), array('a', 'b'), null) as y")
    row = arrays.select(first_nonempty(F.col("x")), flat_distinct(F.col("y"))).first()
    assert list(row) == [["b"], ["b", "a"]]


def test_dates(spark):
    cases = {"on 2012-03-07 x": "2012-03-07", "2012/3/7": "2012-03-07", "7 March 2012": "2012-03-07",
             "MARCH 7, 2012": "2012-03-07", "2012-02-31": None, "12012-03-07": None, "no": None, "": None,
             "posted 1 May 2010, changed 2011-01-01": "2010-05-01", "2012-3/7": None}
    assert one(spark, first_date(F.col("t")), *cases) == list(cases.values())


def test_titles(spark):
    cases = {"": "", "<p>x</p>": "", "<title></title><TITLE a='>'>b &amp; c</title>": "b & c",
             "<!-- <title>no</title> --><title>yes</title>": "yes",
             "<script>'<title>no</title>'</script><title>one</title><title>two</title>": "one"}
    assert one(spark, H.title(F.col("t")), *cases) == list(cases.values())


class Hrefs(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.found = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v is not None][:1]


def test_hrefs(spark):
    texts = ["<a href=x>1</a><A HREF='y z'>2</A>", "<a class=k title='href=\"no\"' href=\"?a=1&amp;b=2\">", "<a name=n>",
             "<!-- <a href=no> --><script>\"<a href=no>\"</script><style><a href=no></style><a href=yes>",
             "<abbr href=no><a\nhref = 'q'\n>", "<a href=''>", "<a data-href=no href=yes href=second>", "<a href=a/b/>"]
    assert one(spark, hrefs(F.col("t")), *texts) == [Hrefs(t).found for t in texts]


PIECE = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='c'>", "</div>", "text ", "a < b", "<br>", "<img src=i alt='>'>",
                         "<!-- <p> -->", "<script>var t='</p>';</script>", "<a href=\"l\">", "</a>", "<li>", "</ul>", "&amp;"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECE, max_size=40).map("".join), min_size=5, max_size=20))
def test_tokens_and_nodes_hold_for_any_markup(spark, htmls):
    df = pages(spark, *htmls)
    back = {r.page_id: r.t for r in df.select("page_id", F.array_join(H.tokens(F.col("html")), "").alias("t")).collect()}
    assert [back[i] for i in range(len(htmls))] == htmls  # nothing of the page is lost
    rows = N.nodes(df).collect()
    for page_id in range(len(htmls)):
        mine = [r for r in rows if r.page_id == page_id]
        elements = [r for r in mine if r.kind == "elem"]
        assert [r.node_no for r in elements] == list(range(len(elements)))
        assert all(r.parent_no < r.node_no for r in elements)
        by_no = {r.node_no: r for r in elements}
        for r in elements:
            above = by_no.get(r.parent_no)
            assert r.path.startswith((above.path if above else "") + f"/{r.tag}[")
            assert r.depth == (above.depth + 1 if above else 0)
        assert [r.ord for r in mine] == sorted(r.ord for r in mine)


def test_unclosed_elements(spark):
    rows = N.nodes(pages(spark, "<div><p><b>x<br><p>y</p>z<ul><li>1<li>2</ul></div>")).collect()
    parent = {r.node_no: r.parent_no for r in rows if r.kind == "elem"}
    tags = {r.node_no: r.tag for r in rows if r.kind == "elem"}
    assert [(tags[n], tags.get(parent[n])) for n in sorted(tags)] == [
        ("div", None), ("p", "div"), ("b", "p"), ("br", "b"), ("p", "div"), ("ul", "div"), ("li", "ul"), ("li", "ul")]
    assert [(r.text, r.tag) for r in rows if r.kind == "text"] == [
        ("x", "b"), ("y", "p"), ("z", "div"), ("1", "li"), ("2", "li")]


def test_page_text(spark):
    html = ("<html><head>no<title>T &amp; t</title></head><body> a <a>no<b>yes</b></a><noscript>no</noscript>"
            "<form>no<p>in form</p></form><option>no</option><style>no</style><script>no</script></body></html>")
    df = N.parse(pages(spark, html, ""))
    assert [r.pagetext for r in N.page_text(df).orderBy("page_id").collect()] == ["T&tayesinform", ""]
    assert N.page_text(df, squeeze=False).orderBy("page_id").first().pagetext == "T & t a yesin form"


def test_nearest_date(spark):
    html = ("<div><p>2012-01-01</p><img src=a><p>2012-02-02</p><img src=b><img src=c>"
            "<div class='my comments'><p>2013-01-01</p></div><noscript>2014-01-01</noscript></div>")
    parsed = N.parse(pages(spark, html, "<img src=d alt='&lt;'><img src=''><img>"))
    got = I.nearest_date(I.images(parsed), I.date_mentions(parsed)).orderBy("page_id", "node_no").collect()
    assert [(r.src, r.alt, r.postdate) for r in got] == [
        ("http://h/0/a", "", "2012-01-01"),  # both neighbours one step away: the earlier
        ("http://h/0/b", "", "2012-02-02"), ("http://h/0/c", "", "2012-02-02"), ("http://h/1/d", "<", "")]


def test_nearest_date_against_all_pairs(spark):
    images = spark.range(300).selectExpr("id % 7 as page_id", "cast(id * 37 % 101 as int) as node_no", "id")
    dates = spark.range(40).selectExpr("id % 6 as page_id", "cast(id * 53 % 97 as int) as node_no",
                                       "cast(id as string) as date").dropDuplicates(["page_id", "node_no"])
    got = {r.id: r.postdate for r in I.nearest_date(images, dates).collect()}
    marks = dates.collect()
    for r in images.collect():
        near = sorted((abs(m.node_no - r.node_no), m.node_no, m.date) for m in marks if m.page_id == r.page_id)
        assert got[r.id] == (near[0][2] if near else "")


def test_dated_images_need_no_shuffle(spark):
    spans = ["".join("<img src=x>" if (7 * i + n * n) % 5 < 2 else f"<p>2012-{1 + i % 12:02}-{1 + i % 28:02}</p>" if (i * n) % 3 else "<b>t</b>"
                     for i in range(60)) for n in range(12)]
    parsed = N.parse(pages(spark, *spans, "<img src=y>", "<p>2012-01-01</p>", ""))
    got = I.dated_images(parsed, I.images_of(F.col("nodes")), I.dates_of(F.col("nodes")))
    want = I.nearest_date(I.images(parsed), I.date_mentions(parsed))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [sorted((r.page_id, r.node_no, r.src, r.alt, r.postdate) for r in df.collect()) for df in (got, want)]
    assert rows[0] == rows[1] and len({r[4] for r in rows[0]}) > 10


def test_selectors():
    for good in ("//title/text()", "/html/body//p[2]/text()", "//div[@class='a']//img/@src", "//*[contains(@id, \"x\")]/@href",
                 "//a/@href | //area/@href", "//article//text()", "//a[2][@rel='x' and starts-with(@id, \"y]\")]/@href",
                 "//*[@role='a' or contains(@class,'b') and @type='c'][@id='d']/text()", "//div[last()]/text()",
                 "//p[@style='x']/text()", "//a/@href | //b/text()", "//div[@class='a'][2]/text()", "(//a)[1]/@href", "(//a/@href)[last()]",
                 "//h1/following-sibling::p[1]/text()", "//b/../@id", "//li[not(@class) and a[@href]]/text()", "//a[text()='x']/@data-src"):
        assert compile_selector(good)[1] is None, good
    for bad in ("//div", "title", "//following::p/text()", "", "//p[@id='a' and]/text()", "//p[@id='a')]/text()",
                "//p[contains(@id,'a']/text()", "//p[@id='a' xor @id='b']/text()", "//p[lang('de')]/text()", "//p[contains(@id)]/text()",
                "//@id/text()", "(//a/@href | //b/@src)[1]", "//p[", "//text()/b/text()", "//p/text() x"):
        assert compile_selector(bad)[1], bad


def found_by(spark, html, selectors):
    """What each selector takes from a page."""
    seeds = spark.createDataFrame([(i, s) for i, s in enumerate(selectors)], "id bigint, title_xpath string")
    assert R.rejected_rules(R.rules_from_seeds(seeds)).collect() == []
    parsed = R.parse_for_rules(pages(spark, *[html] * len(selectors)).withColumn("seed_id", F.col("page_id")), ("page_id", "url", "seed_id"))
    ruled = R.with_rules(parsed, R.seed_rules(R.rules_from_seeds(seeds)))
    rows = R.selected(ruled, ["title_xpath"]).select("page_id", R.matches("title_xpath").alias("m")).orderBy("page_id").collect()
    return dict(zip(selectors, (r.m for r in rows)))


def test_axes_and_predicates(spark):
    html = ("<html><body><h1 id=t>T<b>x</b></h1><p>1</p><p class=k>2 &amp; 3</p><ul id=u><li class=a><a href=l1>one</a></li>"
            "<li><a href=l2 rel=n>two</a><i>i</i></li><li>three<ul><li>deep</li></ul></li></ul><div><p>4</p></div><p> 5 </p></body></html>")
    want = {
        "//li[last()]/text()": ["three", "deep"], "//ul/li[position()<3]/a/text()": ["one", "two"], "//p[@class]/text()": ["2 & 3"],
        "//p[not(@class)]/text()": ["1", "4", " 5 "], "//li[i]/a/@href": ["l2"], "//b/../@id": ["t"], "//a[text()='two']/@href": ["l2"],
        "//h1/following-sibling::p[1]/text()": ["1"], "//h1/following-sibling::p[last()]/text()": [" 5 "], "(//a)[1]/@href": ["l1"],
        "(//p)[last()]/text()": [" 5 "], "(//a/@href)[2]": ["l2"], "//li[@class='a' or a/@rel]/a/text()": ["one", "two"],
        "//ul[@id='u']/li[2]/*[1]/text()": ["two"], "//div/preceding-sibling::p[1]/text()": ["2 & 3"], "//i/ancestor::ul/@id": ["u"],
        "//p[.='2 & 3']/@class": ["k"], "//h1[contains(., 'Tx')]/@id": ["t"], "//p[normalize-space()='5']/text()": [" 5 "],
        "//li[count(a)=0]/text()": ["three", "deep"], "//ul//li[last()-1]/a/@href": ["l2"], "//body/*[3]/@class": ["k"],
        "//a/@href | //b/text()": ["x", "l1", "l2"], "//li/a/@*": ["l1", "l2", "n"], "//descendant::li[4]/text()": ["deep"],
        "//p[position()=2 and @class]/text()": ["2 & 3"], "//p[2][@class]/text()": ["2 & 3"], "//p[@class][2]/text()": [],
        "//li//text()": ["one", "two", "i", "three", "deep"], "//li[.//i]/a/@rel": ["n"], "/html/body/div/p/text()": ["4"],
    }
    assert found_by(spark, html, list(want)) == want


def test_selectors_reach_any_depth(spark):
    html = "<div>" * 2000 + "<p id=x>deep</p>" + "</div>" * 2000
    assert found_by(spark, html, ["//p/text()", "//div/p/@id", "//div[p]/p/text()"]) == {
        "//p/text()": ["deep"], "//div/p/@id": ["x"], "//div[p]/p/text()": ["deep"]}


def test_extract_fields(spark):
    html = ("<html><head><title>Shop</title></head><body><div class='name big'>Shoe<b>!</b></div>"
            "<div class='name'>Shoe</div><ul><li id='c1'>red</li><li>blue</li></ul><span id='a/b'>9.90</span>"
            "<img src=''><img src=' /i.jpg '><img src='j.jpg'><em data-x=1>n</em></body></html>")
    seeds = spark.createDataFrame([(1, "//div[contains(@class,'name')]/text()", "//ul/li[2]/text()", "//span[@id='a/b']/text()",
                                    "//img/@src", "//img/@src", "/html/body/em/text()", "//b[", None)],
                                  "id bigint, title_xpath string, color_xpath string, price_xpath string, "
                                  "mainimageurl_xpath string, imageurl_xpath string, size_xpath string, "
                                  "brand_xpath string, productid_xpath string")
    rules = R.rules_from_seeds(seeds)
    assert [(r.seed_id, r.field) for r in R.rejected_rules(rules).collect()] == [(1, "brand_xpath")]
    df = pages(spark, html, html).withColumn("seed_id", F.col("page_id") + 1)
    parsed = R.parse_for_rules(df, ("page_id", "url", "seed_id"))
    known, unknown = R.extract_fields(R.with_rules(parsed, R.seed_rules(rules))).orderBy("page_id").collect()
    assert (known.title, known.color, known.price, known.size, known.brand, known.productid) == (
        "Shoe", "blue", "9.90", "n", "", "")
    assert known.mainimageurl == "http://h/i.jpg" and known.main_images == ["http://h/i.jpg"]
    assert known.image_urls == ["http://h/i.jpg", "http://h/0/j.jpg"]
    assert (unknown.title, unknown.mainimageurl, unknown.main_images) == ("", "", [])


def test_conditions_of_predicates(spark):
    html = ("<p id=a class='x y'>1</p><p id=ab class=y>2</p><p id=b role=main>3</p><p id=c class='x'>4</p>"
            "<p role=main class=y>5</p>")
    wanted = {"//p[@id='b' or contains(@class,'x')]/text()": "134", "//p[starts-with(@id,'a') and @class='y']/text()": "2",
              "//p[@class='y' and @role='main' or @id='a']/text()": "15", "//p[contains(@class,'y')][@id='a' or @role='main']/text()": "15",
              "//p[2][starts-with(@id, 'a')]/text()": "2", "//p[starts-with(@class,'y') or @id='q']/text()": "25"}
    seeds = spark.createDataFrame([(i, s) for i, s in enumerate(wanted)], "id bigint, title_xpath string")
    found = pages(spark, *[html] * len(wanted)).withColumn("seed_id", F.col("page_id"))
    parsed = R.parse_for_rules(found, ("page_id", "url", "seed_id"))
    got = R.extract_fields(R.with_rules(parsed, R.seed_rules(R.rules_from_seeds(seeds)))).orderBy("page_id").collect()
    assert [r.title for r in got] == list(wanted.values())


def test_list_links(spark):
    seeds = spark.createDataFrame([(1, "//ul//a/@href", "//a[@class='next']/@href")],
                                  "id bigint, detailurl_xpath string, nextpage_xpath string")
    html = "<ul><a href='p1'>1</a><a href='p2.jpg'>2</a><a href='p1'>1</a></ul><a class='next' href='l2/'>n</a>"
    parsed = R.parse_for_rules(pages(spark, html).withColumn("seed_id", F.lit(1).cast("bigint")),
                               ("page_id", "url", "seed_id"))
    got = R.extract_list_links(R.with_rules(parsed, R.seed_rules(R.rules_from_seeds(seeds)))).collect()
    assert [(r.pagetype, r.priority, r.pos, r.link) for r in got] == [
        (31, 0, 0, "http://h/0/p1"), (31, 0, 2, "http://h/0/p1"), (3, 1, 0, "http://h/0/l2/")]


def test_images_as_of(spark):
    df = pages(spark, "<img src='a.png' alt='x'><img src=''><IMG alt=no><!-- <img src=no> --><img src=b>")
    got = I.images_as_of(df, F.lit("2012-01-01")).collect()
    assert [(r.src, r.alt, r.postdate) for r in got] == [
        ("http://h/0/a.png", "x", "2012-01-01"), ("http://h/0/b", "", "2012-01-01")]


def test_broken_pages_stay_cheap(spark):
    deep = "<div class='k'>" * 5000 + "<p>x" + "</div>" * 5000
    unfinished = "<a" * 20000 + "<p>y</p>"
    stray = "a < 1 " * 20000
    rows = N.page_text(N.parse(pages(spark, deep, unfinished, stray))).select("page_id", F.length("pagetext")).collect()
    assert {r[0]: r[1] for r in rows}[0] == 1 and {r[0]: r[1] for r in rows}[2] == 60000
    elements = N.nodes(pages(spark, deep)).filter("kind = 'elem'")
    assert elements.count() == 5001 and elements.agg(F.max("depth")).first()[0] == 5000
    assert elements.agg(F.max(F.length("path"))).first()[0] < 20_000


def test_nesting_below_the_path_depth_is_kept(spark):
    """Below 256 elements parents, end tags and text stay right; only the paths end."""
    html = "<div>" * 300 + "<a href=/x>link<i>in</i></a>deep" + "</div>" * 299 + "<p>up</p></div>after"
    rows = {(r.kind, r.tag, r.text): r for r in N.nodes(pages(spark, html)).collect()}
    inner = rows["text", "i", "in"]
    assert rows["elem", "i", "in"].parent_no == rows["elem", "a", "link"].node_no == 300 and inner.depth == 302
    assert rows["elem", "p", "up"].parent_no == 0 and rows["text", "div", "deep"].parent_no == 299
    text = N.page_text(N.parse(pages(spark, html))).first().pagetext
    assert text == "indeepupafter"


def test_slash_of_an_unquoted_value_does_not_close(spark):
    html = "<a href=/x/>LINK</a>after<br/><i class=y />z<b title='q'/>w<a href=/u/ />v"
    nodes = [(r.tag, r.attrs, r.text) for r in N.nodes(pages(spark, html)).filter("kind = 'elem'").collect()]
    assert nodes == [("a", {"href": "/x/"}, "LINK"), ("br", {}, ""), ("i", {"class": "y"}, ""), ("b", {"title": "q"}, ""),
                     ("a", {"href": "/u/"}, "")]
    assert N.page_text(N.parse(pages(spark, html))).first().pagetext == "afterzwv"


def test_references_with_leading_zeros(spark):
    from weblake.functions.text import decode_entities
    df = spark.createDataFrame([("&#x0000041;&#00000065;&#x110000;&#0;&#xD800;&#00128512;&copy;&nope;",)], "t string")
    assert df.select(decode_entities(F.col("t"))).first()[0] == "AA&#x110000;&#0;&#xD800;😀©&nope;"


def test_output_batches_are_cut_by_size(monkeypatch):
    import pyarrow as pa
    from weblake.operators import treepass
    monkeypatch.setattr(treepass, "BATCH_NODES", 3)
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, 4], "tokens": [["<p>", "x"], ["<p>", "y", "<b>"], None, ["z"]]})
    cut = list(treepass.node_arrays([batch], ()))
    assert [b.column("page_id").to_pylist() for b in cut] == [[1, 2], [3, 4]]
    assert [len(n) for b in cut for n in b.column("nodes").to_pylist()] == [2, 3, 0, 1]
