"""Main text of web pages: flat text blocks, judged by a decision tree over their words and links."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Numbers that the tree sees of a block: its own and its neighbours' words and link densities, and whether page marks
#: say that it is boilerplate, article or a heading.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "inside", "heading")
#: Words beyond this many say nothing more about a block.
MOST_WORDS = 60

# Elements whose text no reader sees or that belong to a form control; read to their end tag.
HIDDEN = ("script", "style", "title", "textarea", "template", "noscript", "iframe", "object", "svg", "math", "canvas",
          "audio", "video", "select", "button", "datalist", "xmp", "noembed", "noframes")
# Elements that begin and end a block.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements without an end tag; elements that a new block ends.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SHORT = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "li", "option", "td", "th", "tr", "caption", "legend", "summary"))
NESTS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"),
         "tr": ("table", "tbody", "thead", "tfoot")}
# What names boilerplate as element, role, or word of a class or id.
MARK_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "search"))
MARK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARK_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs byline-links captcha
comment comments commentlist consent cookie cookies copyright dialog disclaimer disqus donate feedback footer footnote-nav form gdpr header
login masthead menu menubar meta-nav modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup
privacy promo promotion promoted recommended related replies respond search share sharing sidebar sidebars signin signup skip social sponsor
sponsored subscribe subscription tags teaser teasers toolbar topbar trending widget widgets""".split())
COMMENT_WORDS = frozenset(("comment", "comments", "commentlist", "disqus", "replies", "respond", "feedback"))
# What names the article.
INSIDE_TAGS = frozenset(("article", "main"))
INSIDE_WORDS = frozenset("article articlebody story entry post-body post-content entry-content article-body article-content main-content".split())
# A header of one of these is the article's own.
OWN_HEADER = frozenset(("article", "post", "entry", "story"))

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in HIDDEN}
_BARE = re.compile(r"(?:^|\s)hidden(?:\s|$|/)", re.I)


@dataclass
class Block:
    """A flat piece of text with what is known about it."""

    text: str
    words: int
    linked: int
    boiler: int
    inside: int
    heading: int


def _marks(tag: str, rest: str, inside: int) -> tuple[bool, bool, bool]:
    """Whether a start tag says boilerplate, boilerplate for good (reader comments and the like), article."""
    attrs = {}
    if rest and not rest.isspace():
        for name, *values in _ATTRIBUTE.findall(rest):
            attrs.setdefault(name.lower(), "".join(values))
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower()
    parts = set(re.split(r"[\s_-]+", names)) if names.strip() else set()
    whole = set(names.split())
    role = attrs.get("role", "").lower()
    if tag in ("html", "body"):
        return False, False, False
    if tag in INSIDE_TAGS:
        return bool(whole & COMMENT_WORDS), bool(whole & COMMENT_WORDS), True
    words = (parts & MARK_WORDS) - ({"header"} if inside or parts & OWN_HEADER else set())
    hidden = "hidden" in rest.lower() and (bool(_BARE.search(rest)) or attrs.get("aria-hidden") == "true") or bool(
        re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))
    firm = bool(parts & COMMENT_WORDS) or tag in ("aside", "nav", "footer") or hidden
    boiler = firm or bool(words) or tag in MARK_TAGS or role in MARK_ROLES or (tag == "header" and not inside)
    return boiler, firm, role == "main" or bool((whole | parts) & INSIDE_WORDS) or attrs.get("itemprop") == "articleBody"


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, without hidden elements, comments and markup.

    A block ends where a block element begins or ends; line breaks and inline elements are within it.
    Open elements are kept on a stack with their marks, so that stray end tags and missing ones do no harm.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, boiler (2: for good), inside, heading
    opened: dict[str, int] = {}
    texts: list[str] = []
    linked: list[str] = []
    in_link = False

    def close() -> None:
        nonlocal texts, linked
        if texts:
            words = html.unescape("".join(texts)).split()
            if words:
                top = stack[-1] if stack else ("", 0, 0, 0)
                found.append(Block(" ".join(words), len(words), len(html.unescape("".join(linked)).split()), int(top[1] > 0), top[2], top[3]))
            texts, linked = [], []

    def pop() -> None:
        tag = stack.pop()[0]
        opened[tag] -= 1

    def text(part: str) -> None:
        if part:
            texts.append(part)
            linked.append(part if in_link else " ")

    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at:match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            if match[0].startswith("<![CDATA["):
                text(html.escape(match[0][9:-3], quote=False))
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                close()
                if tag not in ("p", *HEADINGS):
                    in_link = False
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            continue
        rest = match[3] or ""
        if tag in HIDDEN:
            if not rest.endswith("/") or tag not in ("svg", "math", "canvas", "iframe", "object"):
                end = _END[tag].search(page, at)
                at = end.end() if end else size
            text(" ")
            continue
        if tag == "a":
            in_link = True
        elif tag in ("br", "img", "wbr", "input"):
            text(" " if tag != "wbr" else "")
        elif tag in BLOCKS:
            close()
            while stack and stack[-1][0] in SHORT and not _nested(stack[-1][0], tag):
                pop()
            if tag not in VOID:
                _, boiler, inside, heading = stack[-1] if stack else ("", 0, 0, 0)
                mark, firm, article = _marks(tag, rest, inside)
                if article and tag in INSIDE_TAGS and boiler == 1 and not firm:
                    boiler = 0  # a form or wrapper around an article is none of its parts
                stack.append((tag, max(boiler, 2 if firm else 1 if mark else 0), max(inside, 2 if tag in INSIDE_TAGS else 1 if article else 0),
                              1 if tag in HEADINGS else 0))
                opened[tag] = opened.get(tag, 0) + 1
    close()
    return found


def _nested(outer: str, tag: str) -> bool:
    """Whether an open element stays open when the block ``tag`` begins inside it."""
    if outer in ("p", "option", *HEADINGS, "legend", "summary"):
        return False
    if outer == "tr":
        return tag in ("td", "th")
    if outer in ("li", "dt", "dd", "td", "th"):
        return tag not in (outer, *{"dt": ("dd",), "dd": ("dt",), "td": ("th", "tr", "tbody"), "th": ("td", "tr", "tbody")}.get(outer, ()))
    return tag not in BLOCKS


def features(found: Sequence[Block]) -> list[tuple[float, ...]]:
    """The numbers :data:`FEATURES` of each block of a page; beyond the ends of a page are no words."""
    numbers = [(0.0, 0.0), *((float(min(b.words, MOST_WORDS)), round(b.linked / b.words, 3)) for b in found), (0.0, 0.0)]
    return [(*numbers[i + 1], *numbers[i], *numbers[i + 2], float(b.boiler), float(b.inside), float(b.heading)) for i, b in enumerate(found)]


# --- the labelled table ------------------------------------------------------------------------

def _prose(rng: random.Random, low: int, high: int) -> str:
    return " ".join("w" * rng.randint(2, 9) for _ in range(rng.randint(low, high)))


def _list(rng: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_prose(rng, 1, 3)}</a></li>' for i in range(n)) + "</ul>"


def _article(rng: random.Random) -> str:
    """Title, paragraphs from one word to many, some with links, quotes, lists and subtitles."""
    parts = [f"<h1>{_prose(rng, 2, 12)}</h1>"]
    for _ in range(rng.randint(1, 9)):
        words = rng.choice(((1, 3), (4, 12), (20, 60), (60, 120)))
        kind = rng.random()
        if kind < 0.6:
            parts.append(f"<p>{_prose(rng, *words)}</p>")
        elif kind < 0.75:
            parts.append(f'<p>{_prose(rng, 8, 40)} <a href="/x">{_prose(rng, 1, 6)}</a> {_prose(rng, 2, 20)}</p>')
        elif kind < 0.8:
            parts.append(f'<p><a href="/x">{_prose(rng, 3, 9)}</a></p>')
        elif kind < 0.9:
            parts.append(f"<h2>{_prose(rng, 1, 6)}</h2><p>{_prose(rng, 15, 60)}</p>")
        else:
            parts.append(f"<blockquote>{_prose(rng, 5, 40)}</blockquote><ul><li>{_prose(rng, 2, 9)}</li><li>{_prose(rng, 2, 9)}</li></ul>")
    return "".join(parts)


def _page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as parts with their labels, 1 for the article. Most boilerplate bears a mark, most articles too."""
    def boiler(mark: str, inner: str) -> tuple[str, int]:
        tag, name = mark.split(".")
        return (f'<{tag} class="{name}">{inner}</{tag}>' if rng.random() < 0.75 else f"<div>{inner}</div>"), 0

    def marked(mark: str, inner: str) -> tuple[str, int]:
        tag, name = mark.split(".")
        return f'<{tag} class="{name}">{inner}</{tag}>', 0

    parts = [boiler("nav.menu", _list(rng, rng.randint(2, 9)))]
    if rng.random() < 0.4:
        parts.append(marked("header.top", f"<p>{_prose(rng, 1, 8)}</p>"))
    if rng.random() < 0.6:
        parts.append(marked("div.ad", _prose(rng, 1, 40)))
    if rng.random() < 0.3:
        parts.append(marked("div.cookie-notice", f"<p>{_prose(rng, 10, 50)}</p>"))
    tag = rng.choice(("article", "article", "main", 'div class="entry-content"', "div"))
    if tag == "div":  # without a mark only longer paragraphs tell an article
        parts.append((f"<div><h1>{_prose(rng, 3, 12)}</h1>" + "".join(f"<p>{_prose(rng, 25, 90)}</p>" for _ in range(rng.randint(2, 6)))
                      + "</div>", 1))
    else:
        parts.append((f"<{tag}>{_article(rng)}", 1))
        within = [("div.ad", _prose(rng, 1, 60)), ("div.newsletter", f"<p>{_prose(rng, 4, 30)}</p>"), ("div.share", _list(rng, 3)),
                  ("aside.note", f"<p>{_prose(rng, 10, 60)}</p>"), ("form.poll", f"<p>{_prose(rng, 2, 20)}</p>"),
                  ("section.comments", "".join(f"<p>{_prose(rng, 1, 70)}</p>" for _ in range(rng.randint(1, 5))))]
        for mark, inner in rng.sample(within, rng.randint(0, 3)):
            parts += [marked(mark, inner), ("".join(f"<p>{_prose(rng, *rng.choice(((1, 4), (10, 60))))}</p>" for _ in range(rng.randint(1, 3))), 1)]
        if rng.random() < 0.3:  # a list of links that nothing marks
            parts.append((_list(rng, rng.randint(3, 7)), 0))
        parts.append((f"</{tag.split()[0]}>", 1))
    if rng.random() < 0.4:
        parts.append(marked("section.comments", "".join(f"<p>{_prose(rng, 1, 60)}</p>" for _ in range(rng.randint(1, 5)))))
    if rng.random() < 0.4:
        parts.append(marked("aside.sidebar", f"<p>{_prose(rng, 5, 40)}</p>" + _list(rng, rng.randint(2, 6))))
    if rng.random() < 0.3:
        parts.append(marked("form.search", f"<p>{_prose(rng, 1, 9)}</p>"))
    parts.append(boiler("div.footer", rng.choice((f"<p>{_prose(rng, 1, 12)}</p>" + _list(rng, rng.randint(2, 4)),
                                                  f'<p><a href="/c">{_prose(rng, 1, 3)}</a></p>'))))
    return parts


def labelled(pages: int = 300, seed: int = 42) -> pd.DataFrame:
    """The labelled table: :data:`FEATURES` and label of the blocks of ``pages`` invented pages."""
    rng, rows = random.Random(seed), []
    for _ in range(pages):
        parts = _page(rng)
        labels = [label for part, label in parts for _ in blocks(part)]
        found = blocks("<html><body>" + "".join(part for part, _ in parts) + "</body></html>")
        rows += [(*numbers, float(label)) for numbers, label in zip(features(found), labels)]
    return pd.DataFrame(rows, columns=[*FEATURES, "label"])


@dataclass(frozen=True)
class BlockTree:
    """A decision tree as nested (feature, threshold, low, high) with labels as leaves."""

    root: tuple | int

    def keeps(self, numbers: Sequence[float]) -> bool:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if numbers[node[0]] <= node[1] else node[3]
        return bool(node)


def fit(spark: SparkSession, table: pd.DataFrame | None = None, depth: int = 7) -> BlockTree:
    """Train the tree on a labelled table, by default :func:`labelled`; its size is its parameter, never the corpus'."""
    table = labelled() if table is None else table
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spark.createDataFrame(table).coalesce(1))
    model = DecisionTreeClassifier(labelCol="label", maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=42).fit(rows)

    def plain(node):
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        return node.split().featureIndex(), node.split().threshold(), plain(node.leftChild()), plain(node.rightChild())
    return BlockTree(plain(model._call_java("rootNode")))


def main_text(page: str | None, tree: BlockTree) -> str:
    """The kept blocks of a page, one a line."""
    found = blocks(page)
    return "\n".join(b.text for b, numbers in zip(found, features(found)) if tree.keeps(numbers))


def extracted(tree: BlockTree, page: str | Column = "html") -> Column:
    """Main text of each page; null and empty pages have an empty one."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype="object")
    return run(page)


def extract(pages: DataFrame, page: str = "html", tree: BlockTree | None = None) -> DataFrame:
    """``pages`` with text, the main text of each page (an existing column of this name is replaced).

    Whole pages are read and nothing is capped. A null or empty page and one without an article have an
    empty text; repeated rows are read each by itself; other columns come through; an empty table gives no rows.
    """
    return pages.withColumn("text", extracted(fit(pages.sparkSession) if tree is None else tree, F.col(page)))
