"""One linear pass that turns the tokens of a page into element and text rows.

The only step that runs in Python: error recovery needs a stack of open elements, which neither
windows nor array functions express without copying the stack per token.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa

VOID = frozenset(("area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta",
                  "param", "source", "track", "wbr"))
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_FONT = ("b", "i", "u", "s", "tt", "big", "small", "strike")
# A start tag on the left ends the open elements on the right.
IMPLIED_END = {
    "p": frozenset(("p", "head", *_HEADINGS, *_FONT)),
    "li": frozenset(("p", "li", *_HEADINGS)),
    "dt": frozenset(("p", "dt", "dd")),
    "dd": frozenset(("p", "dt", "dd")),
    "tr": frozenset(("p", "td", "th", "tr", "caption")),
    "td": frozenset(("p", "td", "th", *_FONT)),
    "th": frozenset(("p", "td", "th", *_FONT)),
    "option": frozenset(("option",)),
    "body": frozenset(("head", "title", "style", "script")),
    "a": frozenset(("a",)),
    **{block: frozenset(("p", "head")) for block in
       ("div", "ul", "ol", "dl", "table", "form", "pre", "hr", "address", "blockquote",
        "article", "section", "nav", "footer", "header", "aside", *_HEADINGS)},
}

# Paths are for readers of the node table; below this depth they end in DEEP, so that they stay short on broken pages.
PATH_DEPTH = 256
DEEP = "/!"
# Class or id of a block that holds reader comments contains one of these.
COMMENT_WORDS = ("comment", "feedback")
# An output batch is closed after this many nodes or characters of paths or texts.
BATCH_NODES, BATCH_CHARS = 20_000, 16_000_000
CHARS_A_NODE = BATCH_CHARS // BATCH_NODES

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:_-]*)")
_ESCAPE = str.maketrans({"%": "%25", "/": "%2F", '"': "%22"})

ATTRS = pa.map_(pa.string(), pa.string())
NODE = pa.struct([
    pa.field("ord", pa.int32()), pa.field("kind", pa.string()), pa.field("node_no", pa.int32()),
    pa.field("parent_no", pa.int32()), pa.field("depth", pa.int32()), pa.field("tag", pa.string()),
    pa.field("attrs", ATTRS), pa.field("text", pa.string()), pa.field("path", pa.string()),
    pa.field("in_comment", pa.bool_()),
])
NODE_DDL = ("array<struct<ord:int,kind:string,node_no:int,parent_no:int,depth:int,tag:string,"
            "attrs:map<string,string>,text:string,path:string,in_comment:boolean>>")


def _attributes(tag_text, name_end):
    """The attributes of a start tag, and whether a "/" at its end closes it.

    A "/" that ends an unquoted value belongs to the value.
    """
    found, bare_end = {}, -1
    for match in _ATTRIBUTE.finditer(tag_text, name_end):
        name, double, single, bare = match.groups(default="")
        found.setdefault(name.lower(), double or single or bare)
        bare_end = match.end() if bare else bare_end
    return found, tag_text.endswith("/>") and bare_end != len(tag_text) - 1


def page_rows(tokens, path_attrs):
    """Rows [ord, kind, node_no, parent_no, depth, tag, attrs, text, path, in_comment] in document order.

    ``text`` of a text row is that text node; of an element row, all its own text nodes joined.
    Without ``path_attrs`` there are no paths. ``in_comment`` looks at the elements around a node, not at the node itself.
    """
    rows, own_text = [], {}
    stack = []  # (node_no, tag, path, {tag: count of children}, [count of children], comment block)
    open_tags = Counter()  # an end tag without a start tag must not search the stack
    top_level = ({}, [0])
    node_no = -1
    for position, token in enumerate(tokens):
        if token[0] != "<" or not (token[1:2].isalpha() or token[1:2] == "/"):
            if token[:2] in ("<!", "<?"):
                continue
            if stack:
                owner = stack[-1]
                rows.append([position, "text", owner[0], owner[0], len(stack), owner[1], None, token,
                             owner[2], owner[5]])
                own_text.setdefault(owner[0], []).append(token)
            elif token.strip():  # outside all elements: text of the body that the page leaves out
                rows.append([position, "text", -1, -1, 1, "body", None, token,
                             None if path_attrs is None else "/body[1,1]", False])
            continue
        match = _NAME.match(token)
        tag = match.group(1).lower()
        if token[1] == "/":
            if open_tags[tag]:
                while open_tags[tag] and (closed := stack.pop()[1]):
                    open_tags[closed] -= 1
                    if closed == tag:
                        break
            continue
        ends = IMPLIED_END.get(tag)
        if ends:
            while stack and stack[-1][1] in ends:
                open_tags[stack.pop()[1]] -= 1
        node_no += 1
        by_tag, total = (stack[-1][3], stack[-1][4]) if stack else top_level
        by_tag[tag] = by_tag.get(tag, 0) + 1
        total[0] += 1
        content = None
        head = token
        if tag in ("script", "style"):
            cut = _tag_end(token)
            head, content = token[:cut], token[cut:]
            content = re.sub(rf"(?i)</{tag}\s*>$", "", content)
        attrs, closes = _attributes(head, match.end())
        path = None if path_attrs is None else stack[-1][2] if stack else ""
        if path is None:
            pass
        elif len(stack) < PATH_DEPTH:
            path += f"/{tag}[{by_tag[tag]},{total[0]}]" + "".join(
                f'@{a}="{attrs[a].translate(_ESCAPE)}"' for a in path_attrs if a in attrs)
        elif len(stack) == PATH_DEPTH:
            path += DEEP
        parent = stack[-1][0] if stack else -1
        in_comment = bool(stack) and stack[-1][5]
        rows.append([position, "elem", node_no, parent, len(stack), tag, attrs, None, path, in_comment])
        if content:
            rows.append([position, "text", node_no, node_no, len(stack) + 1, tag, None, content, path, in_comment])
            own_text[node_no] = [content]
        if tag not in VOID and tag not in ("script", "style") and not closes:
            open_tags[tag] += 1
            named = attrs.get("class", "") + " " + attrs.get("id", "")
            stack.append((node_no, tag, path, {}, [0], in_comment or any(w in named for w in COMMENT_WORDS)))
    for row in rows:
        if row[1] == "elem":
            row[7] = "".join(own_text.get(row[2], ()))
    return rows


def _tag_end(token):
    """Index after the ">" of the start tag of a script or style element."""
    quote = None
    for i, char in enumerate(token):
        if quote:
            if char == quote:
                quote = None
        elif char in "\"'" and token[:i].rstrip().endswith("="):
            quote = char
        elif char == ">":
            return i + 1
    return len(token)


def _batch(head, done, pages):
    """One output batch from the rows of some pages; ``head`` holds the kept columns."""
    rows = [row for page in pages for row in page]
    offsets, attr_offsets, keys, values = [0], [0], [], []
    for page in pages:
        offsets.append(offsets[-1] + len(page))
    for row in rows:
        if row[6]:
            keys.extend(row[6].keys())
            values.extend(row[6].values())
        attr_offsets.append(len(keys))
    attrs = pa.MapArray.from_arrays(pa.array(attr_offsets, pa.int32()),
                                    pa.array(keys, pa.string()), pa.array(values, pa.string()))
    columns = list(zip(*rows)) if rows else [()] * len(NODE)
    fields = [attrs if field.name == "attrs" else pa.array(column, field.type)
              for field, column in zip(NODE, columns)]
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                     pa.StructArray.from_arrays(fields, fields=list(NODE)))
    kept = head.slice(done, len(pages))
    return pa.RecordBatch.from_arrays([*kept.columns, nodes], names=[*kept.schema.names, "nodes"])


def node_arrays(batches, path_attrs):
    """Arrow batches with a ``tokens`` column last → the same with ``nodes`` in its place.

    Pages grow when parsed, so an output batch holds as many as fit the limits, at least one.
    """
    for batch in batches:
        head = batch.select(list(range(batch.num_columns - 1)))
        tokens = batch.column(batch.num_columns - 1)
        done, pages, nodes, chars = 0, [], 0, 0
        for i in range(batch.num_rows):
            page = page_rows(tokens[i].as_py() or (), path_attrs)
            pages.append(page)
            nodes += len(page)
            chars += sum(len(row[8] or row[7] or "") for row in page)
            if nodes >= BATCH_NODES or chars >= BATCH_CHARS:
                yield _batch(head, done, pages)
                done, pages, nodes, chars = i + 1, [], 0, 0
        if pages:
            yield _batch(head, done, pages)
