"""Extraction rules: XPath selectors as steps over the interval-numbered elements of a page.

A page is arrays: element 0 is the page, elements are numbered in document order, ``end`` is an element's last
descendant, so "below" is a test of an interval. A step takes all its context nodes at once and gives
(context, node) pairs; predicates thin the pairs out, ``position()`` and ``last()`` count within a context.
"""

from __future__ import annotations

import functools
import html
import re
from itertools import accumulate

import numpy as np

AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "following-sibling", "preceding-sibling")
_LEXER = re.compile(r"""\s*(?:(//|::|\.\.|<=|>=|!=|[/@.()\[\],|*=<>+-])|('[^']*'|"[^"]*")|(\d+(?:\.\d+)?)|([A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?))""")
_FUNCTIONS = {"contains": 2, "starts-with": 2, "not": 1, "position": 0, "last": 0, "normalize-space": 1, "count": 1, "string": 1,
              "string-length": 1, "true": 0, "false": 0}


def _attribute_last(group: tuple) -> list:
    """A group at the end of a path. Attributes are no nodes: ``(//a/@b)[1]`` is read as ``(//a[@b])[1]/@b``."""
    _, paths, predicates = group
    names = {p[-1][1] for p in paths if p[-1][0] == "attribute"}
    if not predicates or not names:
        return [group]
    if len(names) > 1 or any(p[-1][0] != "attribute" for p in paths):
        raise ValueError("all parts of a numbered union must take the same attribute")
    name = ("attribute", names.pop(), [])
    return [("group", [[*p[:-1], ("self", "node()", [("path", [name])])] for p in paths], predicates), name]


class _Parser:
    """Recursive descent over the tokens of one selector; what it does not know is a ValueError."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            match = _LEXER.match(text, at)
            if not match:
                raise ValueError(f"not understood: {text[at:].strip()!r}")
            self.tokens.append(match.group().strip())
            at = match.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or wanted and token not in wanted:
            raise ValueError(f"not understood: {' '.join(self.tokens[self.at:]) or 'the end'!r}" + (f", expected {wanted[0]}" if wanted else ""))
        self.at += 1
        return token

    def accept(self, *wanted: str) -> str:
        return self.take() if self.peek() in wanted and self.peek() else ""

    def union(self) -> list:
        paths = [self.path()]
        while self.accept("|"):
            paths.append(self.path())
        return paths

    def path(self) -> list:
        """Steps (axis, test, predicates); a group ("group", paths, predicates) may come first."""
        steps = []
        if self.accept("("):
            steps.append(("group", self.union(), None))
            self.take(")")
            steps[0] = (*steps[0][:2], self.predicates())
            if self.peek() not in ("/", "//"):
                return _attribute_last(steps[0])
        elif self.peek() not in ("/", "//"):
            steps.append(self.step())
        else:
            steps.append(("root", None, []))
        while token := self.accept("/", "//"):
            if token == "//":
                steps.append(("descendant-or-self", "node()", []))
            steps.append(self.step())
        return steps

    def step(self) -> tuple:
        if self.accept(".."):
            return "parent", "node()", self.predicates()
        if self.accept("."):
            return "self", "node()", self.predicates()
        if self.accept("@"):
            return "attribute", "*" if self.accept("*") else self.name(), []
        axis = "child"
        if self.peek(1) == "::":
            axis = self.take(*AXES, "attribute")
            self.take("::")
        if axis == "attribute":
            return axis, self.name(), []
        if self.peek() in ("text", "node") and self.peek(1) == "(":
            test = self.take() + "()"
            self.take("(")
            self.take(")")
        else:
            test = "*" if self.accept("*") else self.name()
        return axis, test, self.predicates()

    def name(self) -> str:
        token = self.take()
        if not re.match(r"[A-Za-z_]", token):
            raise ValueError(f"a name is expected, not {token!r}")
        return token.lower()

    def predicates(self) -> list:
        found = []
        while self.accept("["):
            found.append(self.either())
            self.take("]")
        return found

    def either(self) -> tuple:
        parts = [self.both()]
        while self.accept("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both(self) -> tuple:
        parts = [self.comparison()]
        while self.accept("and"):
            parts.append(self.comparison())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def comparison(self) -> tuple:
        left = self.sum()
        if how := self.accept("=", "!=", "<", "<=", ">", ">="):
            return "compare", how, left, self.sum()
        return left

    def sum(self) -> tuple:
        left = self.value()
        while how := self.accept("+", "-"):
            left = ("sum", how, left, self.value())
        return left

    def value(self) -> tuple:
        token = self.peek()
        if token[:1] in "'\"" and token:
            return "literal", self.take()[1:-1]
        if token[:1].isdigit():
            return "number", float(self.take())
        if self.peek(1) == "(" and token not in ("text", "node"):
            if token not in _FUNCTIONS:
                raise ValueError(f"unknown function {token!r}")
            name, args = self.take(), []
            self.take("(")
            while self.peek() != ")":
                args.append(self.either())
                if not self.accept(","):
                    break
            self.take(")")
            if len(args) != _FUNCTIONS[name] and not (name in ("normalize-space", "string", "string-length") and not args):
                raise ValueError(f"{name}() takes {_FUNCTIONS[name]} values")
            return "call", name, args
        if token == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        return "path", self.path()


_COMPILED = {}


def compile_selector(selector):
    """(paths, error): the paths of a selector, or why it is none. A path ends in text() or @attribute."""
    if selector not in _COMPILED:
        if len(_COMPILED) >= 8192:
            _COMPILED.clear()
        _COMPILED[selector] = _compiled(selector)
    return _COMPILED[selector]


def _compiled(selector):
    try:
        parser = _Parser(selector)
        paths = parser.union()
        if parser.at < len(parser.tokens):
            parser.take("the end")
        for steps in paths:
            last = steps[-1]
            if last[0] == "group" and all(p[-1][0] == "attribute" or p[-1][1] == "text()" for p in last[1]):
                continue
            if len(steps) < 2 or last[0] != "attribute" and last[1] != "text()":
                raise ValueError("must end in text() or @attribute")
        if any(s[0] == "attribute" or s[1] == "text()" for steps in paths for s in steps[:-1]):
            raise ValueError("text() and @attribute come last")
        return paths, None
    except (ValueError, RecursionError) as problem:
        return None, str(problem)


def _counted(owners):
    """(position, last) of each entry within its owner; entries of an owner stand together."""
    if not len(owners):
        return owners, owners
    starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
    sizes = np.diff(np.append(starts, len(owners)))
    return np.arange(len(owners)) - np.repeat(starts, sizes) + 1, np.repeat(sizes, sizes)


def _spans(first, last):
    """(owner, value) of all values from ``first`` to ``last`` of each owner."""
    sizes = np.maximum(last - first + 1, 0)
    owners = np.repeat(np.arange(len(first)), sizes)
    return owners, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


class Page:
    """One page's elements and texts as arrays; text t is node ``len(tag) + t``, attributes are no nodes."""

    def __init__(self, parents, tags, attrs, owners, texts, places):
        """``parents`` and ``owners`` count elements from 0, -1 is the page; ``places`` are the tokens of the
        elements, then of the texts."""
        n = len(tags) + 1
        self.n, self.attrs, self.texts = n, [{}, *attrs], texts
        self.tag = np.array(["", *tags], object)
        self.parent = np.array([-2, *parents, *owners], np.int64) + 1
        self.place = np.array([-1, *places], np.int64) * 2
        self.place[n:] += 1  # the text of a script stands at its element's token
        self.by_tag, self.tests = {}, {}
        for i, tag in enumerate(tags, 1):
            self.by_tag.setdefault(tag, []).append(i)

    @functools.cached_property
    def end(self):
        """Last descendant of each element."""
        end, up = list(range(self.n)), self.parent[:self.n].tolist()
        for i in range(self.n - 1, 0, -1):
            if end[i] > end[up[i]]:
                end[up[i]] = end[i]
        return np.array(end, np.int64)

    @functools.cached_property
    def children(self):
        """Children of each element in document order, those of an element from ``first``, ``size`` of them."""
        return np.lexsort((self.place, self.parent))[1:]

    @functools.cached_property
    def first(self):
        return np.searchsorted(self.parent[self.children], np.arange(self.n))

    @functools.cached_property
    def size(self):
        return np.searchsorted(self.parent[self.children], np.arange(self.n), "right") - self.first

    @functools.cached_property
    def rank(self):
        rank = np.empty(len(self.parent), np.int64)
        rank[self.children] = np.arange(len(self.children))
        return rank

    @functools.cached_property
    def inner(self):
        """Text of each element with all its descendants."""
        order = np.argsort(self.place[self.n:], kind="stable").tolist()
        low, high = [None] * self.n, [0] * self.n
        for spot, t in enumerate(order):
            at = int(self.parent[self.n + t])
            low[at] = spot if low[at] is None else low[at]
            high[at] = spot + 1
        for i in range(self.n - 1, 0, -1):
            up = self.parent[i]
            if low[i] is not None:
                low[up] = low[i] if low[up] is None else min(low[up], low[i])
                high[up] = max(high[up], high[i])
        whole = "".join(self.texts[t] for t in order)
        ends = [0, *accumulate(len(self.texts[t]) for t in order)]
        return ["" if a is None else whole[ends[a]:ends[b]] for a, b in zip(low, high)]

    def string(self, node: int) -> str:
        return self.texts[node - self.n] if node >= self.n else self.inner[node]

    def tested(self, nodes, test):
        if test == "node()":
            return np.ones(len(nodes), bool)
        if test == "text()":
            return nodes >= self.n
        element = (nodes < self.n) & (nodes > 0)
        return element if test == "*" else element & (self.tag[np.where(element, nodes, 0)] == test)

    def step(self, nodes, axis, test):
        """(context, node) pairs of one step, by context, the nodes in the order of the axis."""
        element = np.where(nodes < self.n, nodes, 0)
        if axis == "self":
            owners, found = np.arange(len(nodes)), nodes
        elif axis == "parent":
            owners = np.flatnonzero(nodes > 0)
            found = self.parent[nodes[owners]]
        elif axis == "ancestor":
            owners, found, at, who = [], [], nodes, np.arange(len(nodes))
            while len(at):
                at = self.parent[at]
                at, who = at[at > 0], who[at > 0]
                owners.append(who)
                found.append(at)
            owners, found = np.concatenate(owners or [nodes]), np.concatenate(found or [nodes])
            order = np.argsort(owners, kind="stable")
            owners, found = owners[order], found[order]
        elif axis in ("following-sibling", "preceding-sibling"):
            up, rank = np.maximum(self.parent[nodes], 0), self.rank[nodes]
            if axis == "following-sibling":
                owners, spots = _spans(np.where(nodes > 0, rank + 1, 1), np.where(nodes > 0, self.first[up] + self.size[up] - 1, 0))
            else:
                owners, spots = _spans(np.where(nodes > 0, self.first[up], 1), np.where(nodes > 0, rank - 1, 0))
                turn = np.lexsort((-spots, owners))
                owners, spots = owners[turn], spots[turn]
            found = self.children[spots]
        elif axis == "child":
            owners, spots = _spans(self.first[element], self.first[element] + np.where(nodes < self.n, self.size[element], 0) - 1)
            found = self.children[spots]
        else:  # descendants: elements by interval, texts by their owner's
            low = element + (0 if axis == "descendant-or-self" else 1)
            owners, found = _spans(low, np.where(nodes < self.n, self.end[element], 0))
            if test == "text()":
                owners, found = _spans(element, np.where(nodes < self.n, self.end[element], -1))
                texts, spots = _spans(self.first[found], self.first[found] + self.size[found] - 1)
                owners, found = owners[texts], self.children[spots]
                order = np.lexsort((self.place[found], owners))
                owners, found = owners[order], found[order]
        good = self.tested(found, test)
        return owners[good], found[good]

    def of(self, test):
        """All nodes that pass a test, in document order."""
        if test not in self.tests:
            self.tests[test] = np.arange(self.n, len(self.parent)) if test == "text()" else np.array(
                self.by_tag.get(test, ()) if test != "*" else range(1, self.n), np.int64)
        return self.tests[test]

    def children_of(self, nodes, test, below: bool):
        """Children of the context ``nodes`` (distinct, in order), or of these and all elements below them, that pass a test."""
        found = self.of(test)
        up = self.parent[found]
        if below:
            if len(nodes) == 1 and nodes[0] == 0:
                return found
            _, nodes = self.covering(np.zeros(len(nodes), np.int64), nodes, "descendant-or-self")
            if not len(nodes):
                return nodes
            spot = np.searchsorted(nodes, up, "right") - 1
            return found[(spot >= 0) & (up <= self.end[nodes[spot]])]
        if len(nodes) == 1:
            return found[up == nodes[0]]
        known = np.zeros(len(self.parent), bool)
        known[nodes] = True
        return found[known[up]]

    def thinned(self, predicates, owners, found):
        """The (owner, node) pairs that pass all predicates; entries of an owner stand together."""
        for predicate in predicates:
            position, last = _counted(owners) if _looks_at_position(predicate) else (owners, owners)
            kept = self.true(predicate, found, position, last)
            owners, found = owners[kept], found[kept]
        return owners, found

    def walk(self, steps, origins, nodes):
        """(origin, node) pairs that a path leads to, distinct, by origin in document order."""
        at = 0
        while at < len(steps) and len(nodes):
            axis, test, predicates = steps[at]
            at += 1
            if axis == "root":
                origins, nodes = self.distinct(origins, np.zeros(len(origins), np.int64))
                continue
            below = axis == "descendant-or-self" and test == "node()" and not predicates and at < len(steps) and steps[at][0] == "child"
            if (below or axis == "child") and origins[0] == origins[-1] and (steps[at] if below else steps[at - 1])[1] != "node()":
                if below:
                    axis, test, predicates = steps[at]
                    at += 1
                found = self.children_of(nodes, test, below)
                if predicates and any(map(_looks_at_position, predicates)):
                    found = found[np.argsort(self.parent[found], kind="stable")]
                    found = np.sort(self.thinned(predicates, self.parent[found], found)[1])
                elif predicates:
                    found = self.thinned(predicates, found, found)[1]
                origins, nodes = np.full(len(found), origins[0]), found
                continue
            if axis == "group":
                parts = [self.walk(path, origins, nodes) for path in test]
                origins, nodes = self.thinned(predicates, *self.distinct(*(np.concatenate(x) for x in zip(*parts))))
                continue
            if not any(map(_looks_at_position, predicates)):
                origins, nodes = self.covering(origins, nodes, axis)
            owners, found = self.thinned(predicates, *self.step(nodes, axis, test))
            origins, nodes = self.distinct(origins[owners], found)
        return origins, nodes

    def covering(self, origins, nodes, axis):
        """The contexts that a step without positions needs: of nested ones the outermost, of siblings the first."""
        if axis == "descendant-or-self" or axis == "descendant":
            reach = origins * (self.n + 1) + np.where(nodes < self.n, self.end[np.minimum(nodes, self.n - 1)], 0)
            at = origins * (self.n + 1) + np.minimum(nodes, self.n - 1)
            before = np.append(-1, np.maximum.accumulate(reach)[:-1]) if len(reach) else reach
            kept = (nodes < self.n) & (at > before)
            return origins[kept], nodes[kept]
        if axis in ("following-sibling", "preceding-sibling") and len(nodes):
            rank = self.rank[nodes] * (1 if axis == "following-sibling" else -1)
            order = np.lexsort((rank, self.parent[nodes], origins))
            o, p = origins[order], self.parent[nodes[order]]
            kept = np.sort(order[np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1]))])
            return origins[kept], nodes[kept]
        return origins, nodes

    def distinct(self, origins, nodes):
        order = np.lexsort((self.place[nodes], origins))
        origins, nodes = origins[order], nodes[order]
        new = np.append(True, (origins[1:] != origins[:-1]) | (nodes[1:] != nodes[:-1])) if len(nodes) else np.zeros(0, bool)
        return origins[new], nodes[new]

    def strings(self, steps, nodes):
        """(origin, string) of what a path says of each of ``nodes``: texts, elements' texts or attributes."""
        taken = steps[-1][1] if steps[-1][0] == "attribute" else None
        origins, found = self.walk(steps[:-1] if taken else steps, np.arange(len(nodes)), nodes)
        if taken is None:
            return [(o, self.string(x)) for o, x in zip(origins.tolist(), found.tolist())]
        pairs = [(o, self.attrs[x]) for o, x in zip(origins.tolist(), found.tolist()) if x < self.n]
        if taken == "*":
            return [(o, v) for o, attrs in pairs for v in attrs.values()]
        return [(o, attrs[taken]) for o, attrs in pairs if taken in attrs]

    def values(self, expression, nodes, position, last):
        """Candidates of a value for each node: a list of strings or numbers; comparisons ask whether any fits."""
        kind = expression[0]
        if kind in ("literal", "number"):
            return [[expression[1]]] * len(nodes)
        if kind == "path":
            out = [[] for _ in range(len(nodes))]
            for origin, value in self.strings(expression[1], nodes):
                out[origin].append(html.unescape(value) if "&" in value else value)
            return out
        if kind == "sum":
            sign = 1 if expression[1] == "+" else -1
            left, right = (self.values(e, nodes, position, last) for e in expression[2:])
            return [[_number(a[0]) + sign * _number(b[0])] if a and b else [] for a, b in zip(left, right)]
        if kind == "call":
            name, args = expression[1:]
            if name in ("position", "last"):
                return [[float(x)] for x in (position if name == "position" else last).tolist()]
            given = self.values(args[0], nodes, position, last) if args and name not in ("not", "contains", "starts-with") else None
            if name == "count":
                return [[float(len(v))] for v in given]
            if name in ("normalize-space", "string", "string-length"):
                texts = [html.unescape(self.string(x)) for x in nodes.tolist()] if given is None else [str(v[0]) if v else "" for v in given]
                change = {"normalize-space": lambda t: " ".join(t.split()), "string": str, "string-length": lambda t: float(len(t))}[name]
                return [[change(t)] for t in texts]
        return [[x] for x in self.true(expression, nodes, position, last).tolist()]

    def true(self, expression, nodes, position, last):
        """Whether a predicate holds for each node; a number is a position, a path holds where it leads anywhere."""
        kind = expression[0]
        if kind in ("or", "and"):
            parts = [self.true(e, nodes, position, last) for e in expression[1]]
            return (np.logical_or if kind == "or" else np.logical_and).reduce(parts)
        if kind == "number" or kind == "sum" or kind == "call" and expression[1] == "last":
            return np.array([v == [float(p)] for v, p in zip(self.values(expression, nodes, position, last), position)], bool)
        if kind == "path":
            held = np.zeros(len(nodes), bool)
            held[[o for o, _ in self.strings(expression[1], nodes)]] = True
            return held
        if kind == "compare":
            how, left, right = expression[1:]
            sides = [self.values(e, nodes, position, last) for e in (left, right)]
            return np.array([any(_compared(how, a, b) for a in x for b in y) for x, y in zip(*sides)], bool)
        if kind == "call" and expression[1] in ("not", "contains", "starts-with", "true", "false"):
            name, args = expression[1:]
            if name in ("true", "false"):
                return np.full(len(nodes), name == "true")
            if name == "not":
                return ~self.true(args[0], nodes, position, last)
            sides = [self.values(e, nodes, position, last) for e in args]
            first = [tuple(str(v[0]) if v else "" for v in pair) for pair in zip(*sides)]  # of several the first, as a string
            return np.array([b in a if name == "contains" else a.startswith(b) for a, b in first], bool)
        return np.array([bool(v) and bool(v[0]) for v in self.values(expression, nodes, position, last)], bool)

    def take(self, paths) -> list[str]:
        """What the paths of a selector take: texts and attribute values in document order, each node once."""
        start = np.zeros(1, np.int64)
        found = {}
        for steps in paths:
            group = steps[-1][0] == "group" and not steps[-1][2]
            for path in (steps[-1][1] if group else [steps]):
                if path[-1][0] == "attribute":
                    _, nodes = self.walk(path[:-1], start, start)
                    name = path[-1][1]
                    found.update(((int(self.place[x]), a), v) for x in nodes.tolist() if x < self.n
                                 for a, v in self.attrs[x].items() if name in ("*", a))
                else:
                    _, nodes = self.walk(path, start, start)
                    found.update(((int(self.place[x]), ""), self.string(x)) for x in nodes.tolist())
        return [found[place] for place in sorted(found, key=lambda place: place[0])]


def _looks_at_position(expression) -> bool:
    kind = expression[0]
    if kind in ("or", "and"):
        return any(map(_looks_at_position, expression[1]))
    if kind == "compare":
        return any(map(_looks_at_position, expression[2:]))
    if kind == "call":
        return expression[1] in ("position", "last") or any(map(_looks_at_position, expression[2]))
    return kind in ("number", "sum")


def _number(value) -> float:
    try:
        return float(value)
    except ValueError:
        return float("nan")


def _compared(how: str, a, b) -> bool:
    if how in ("=", "!="):
        same = _number(a) == _number(b) if isinstance(a, float) or isinstance(b, float) else a == b
        return same == (how == "=")
    a, b = _number(a), _number(b)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[how]
