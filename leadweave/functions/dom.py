"""Arrow UDFs for the few page features that need nested elements.

A task builds one small tree per page with the standard library's parser and hands on neutral
elements: texts, links, and what they stand in. The rules on them are column expressions elsewhere.
Every element has its number in page order and that of its last descendant, so "the first such element
below this one" is a search in a sorted list, and a page takes time in proportion to its length.

A page that the parser cannot read gives null.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# The UDFs travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
_UNSEEN = frozenset(["script", "style", "template"])


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children", "number", "last", "near")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.near = parent.near if parent else {}

    def text(self, without=_UNSEEN, joint=" "):
        pieces, pending = [], list(reversed(self.children))
        while pending:
            node = pending.pop()
            if isinstance(node, str):
                pieces.append(node)
            elif node.tag not in without:
                pending.extend(reversed(node.children))
        return joint.join(pieces)

    def shown(self, without=_UNSEEN):
        """Text as a reader sees it: inline pieces joined, white space collapsed."""
        return " ".join(self.text(without, "").split())

    def has(self, name, part):
        return part in self.attrs.get(name, "")

    def of_class(self, name):
        return name in self.attrs.get("class", "").split()

    def ancestor(self, steps):
        node = self
        while node is not None and steps:
            node, steps = node.parent, steps - 1
        return node


class _Tree(HTMLParser):
    """*landmarks* are named tests; ``node.near`` has the nearest element of each, the node itself included."""

    def __init__(self, page, landmarks=None):
        super().__init__(convert_charrefs=True)
        self.landmarks = landmarks or {}
        self.root = self.at = _Node("", {}, None)
        self.root.number, self.nodes, self.open = -1, [], Counter()
        self.feed(page or "")
        self.close()
        self._leave(self.root)
        self.root.last = len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:
            self._leave(self.at.parent)
        # The first of repeated attributes counts.
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        node.number = node.last = len(self.nodes)
        self.nodes.append(node)
        self.at.children.append(node)
        marks = [name for name, test in self.landmarks.items() if test(node)]
        if marks:
            node.near = node.near | dict.fromkeys(marks, node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._leave(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # the standard parser fails on unknown ones

    def _leave(self, to):
        while self.at is not to:
            self.at.last = len(self.nodes) - 1
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def finder(self, test):
        """A function from an element to the first element below it that passes *test*."""
        found = [n.number for n in self.nodes if test(n)]

        def first(node):
            i = bisect_right(found, node.number)
            return self.nodes[found[i]] if i < len(found) and found[i] <= node.last else None

        return first


def _each(read):
    """*read* for every page; a page that cannot be read is null, like a missing one."""

    def guarded(*page):
        try:
            return None if page[0] is None else read(*page)
        except Exception:  # whatever a broken page does to the parser, the other pages go on
            return None

    return guarded


# Where the main content of a page may be, in order.
_BLOCKS = [
    lambda n: n.tag == "main",
    lambda n: n.tag == "article",
    lambda n: n.attrs.get("role") == "main",
    lambda n: n.attrs.get("id") == "content",
    lambda n: n.of_class("content"),
    lambda n: n.of_class("main-content"),
    lambda n: n.attrs.get("id") == "main",
    lambda n: n.tag == "section",
]


@_each
def _blocks(page):
    tree = _Tree(page)
    found = [tree.finder(test)(tree.root) for test in _BLOCKS]
    return [None if node is None else node.text() for node in found]


def _resolved(address, link):
    try:
        urljoin("", link), urlsplit(link)
    except ValueError:  # not a link
        return None
    try:
        return urljoin(address or "", link)
    except ValueError:  # no address to resolve it by
        return link


# What a search hit stands in, and where its snippet may be.
_HIT_PLACES = {
    "link": lambda n: n.tag == "a",
    "marked": lambda n: "data-hveid" in n.attrs,
    "group": lambda n: n.tag == "div" and n.of_class("g"),
}


def _is_snippet(n):
    return (
        "data-sncf" in n.attrs or n.of_class("VwiC3b") or n.of_class("yXK7lf")
        or (n.tag == "span" and n.has("style", "webkit"))
    )


@_each
def _headings(page, address):
    """Linked headings with the snippets of the places that they stand in, nearest kinds first."""
    tree = _Tree(page, _HIT_PLACES)
    snippet = tree.finder(_is_snippet)
    texts = {}

    def note(place):
        node = snippet(place) if place else None
        if place is None:
            return None
        if node is not None and node.number not in texts:
            texts[node.number] = node.shown()
        return texts[node.number] if node else ""

    found = []
    for heading in tree.nodes:
        link = heading.near.get("link") if heading.tag == "h3" else None
        if link is not None:
            places = [heading.near.get("marked"), heading.near.get("group"), heading.ancestor(3)]
            found.append({
                "href": _resolved(address, link.attrs.get("href", "")) if link.attrs.get("href") else None,
                "title": heading.shown(), "snippets": [note(p) for p in places],
            })
    return found


# Where the address of a directory card may be, in order.
_CARD_ADDRESS = [
    lambda n: n.has("class", "adresse"),
    lambda n: n.has("class", "address"),
    lambda n: n.has("class", "localisation"),
    lambda n: n.tag == "address",
]
_CARD_PLACES = {"heading": lambda n: n.tag in ("h2", "h3")}


@_each
def _items(page):
    """List items with a heading: its text, and the texts of all places for an address."""
    tree = _Tree(page, _CARD_PLACES)
    heading = tree.finder(lambda n: n.tag in ("h2", "h3") or (n.tag == "a" and "heading" in n.near))
    address = [tree.finder(test) for test in _CARD_ADDRESS]
    names, shown = {}, {}

    def text(node, cache, without=_UNSEEN):
        if node is not None and node.number not in cache:
            cache[node.number] = node.shown(without)
        return None if node is None else cache[node.number]

    found = []
    for item in tree.nodes:
        name = text(heading(item), names) if item.tag == "li" else None
        if name is not None:
            found.append({"name": name, "addresses": [text(a(item), shown, _UNSEEN | {"a"}) for a in address]})
    return found


# Where a place page shows name, address and website, in order.
_PLACE_BUTTONS = {
    "item": lambda n: n.tag == "button" and n.attrs.get("data-item-id") == "address",
    "french": lambda n: n.tag == "button" and n.has("aria-label", "Adresse"),
    "english": lambda n: n.tag == "button" and n.has("aria-label", "Address"),
}


def _in_button(name):
    return lambda n: n.of_class("fontBodyMedium") and name in n.parent.near


_PLACE_NAME = [
    lambda n: n.tag == "h1" and n.of_class("DUwDvf"),
    lambda n: n.tag == "h1" and n.attrs.get("data-attrid") == "title",
    lambda n: n.tag == "h1",
]
_PLACE_ADDRESS = [
    _in_button("item"),
    lambda n: n.attrs.get("data-item-id") == "address",
    _in_button("french"),
    _in_button("english"),
]
_PLACE_SITE = [
    lambda n: n.tag == "a" and n.attrs.get("data-item-id") == "authority",
    lambda n: n.tag == "a" and n.has("aria-label", "site web"),
    lambda n: n.tag == "a" and n.has("aria-label", "website"),
    lambda n: n.tag == "a" and n.has("data-tooltip", "site"),
]


@_each
def _place(page):
    tree = _Tree(page, _PLACE_BUTTONS)

    def each(tests, read):
        found = [tree.finder(test)(tree.root) for test in tests]
        return [None if node is None else read(node) for node in found]

    return {
        "names": each(_PLACE_NAME, _Node.shown),
        "addresses": each(_PLACE_ADDRESS, _Node.shown),
        "hrefs": each(_PLACE_SITE, lambda n: n.attrs.get("href")),
    }


_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@F.pandas_udf(_STRINGS)
def content_blocks(pages: pd.Series) -> pd.Series:
    """Text of the first element for each content selector; null pages cost nothing."""
    return pages.map(_blocks)


@F.pandas_udf(T.ArrayType(_struct(href=T.StringType(), title=T.StringType(), snippets=_STRINGS)))
def linked_headings(pages: pd.Series, addresses: pd.Series) -> pd.Series:
    return pd.Series([_headings(p, a) for p, a in zip(pages, addresses)], dtype=object)


@F.pandas_udf(T.ArrayType(_struct(name=T.StringType(), addresses=_STRINGS)))
def headed_items(pages: pd.Series) -> pd.Series:
    return pages.map(_items)


@F.pandas_udf(_struct(names=_STRINGS, addresses=_STRINGS, hrefs=_STRINGS))
def place_fields(pages: pd.Series) -> pd.DataFrame:
    empty = {"names": None, "addresses": None, "hrefs": None}
    return pd.DataFrame([_place(p) or empty for p in pages], columns=list(empty))
