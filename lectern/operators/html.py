"""HTML pages to ordered elements.

Parsing is the one step that columns cannot express: a page is read by a small state machine over the
standard library's parser, in Arrow batches, one row in, its elements out. No page needs another.

Defined cases: null or empty HTML gives no elements; markup that is not closed is closed where a browser
would close it (a paragraph by the next block, a list item by the next); script and style are skipped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.values import CODE_LANGUAGES

SCHEMA = "pos int, type string, content string, chapter string, language string, alt string, file string, mime string, spine_index int, anchor_id string"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]

_SKIPPED = {"script", "style", "head", "meta", "link", "noscript", "nav", "svg"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = {"p", "li", "dd", "dt", "caption", "figcaption"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *_HEADINGS}
_CLOSED_BY_NEXT = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LIMITS = {"ul", "ol", "dl", "table"}


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """A tree of nodes and texts, repaired while it is read."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]
        self.counts: Counter[str] = Counter()  # of the open nodes' tags
        self.again: list[tuple[str, dict[str, str]]] = []  # marks left open by a block that was closed

    def _reopen(self) -> None:
        for tag, attrs in self.again:
            self._push(tag, attrs)
        self.again = []

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = _Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Closes the innermost open node of ``tags``, unless one of ``within`` stands above it first."""
        if not any(self.counts[tag] for tag in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self.again += [(n.tag, n.attrs) for n in self.open[k + 1 :] if n.tag in _MARKS]
                self.counts.subtract(n.tag for n in self.open[k:])
                del self.open[k:]
                return
            if self.open[k].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P:
            self._close({"p"}, set())
        if tag in _CLOSED_BY_NEXT:
            self._close(_CLOSED_BY_NEXT[tag], _LIMITS)
        if tag not in _CLOSES_P and tag not in _CLOSED_BY_NEXT:
            self._reopen()
        self._push(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        if self.counts[tag]:
            self._close({tag}, set())
            if tag in _MARKS:
                return
        elif tag in _MARKS:
            self.again = [x for x in self.again if x[0] != tag]

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._reopen()
        self.open[-1].children.append(data)


def _inside(node: _Node) -> Iterator[str | _Node]:
    """The texts and nodes below a node in order; pages may nest deeper than Python's own stack goes."""
    waiting = list(reversed(node.children))
    while waiting:
        yield (c := waiting.pop())
        if not isinstance(c, str):
            waiting += reversed(c.children)


def _raw(node: _Node) -> str:
    return "".join(c for c in _inside(node) if isinstance(c, str))


def _marked(node: _Node) -> str:
    out: list[str] = []
    waiting: list[str | _Node | tuple[str]] = list(reversed(node.children))
    while waiting:
        c = waiting.pop()
        if isinstance(c, tuple):  # the mark that ends a node
            out.append(c[0])
        elif isinstance(c, str):
            out.append(c)
        elif c.tag not in ("img", "script", "style", "svg"):
            if mark := _MARKS.get(c.tag):
                out.append(mark)
                waiting.append((mark,))
            waiting += [_raw(c)] if c.tag == "code" else reversed(c.children)
    return "".join(out)


def inline_text(node: _Node) -> str:
    """Text with bold, italics and code marked, on one line."""
    return " ".join(_marked(node).split())


def class_language(classes: str | None) -> str | None:
    """The programming language that CSS classes name."""
    own = (classes or "").split()
    for token in own:
        for prefix in ("language-", "lang-", "highlight-"):
            if token.startswith(prefix) and len(token) > len(prefix):
                return token[len(prefix) :].lower()
    if "sourceCode" in (classes or ""):
        for token in own:
            if token != "sourceCode" and token.isalnum():
                return token.lower()
    return next((t.lower() for t in own if t.lower() in CODE_LANGUAGES), None)


def _all(node: _Node, tag: str) -> Iterator[_Node]:
    return (c for c in _inside(node) if not isinstance(c, str) and c.tag == tag)


class Reader:
    """The elements of pages read one after another; the chapter carries over from page to page."""

    def __init__(self, chapter: str | None = None):
        self.chapter = chapter

    def read(self, html: str) -> list[dict]:
        tree = _Tree()
        tree.feed(html)
        tree.close()
        self.out: list[dict] = []
        self.text: list[str] = []
        self.anchor: str | None = None
        waiting = [tree.open[0]]
        while waiting:
            waiting += reversed(self._read(waiting.pop()))
        self._flush()
        return self.out

    def _emit(self, **fields) -> None:
        self.out.append({"chapter": self.chapter, "anchor_id": self.anchor} | fields)

    def _flush(self) -> None:
        if text := "".join(self.text).strip():
            self._emit(type="text", content=text)
        self.text = []

    def _add(self, text: str, separator: str) -> None:
        if text:
            self.text += [separator if self.text else "", text]

    def _image(self, node: _Node) -> None:
        self._flush()
        self._emit(type="image", alt=node.attrs.get("alt", "").strip(), file=node.attrs.get("src"), chapter=None)

    def _read(self, node: _Node) -> list[_Node]:
        """Takes what a node gives; returns the nodes that are to be read in its place."""
        tag = node.tag
        if tag in _SKIPPED:
            return []
        if tag in _HEADINGS:
            self._flush()
            if text := inline_text(node):
                self.chapter = text
                self.anchor = node.attrs.get("id") or self.anchor
        elif tag == "img":
            self._image(node)
        elif tag == "pre":
            self._flush()
            if (code := _raw(node)).strip():
                named = [class_language(n.attrs.get("class")) for n in (node, *_all(node, "code"))]
                self._emit(type="code", content=code, language=next(filter(None, named), None))
        elif tag in ("ul", "ol"):
            self._flush()
            n = 0
            for item in node.children:
                if isinstance(item, _Node) and item.tag == "li" and (text := inline_text(item)):
                    n += 1
                    self._add(f"{n}. {text}" if tag == "ol" else f"- {text}", "\n")
        elif tag == "blockquote":
            text = inline_text(node)
            self._add(f"> {text}" if text else "", "\n\n")
        elif tag in _BLOCKS:
            self._add(inline_text(node), "\n\n")
            for image in _all(node, "img"):
                self._image(image)
        else:
            return [c for c in node.children if isinstance(c, _Node)]
        return []


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def whole_references(html: str) -> str:
    """``html`` in which a reference without its semicolon (``&amp`` of a text that was cut there) stands for itself."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html", lenient: bool = True) -> DataFrame:
    """key and one row for each element of each page. Unless ``lenient``, only references that end in a semicolon count; a browser takes some others."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = Reader().read((text or "") if lenient else whole_references(text or ""))
                out += [x | {"pos": i} for i, x in enumerate(found)]
                keys += [k] * len(found)
            columns = [pa.array([x.get(f) for x in out], pa.int32() if f in ("pos", "spine_index") else pa.string()) for f in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], [key, *_FIELDS])

    return pages.select(F.col(key), F.col(html).alias("html")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
