"""One pass per page: html in, the texts, links and images later stages need out.

Only the markup is read here. Every decision (which link is a notice, which date
counts, which url is safe) is taken afterwards on columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewatch import fixed_values as fv

_LINK = pa.struct(
    [(n, pa.string()) for n in ("href", "title_attr", "onclick", "data_params", "text")]
    + [("context", pa.int32()), ("in_chrome", pa.bool_())]
    + [(n, pa.string()) for n in ("list_heading", "icon_title", "bare_text")]
)
_IMAGE = pa.struct([(n, pa.string()) for n in ("src", "data_src", "data_original")])
_PARSED = [
    ("title_texts", pa.list_(pa.string())),
    ("meta_dates", pa.list_(pa.string())),
    ("date_texts", pa.list_(pa.string())),
    ("page_text", pa.string()),
    ("body_texts", pa.list_(pa.string())),
    ("body_text", pa.string()),
    ("contexts", pa.list_(pa.string())),
    ("links", pa.list_(_LINK)),
    ("images", pa.list_(_IMAGE)),
]
PARSED_DDL = (
    "title_texts ARRAY<STRING>, meta_dates ARRAY<STRING>, date_texts ARRAY<STRING>, page_text STRING, "
    "body_texts ARRAY<STRING>, body_text STRING, contexts ARRAY<STRING>, "
    "links ARRAY<STRUCT<href: STRING, title_attr: STRING, onclick: STRING, data_params: STRING, text: STRING, "
    "context: INT, in_chrome: BOOLEAN, list_heading: STRING, icon_title: STRING, bare_text: STRING>>, "
    "images ARRAY<STRUCT<src: STRING, data_src: STRING, data_original: STRING>>"
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CHROME = frozenset(("script", "style", "nav", "header", "footer"))
_CONTEXT = frozenset(("tr", "li", "article"))
# A start tag closes an open one of the same kind, up to the enclosing container.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "p": ({"p"}, {"div", "td", "li", "article", "section", "body"}),
}
_BATCH_ROWS = 256
_BATCH_CHARS = 16_000_000


class _Node:
    """An element. What links ask of the elements around them is handed down when an element is made."""

    __slots__ = ("tag", "attrs", "parent", "parts", "links", "chrome", "near", "section", "_text")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []
        self.links = 0
        self.chrome = tag in _CHROME or (parent is not None and parent.chrome)
        # the nearest row, item or article, and the nearest list section, around what stands in this element
        self.near: _Node | None = self if tag in _CONTEXT else parent and parent.near
        self.section: _Node | None = self if tag == "div" and self.has_class("list") else parent and parent.section
        self._text: dict[bool, str] = {}

    def text(self, with_chrome: bool = True, skip: frozenset = frozenset()) -> str:
        if not skip and with_chrome in self._text:
            return self._text[with_chrome]
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                found.append(node)
            elif node is self or not (
                node.tag in ("script", "style") or node.tag in skip or (node.tag in _CHROME and not with_chrome)
            ):
                stack.extend(reversed(node.parts))
        joined = " ".join(found)
        if not skip:
            self._text[with_chrome] = joined
        return joined

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return self.has_class(selector[1:])
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        return self.tag == selector


class _Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", {}, None)
        self.nodes: list[_Node] = []
        #: by tag, the open elements' places in the chain of open ones, innermost last
        self._chain: list[_Node] = []
        self._places: dict[str, list[int]] = {}
        self.feed(html)
        self.close()
        # children stand behind their parents, so one pass from the end counts the links below every element
        for node in reversed(self.nodes):
            node.parent.links += node.links + (node.tag == "a" and "href" in node.attrs)

    def _innermost(self, tags: "set[str]") -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)

    def _close_from(self, place: int) -> None:
        """End the open element at a place of the chain and all inside it."""
        while len(self._chain) > place:
            self._places[self._chain.pop().tag].pop()
        self.open = self._chain[-1] if self._chain else self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SIBLINGS:
            same, limits = _SIBLINGS[tag]
            place = self._innermost(same)
            if place > self._innermost(limits):
                self._close_from(place)
        values = {k: v or "" for k, v in reversed(attrs)}
        node = _Node(tag, values, self.open)
        self.open.parts.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self._places.setdefault(tag, []).append(len(self._chain))
            self._chain.append(node)
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        place = self._innermost({tag})
        if place >= 0:
            self._close_from(place)

    def handle_data(self, data: str) -> None:
        self.open.parts.append(data)


def _inside(node: _Node, tag: str) -> "_Node | None":
    """First descendant with ``tag``."""
    stack = list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, _Node):
            if part.tag == tag:
                return part
            stack.extend(reversed(part.parts))
    return None


def _context_node(link: _Node) -> "_Node | None":
    """Nearest row, item or article; else the nearest of three ancestors with fewer than three links."""
    if link.parent is not None and link.parent.near is not None:
        return link.parent.near
    above = link.parent
    for _ in range(3):
        if above is None or above.links < 3:
            return above
        above = above.parent
    return None


def parse_page(html: str) -> dict:
    tree = _Tree(html)
    nodes = tree.nodes

    def first(selector: str, candidates: list) -> "_Node | None":
        return next((n for n in candidates if n.matches(selector)), None)

    def texts(selectors: tuple, candidates: list, with_chrome: bool) -> list:
        hits = [first(s, candidates) for s in selectors]
        return [None if n is None else n.text(with_chrome) for n in hits]

    content = [n for n in nodes if not n.chrome]
    metas = [n for n in nodes if n.tag == "meta"]
    contexts: dict[int, int] = {}
    context_texts: list[str] = []
    headings: dict[int, str] = {}
    links = []
    for node in nodes:
        if node.tag != "a" or "href" not in node.attrs:
            continue
        around = _context_node(node)
        if around is not None and id(around) not in contexts:
            contexts[id(around)] = len(context_texts)
            context_texts.append(around.text())
        section = node.parent.section
        heading = icon = bare = None
        if section is not None:
            if id(section) not in headings:
                head = _inside(section, "h4")
                headings[id(section)] = "" if head is None else head.text()
            heading = headings[id(section)]
            mark = _inside(node, "i")
            icon = "" if mark is None else mark.attrs.get("title", "")
            bare = node.text(skip=frozenset(("i", "span")))
        links.append(
            {
                "href": node.attrs["href"], "title_attr": node.attrs.get("title", ""),
                "onclick": node.attrs.get("onclick", ""), "data_params": node.attrs.get("data-params", ""),
                "text": node.text(), "context": None if around is None else contexts[id(around)],
                "in_chrome": node.chrome, "list_heading": heading, "icon_title": icon, "bare_text": bare,
            }
        )
    dated = [
        n for n in nodes
        if (n.tag == "time" and "datetime" in n.attrs) or any(n.has_class(c) for c in fv.DATE_CLASSES)
    ]
    return {
        "title_texts": texts(fv.TITLE_SELECTORS, nodes, True),
        "meta_dates": [
            next((n.attrs.get("content", "") for n in metas if n.attrs.get(key) == value), None)
            for key, value in fv.DATE_METAS
        ],
        "date_texts": [n.attrs.get("datetime") or n.text() for n in dated],
        "page_text": tree.root.text(),
        "body_texts": texts(fv.BODY_SELECTORS, content, False),
        "body_text": tree.root.text(with_chrome=False),
        "contexts": context_texts,
        "links": links,
        "images": [
            {k.replace("-", "_"): n.attrs.get(k, "") for k in ("src", "data-src", "data-original")}
            for n in content
            if n.tag == "img"
        ],
    }


def _row(html: "str | None") -> dict:
    if html is None:
        return {"parse_error": "no page"}
    try:
        return parse_page(html) | {"parse_error": None}
    except Exception as exc:  # one broken page must not fail the job
        return {"parse_error": f"{type(exc).__name__}: {exc}"}


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html column by the parsed columns and ``parse_error``; other columns pass through."""
    kept = [c for c in pages.columns if c != html]
    kept_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)
    fields = [pa.field(n, t) for n, t in [*_PARSED, ("parse_error", pa.string())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(source: pa.RecordBatch, start: int, rows: list) -> pa.RecordBatch:
            part = source.slice(start, len(rows))
            parsed = pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
            names = [*kept, *parsed.schema.names]
            return pa.RecordBatch.from_arrays([part.column(c) for c in kept] + parsed.columns, names=names)

        for batch in batches:
            start, rows, size = 0, [], 0
            for value in batch.column(html):
                text = value.as_py()
                rows.append(_row(text))
                size += len(text or "")
                if len(rows) >= _BATCH_ROWS or size >= _BATCH_CHARS:
                    yield flush(batch, start, rows)
                    start, rows, size = start + len(rows), [], 0
            if rows:
                yield flush(batch, start, rows)

    return pages.select(*kept, html).mapInArrow(run, f"{kept_ddl}, {PARSED_DDL}, parse_error STRING")
