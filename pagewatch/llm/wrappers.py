"""Main text of web pages by wrappers inferred from pages of one host.

A wrapper is a regular expression without unions over a page's tokens, kept as
a tree: elements in sequence, repeated groups, optional groups, and texts that
are fixed or slots. A page is a wrapper of itself. Two wrappers are aligned:
what matches is merged, differing texts become slots, neighbours of one shape
become a repeated group, and what only one side has becomes optional. Merging
is done pairwise, so every page of a host takes part: first where the pages are,
then in groups of at most ``FAN`` wrappers until a host has one. Only wrappers
are shuffled, never pages.

Each element of a wrapper counts the characters and link characters it held.
The main region is found by going down from the body to the articles, or as far
as one element has nearly all of the text; a page is then cut at that region. A
page of which that is not most of its text is cut by a wrapper of its own.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out wherever they stand. Class names, ids, roles and
forms are hints for that: an element that holds the page's article is not left
out for its name. Wrappers serve to find the region; what is left out inside it
goes by elements and hints, not by slots and groups.

Shapes are tags and classes. A wrapper keeps ``KEPT`` items an element, so it is
bounded by that and ``DEEPEST``, not by the pages of its host.

Null html counts as empty and gives the empty text; pages whose address has no
host share one wrapper. Unclosed and misnested tags are closed as a browser
would. Deep nesting and long pages are walked without recursion. Repeated rows
give equal texts; an empty table gives none.
"""

from __future__ import annotations

import html as references
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import stored
from pagewatch.llm.common import each_row, text_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)[^>]*(?:>|\Z)|[^<]+|<""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# How elements behave, and names that mark what is not the article.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SCOPES = {"table", "td", "th", "ul", "ol", "dl", "article", "section", "div", "body", "aside", "main"}
LEFT_OUT = {
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "svg", "canvas", "object", "audio", "video", "head",
} | RAW
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar"}
LEFT_OUT_NAMES = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "sidebar", "menu",
    "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "disqus",
    "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login",
    "search", "widget", "pagination", "pager", "toolbar", "skip", "disclaimer",
}
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
TELLING = {"has", "no", "with", "without", "is", "js", "open", "closed"}
REGIONS = {"article", "main"}

FAN = 64
DEEPEST = 40
WIDEST = 300
#: Items of one element that a wrapper keeps; those of the fewest pages become one item that stands for any.
KEPT = 120
ANY = "*"
#: An element is gone down into if it has at least this share of the article text; what stands beside it is kept otherwise.
SHARE = 0.9


class Node:
    """An element of a page: its shape, whether it is left out, and its children, which are texts and elements."""

    __slots__ = ("tag", "shape", "out", "hint", "children", "parent", "own", "regions")

    def __init__(self, tag: str, shape: str, out: bool, parent: Node | None, hint: str = ""):
        self.tag, self.shape, self.out, self.parent, self.hint = tag, shape, out, parent, hint
        self.children: list = []
        self.own = self.regions = 0


def _names(value: str) -> set[str]:
    """The parts of class names and ids, but for names that only tell of something (has-sidebar, no-comments)."""
    out: set[str] = set()
    for name in value.split():
        parts = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if parts and parts[0] not in TELLING:
            out.update(parts)
    return out


def _element(tag: str, attributes: str, parent: Node) -> Node:
    """A node. Names, roles and forms are hints that it is left out, which ``_settle`` may take back."""
    shape, out, hint = tag, tag in LEFT_OUT, "form" if tag == "form" else ""
    if tag not in INLINE and "=" in attributes:
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        classes = found.get("class", "")
        if classes:
            # ids name one element of one page and are no part of a template
            shape = re.sub(r"\d+", "0", f"{tag}.{'.'.join(sorted(classes.split()))}")
        if not out and tag not in ("body", "html"):
            named = LEFT_OUT_NAMES & _names(f"{classes} {found.get('id', '')}")
            if named:
                hint = "readers" if named & READERS else "name"
            elif found.get("role", "").lower() in LEFT_OUT_ROLES:
                hint = "role"
        out = out or bool(hint) or found.get("aria-hidden", "").lower() == "true"
    if tag == "header" and not out:
        above = parent
        while above is not None and above.tag not in REGIONS:
            above = above.parent
        out = above is None
    return Node(tag, shape, out, parent, hint)


def _settle(root: Node) -> None:
    """Take back hints on what holds the page's article.

    That is an element with all the ``article`` and ``main`` of the page that
    stand outside of other elements left out, or, on pages without any, with most
    of the text that is no link; readers' comments only in the first case.
    """
    order: list[tuple[Node, bool, bool]] = []
    stack = [(root, False, False)]
    while stack:
        node, linked, hard = stack.pop()
        order.append((node, linked, hard))
        for child in node.children:
            if not isinstance(child, str):
                stack.append((child, linked or child.tag == "a", hard or (child.out and not child.hint)))
    for node, linked, hard in reversed(order):
        if hard:
            continue
        node.regions += node.tag in REGIONS
        if not linked:
            node.own += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.parent is not None:
            node.parent.own += node.own
            # a comment in an article of its own is no article of the page
            node.parent.regions += 0 if node.hint == "readers" else node.regions
    for node, _, hard in order:
        if node.hint and node.out and not hard:
            holds = node.regions > 0 and node.regions == root.regions
            most = not root.regions and node.hint != "readers" and 2 * node.own > root.own
            if holds or most:
                node.out = False


def parse(html: str) -> Node:
    """The tree of a page, built in one pass."""
    root = here = Node("#", "#", False, None)
    at = 0
    while found := TOKEN.match(html, at):
        at = found.end()
        if not found[2]:
            if found[0][0] != "<" or found[0] == "<":
                here.children.append(found[0])
            continue
        tag = found[2].lower()
        if found[1]:
            above = here
            while above is not root and above.tag != tag:
                above = above.parent
            if above is not root:
                here = above.parent
            elif tag in ("br", "p"):
                here.children.append(Node(tag, tag, False, here))
            continue
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_PARAGRAPH else set())
        if ends:
            above = here
            while above is not root and above.tag not in ends and (above.tag in INLINE or above.tag not in SCOPES):
                above = above.parent
            if above.tag in ends:
                here = above.parent
                if tag in ("tr", "tbody", "tfoot", "thead"):
                    while here.tag in ends:
                        here = here.parent
        node = _element(tag, found[3], here)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (found[3].endswith("/") and tag in ("svg", "path", "use")):
            here = node
    _settle(root)
    return root


def blocks_of(regions: list[Node]) -> list[str]:
    """The text blocks of some regions, in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            line = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if line:
                out.append(line)

    for region in regions:
        stack: list = [region]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                held.append(item)
            elif not item.out or item is region:
                block = item.tag not in INLINE and item.tag not in ("img", "wbr")
                if block:
                    end()
                    stack.append(None)
                stack.extend(reversed(item.children))
        end()
    return out


# A wrapper's item is a list, so that it is plain JSON:
# element ["e", shape, left out, repeated, optional, chars, link chars, pages, items] or text ["t", fixed text or null, optional].


def _text(node: Node) -> tuple[int, int]:
    """Characters, and those in links, below a node."""
    chars = links = 0
    stack: list = [(node, False)]
    while stack:
        item, linked = stack.pop()
        for child in item.children:
            if isinstance(child, str):
                n = len(child.strip())
                chars += n
                links += n * linked
            elif not child.out:
                stack.append((child, linked or child.tag == "a"))
    return chars, links


def wrapper_of(node: Node, depth: int = 0) -> list:
    """A page as a wrapper. Inline elements are part of the text around them."""
    chars, links = (0, 0) if node.out else _text(node)
    items: list = []
    if not node.out and depth < DEEPEST:
        held: list[str] = []

        def text() -> None:
            words = " ".join("".join(held).split())
            held.clear()
            if words:
                items.append(["t", words if len(words) <= 200 else None, False])

        stack: list = list(reversed(node.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                held.append(child)
            elif child.tag in INLINE and not child.out:
                stack.extend(reversed(child.children))
            else:
                text()
                items.append(wrapper_of(child, depth + 1))
        text()
    return ["e", node.shape, node.out, False, False, chars, links, 1, folded(items)]


def _key(item: list) -> str:
    return item[1] if item[0] == "e" else "#text"


def _merged(a: list, b: list, same_page: bool) -> list:
    """Two items of one key as one. Parts of one page are not two pages."""
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] or b[2]]
    pages = max(a[7], b[7]) if same_page else a[7] + b[7]
    return ["e", a[1], a[2] and b[2], a[3] or b[3], a[4] or b[4], a[5] + b[5], a[6] + b[6], pages, aligned(a[8], b[8], same_page)]


def folded(items: list) -> list:
    """Neighbouring items of one shape, or of one sequence of up to three shapes, as one repeated group."""
    for period in (1, 2, 3):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * period:
                last, before = out[-period:], out[-2 * period : -period]
                if any(i[0] != "e" for i in last) or [_key(i) for i in last] != [_key(i) for i in before]:
                    break
                merged = [_merged(a, b, True) for a, b in zip(before, last, strict=True)]
                for m in merged:
                    m[3] = True
                out[-2 * period :] = merged
        items = out
    return items


def aligned(a: list, b: list, same_page: bool = False) -> list:
    """Two sequences as one: the longest common subsequence is merged, the rest is optional."""
    keys_a, keys_b = [_key(i) for i in a], [_key(i) for i in b]
    pairs: list[tuple[int, int]] = []
    if keys_a == keys_b:
        pairs = [(i, i) for i in range(len(a))]
    elif len(a) <= WIDEST and len(b) <= WIDEST:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if keys_a[i] == keys_b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if keys_a[i] == keys_b[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:  # very wide: the next item of the same key, in one pass
        places: dict[str, list[int]] = {}
        for j, key in enumerate(keys_b):
            places.setdefault(key, []).append(j)
        last = -1
        for i, key in enumerate(keys_a):
            row = places.get(key, [])
            while row and row[0] <= last:
                row.pop(0)
            if row:
                last = row.pop(0)
                pairs.append((i, last))
    out: list = []
    i = j = 0

    def optional(item: list) -> list:
        item = list(item)
        item[4 if item[0] == "e" else 2] = True
        return item

    for x, y in [*pairs, (len(a), len(b))]:
        out += [optional(k) for k in a[i:x]] + [optional(k) for k in b[j:y]]
        if x < len(a):
            out.append(_merged(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return bounded(folded(out))


def bounded(items: list) -> list:
    """At most ``KEPT`` items: elements that few pages have become one optional repeated item without items of its own."""
    if len(items) <= KEPT:
        return items
    ranked = sorted(range(len(items)), key=lambda i: (items[i][0] == "e" and items[i][1] != ANY, items[i][7] if items[i][0] == "e" else 0, -i), reverse=True)
    kept = set(ranked[: KEPT - 1])
    rest = [items[i] for i in range(len(items)) if i not in kept and items[i][0] == "e"]
    some = ["e", ANY, all(i[2] for i in rest), True, True, sum(i[5] for i in rest), sum(i[6] for i in rest), max((i[7] for i in rest), default=1), []]
    return [items[i] for i in sorted(kept)] + [some]


def merge(a: list, b: list) -> list:
    return _merged(a, b, False)


def _tag(item: list) -> str:
    return item[1].split(".")[0]


def region_of(wrapper: list) -> list[list[str]]:
    """The way from the root to the main region: per step the shapes of the elements gone into."""
    path: list[list[str]] = []
    here = wrapper
    while True:
        inner = [i for i in here[8] if i[0] == "e" and not i[2] and i[1] != ANY]
        own = max((i[5] - i[6] for i in inner), default=0)
        if not inner or own <= 0:
            return path
        marked = [i for i in inner if _tag(i) in REGIONS and i[5] > i[6]]
        if marked and sum(i[5] - i[6] for i in marked) >= 0.3 * own:
            path.append(sorted({i[1] for i in marked}))
            return path + (_article(marked[0]) if len(path[-1]) == 1 else [])
        best = max(inner, key=lambda i: i[5] - i[6])
        tag = _tag(best)
        heading = any(_tag(i) == "h1" for i in inner if i is not best)
        if tag in ("html", "body"):
            path.append([best[1]])
            here = best
            continue
        deep = _article(best)
        if deep and tag not in REGIONS:
            return [*path, [best[1]], *deep]
        share = (best[5] - best[6]) / max(here[5] - here[6], 1)
        holds = any(i[0] == "e" for i in best[8])
        if tag in ("p", "ul", "ol", "table", "blockquote", "h1", "h2", "h3", "pre", "dl") or not holds or heading or share < SHARE:
            return path
        path.append([best[1]])
        here = best


def _article(item: list) -> list[list[str]]:
    """The way down to the articles below an item that together hold most of its text; none if there are none such."""
    stack: list[tuple[list, list[list[str]]]] = [(item, [])]
    while stack:
        here, path = stack.pop()
        inner = [c for c in here[8] if c[0] == "e" and not c[2] and c[1] != ANY]
        found = [c for c in inner if _tag(c) == "article"]
        if found and 2 * sum(c[5] for c in found) >= item[5]:
            return [*path, sorted({c[1] for c in found})]
        stack += [(c, [*path, [c[1]]]) for c in inner]
    return []


def regions_at(root: Node, path: list[list[str]]) -> list[Node]:
    """The page's elements at the end of a way, in page order; the way passes over inline elements."""
    here = [root]
    for shapes in path:
        found: list[Node] = []
        for node in here:
            stack = [c for c in reversed(node.children) if isinstance(c, Node)]
            while stack:
                child = stack.pop()
                if child.out:
                    continue
                if child.shape in shapes:
                    found.append(child)
                elif child.tag in INLINE:
                    stack.extend(c for c in reversed(child.children) if isinstance(c, Node))
        here = found
    return here


def main_text(html: str | None, path: list[list[str]] | None) -> str:
    """A page's main text: cut at the host's region where that holds most of the page's article text, else at its own."""
    root = parse(html or "")
    regions = regions_at(root, path) if path else []
    held = sum(chars - links for chars, links in map(_text, regions))
    chars, links = _text(root)
    if not regions or 2 * held < chars - links:
        regions = regions_at(root, region_of(wrapper_of(root))) or [root]
    return "\n".join(blocks_of(regions) or blocks_of([root]))


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))
    return pages.withColumn("_host", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (as JSON), from all pages of every host."""
    kind = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def out(held: dict[str, list]) -> pa.RecordBatch:
        rows = {"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}
        return pa.RecordBatch.from_pydict(rows, schema=kind)

    def of_pages(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for host, html in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    own = wrapper_of(parse(html))
                    held[host] = merge(held[host], own) if host in held else own
                    if len(held) >= 2000:
                        yield out(held)
                        held = {}
        if held:
            yield out(held)

    def of_wrappers(batches):
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (host, part) not in held:
                    yield out({k[0]: v for k, v in held.items()})
                    held = {}
                own = json.loads(text)
                held[host, part] = merge(held[host, part], own) if held else own
        if held:
            yield out({k[0]: v for k, v in held.items()})

    found = stored(_hosts(pages).select("_host", text_of("html")).mapInArrow(of_pages, "host string, wrapper string"))
    while True:
        most = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        parts = -(-most // FAN)
        dealt = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)) if parts > 1 else F.lit(0))
        dealt = dealt.select("host", F.col("part").cast("long").alias("part"), "wrapper")
        found = stored(
            dealt.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(of_wrappers, "host string, wrapper string")
        )


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    found = wrappers(pages)
    regions = stored(
        each_row(
            found,
            lambda: lambda host, text: (host, json.dumps(region_of(json.loads(text)))),
            "its_host string, region string",
            [("its_host", pa.string()), ("region", pa.string())],
        )
    )
    rows = _hosts(pages).select("page_id", "url", "html", "_host")
    met = rows.join(regions, F.col("_host") == F.col("its_host"), "left").select("page_id", "url", "html", "region")

    def make():
        paths: dict[str | None, list[str]] = {}

        def of(page_id, url, html, region):
            if region not in paths:
                paths.clear()
                paths[region] = json.loads(region) if region else []
            text = main_text(html, paths[region])
            return page_id, url, text, len(text)

        return of

    kind = pages.schema["page_id"].dataType
    return each_row(
        met,
        make,
        f"page_id {kind.simpleString()}, url string, text string, n_chars bigint",
        [("page_id", to_arrow_type(kind)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())],
    )


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
