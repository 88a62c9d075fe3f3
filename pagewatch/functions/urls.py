"""URL columns: parts, reference resolution, canonical form, safety and link tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.staging import bind
from pagewatch.functions.text import any_word, non_empty, normalize_space

# RFC 3986, appendix B: scheme, authority, path, query (fragment dropped).
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


class UrlParts:
    """The parts of a URL column as columns."""

    def __init__(self, url: Column) -> None:
        self.url = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
        self.scheme = F.lower(F.regexp_extract(self.url, _SPLIT, 1))
        self.authority = F.regexp_extract(self.url, _SPLIT, 2)
        self.full_path = F.regexp_extract(self.url, _SPLIT, 3)
        self.query = F.regexp_extract(self.url, _SPLIT, 4)

    @property
    def path(self) -> Column:
        """Path without the parameters of its last segment."""
        return F.regexp_replace(self.full_path, r";[^/]*$", "")

    @property
    def host(self) -> Column:
        bare = F.regexp_replace(self.authority, r"^.*@", "")
        bracketed = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
        plain = F.regexp_replace(bare, r":.*$", "")
        return F.regexp_replace(F.lower(F.coalesce(non_empty(bracketed), plain)), r"\.+$", "")


def build_url(scheme: Column, authority: Column, path: Column, query: Column | None = None) -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    base = F.concat(scheme, F.lit("://"), authority, rooted)
    if query is None:
        return base
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments by folding over the path."""
    return bind(
        path, lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|$)"), bind(F.split(p, "/"), _fold_segments)).otherwise(p)
    )


def _fold_segments(segments: Column) -> Column:
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    ends_in_folder = F.element_at(segments, -1).isin(".", "..") & ~joined.endswith("/")
    return F.when(ends_in_folder, F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_reference(base: Column, reference: Column) -> Column:
    """Absolute URL of ``reference`` found on page ``base``.

    Absolute references, the common case, are passed on without taking the base apart.
    """
    return bind(F.trim(reference), lambda ref: F.when(
        ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref
    ).otherwise(_resolved_on(base, ref)))


def _resolved_on(base: Column, ref: Column) -> Column:
    b = UrlParts(base)
    bare = F.regexp_replace(ref, r"#.*$", "")
    fragment = F.regexp_extract(ref, r"(#.+)$", 1)
    ref_path = F.regexp_extract(bare, r"^([^?]*)", 1)
    ref_query = F.regexp_extract(bare, r"(\?.*)$", 1)
    root = F.concat(b.scheme, F.lit("://"), b.authority)
    directory = F.coalesce(non_empty(F.regexp_extract(b.full_path, r"^(.*/)", 1)), F.lit("/"))
    query_tail = F.when(b.query != "", F.concat(F.lit("?"), b.query)).otherwise(F.lit(""))
    return (
        F.when(ref == "", F.regexp_replace(base, r"#.*$", ""))
        .when(ref.startswith("//"), F.concat(b.scheme, F.lit(":"), ref))
        .when(ref.startswith("#"), F.concat(root, b.full_path, query_tail, fragment))
        .when(ref.startswith("?"), F.concat(root, b.full_path, bare, fragment))
        .when(ref.startswith("/"), F.concat(root, _without_dots(ref_path), ref_query, fragment))
        .otherwise(F.concat(root, _without_dots(F.concat(directory, ref_path)), ref_query, fragment))
    )


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _unwrapped(url: Column) -> Column:
    """One step through a ``/redirect?url=`` wrapper, or the url itself."""
    parts = UrlParts(url)
    wrapped = F.regexp_extract(parts.query, r"(?:^|&)url=([^&]+)", 1)
    target = _decoded(F.replace(_decoded(wrapped), F.lit("+"), F.lit("%2B")))
    return F.when((parts.path == "/redirect") & (wrapped != ""), resolve_reference(url, target)).otherwise(url)


def canonical_url(url: Column, redirects: int = 5) -> Column:
    """Unwrap redirects, then drop session ids, path parameters and the fragment.

    Wrappers are rare, so the steps run only for urls that hold one.
    """
    # Nesting the step would copy its input several times per level, so fold over a counter.
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(redirects)), url, lambda acc, _i: _unwrapped(acc))
    target = F.when(F.contains(url, F.lit("/redirect?")), folded).otherwise(url)
    return _stripped(target)


def _stripped(url: Column) -> Column:
    """Scheme, authority, path without session ids or parameters, and query of a hierarchical url."""
    bare = F.regexp_replace(url, r"#.*$", "")
    no_session = F.regexp_replace(bare, r"(?i)(^[^?]*?);jsessionid=[^/?#]+", "$1")
    no_params = F.regexp_replace(no_session, r"^([^?;]*(?:;[^?/]*/[^?;]*)*);[^?/]*(\?|$)", "$1$2")
    return F.regexp_replace(no_params, r"\?$", "")


def query_pairs(query: Column) -> Column:
    """``name=value`` entries with a value, in order."""
    return F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]*=."))


def encode_component(value: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _set_query(query: Column, values: dict[str, Column]) -> Column:
    """Query text with some names replaced in place, or appended when absent."""
    pairs = F.transform(
        query_pairs(query),
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"),
            _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    present = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    names = F.array_distinct(F.concat(present, F.array(*[F.lit(name) for name in values])))

    def entries(name: Column) -> Column:
        own = F.transform(
            F.filter(pairs, lambda p: p["k"] == name),
            lambda p: F.concat_ws("=", encode_component(name), encode_component(p["v"])),
        )
        out = own
        for key, value in values.items():
            out = F.when(name == key, F.array(F.concat_ws("=", F.lit(key), value))).otherwise(out)
        return out

    return F.array_join(F.flatten(F.transform(names, entries)), "&")


def link_url(base: Column, href: Column, onclick: Column, data_params: Column) -> Column:
    """Target of an anchor, including targets that only a script call or JSON attribute names."""
    page = UrlParts(base)
    detail = F.regexp_extract(onclick, r"doDetail\(['\"]?([0-9]+)['\"]?\)", 1)
    detail_path = F.regexp_replace(page.path, r"noticeList\.do$", F.concat(detail, F.lit("noticeDetail.do")))
    view = F.regexp_extract(onclick, r"submitForm\([^,]+,\s*['\"]view['\"]\s*,\s*([0-9]+)\)", 1)
    view_query = _set_query(page.query, {"act": F.lit("view"), "bbsno": view})
    params = F.from_json(data_params, "map<string,string>")
    board_seq = F.try_element_at(params, F.lit("encMenuBoardSeq"))
    board_path = F.regexp_replace(page.path, r"^/menu/", "/menu/board/info/")
    board_query = F.array_join(
        F.transform(
            F.map_entries(params),
            lambda e: F.concat_ws(
                "=", encode_component(e["key"]), encode_component(F.coalesce(e["value"], F.lit("None")))
            ),
        ),
        "&",
    )
    return (
        F.when(detail != "", build_url(page.scheme, page.authority, detail_path))
        .when(view != "", build_url(page.scheme, page.authority, page.path, view_query))
        .when(
            (href == "#") & F.coalesce(board_seq, F.lit("")).isin("", "false", "0").__invert__(),
            build_url(page.scheme, page.authority, board_path, board_query),
        )
        .otherwise(resolve_reference(base, href))
    )


def _ipv4_number(dotted: str) -> int:
    number = 0
    for part in dotted.split("."):
        number = number * 256 + int(part)
    return number


_PRIVATE_RANGES = ", ".join(
    f"struct({_ipv4_number(low)}L AS low, {_ipv4_number(high)}L AS high)" for low, high in fv.PRIVATE_IPV4
)


def _private_ipv4(host: Column) -> Column:
    octet = r"(0|[1-9][0-9]{0,2})"
    pattern = rf"^{octet}\.{octet}\.{octet}\.{octet}$"
    octets = F.transform(
        F.array(*[F.regexp_extract(host, pattern, i) for i in range(1, 5)]), lambda o: o.try_cast("bigint")
    )
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)

    def inside(n: Column) -> Column:
        return F.exists(F.expr(f"array({_PRIVATE_RANGES})"), lambda r: n.between(r["low"], r["high"]))

    return F.coalesce((F.array_max(octets) <= 255) & bind(number, inside), F.lit(False))


def _private_ipv6(host: Column) -> Column:
    """Literal IPv6 addresses outside the globally reachable space."""
    return bind(F.regexp_replace(host, r"%.*$", ""), _reserved_ipv6)


def _reserved_ipv6(address: Column) -> Column:
    mapped = F.regexp_extract(address, r"^::ffff:([0-9.]+)$", 1)
    groups = lambda half: F.filter(F.split(half, ":"), lambda s: s != "")
    halves = F.split(address, "::", 2)
    left, right = groups(halves[0]), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    written = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    digits = F.array_join(F.transform(written, lambda s: F.lpad(s, 4, "0")), "")
    reserved = bind(digits, lambda d: d.rlike(fv.RESERVED_IPV6) & ~d.rlike(fv.REACHABLE_IPV6))
    return F.when(mapped != "", _private_ipv4(mapped)).otherwise(reserved)


def is_public_http_url(url: Column) -> Column:
    """Absolute http(s) url without credentials whose host is not a local or reserved address."""
    parts = UrlParts(F.coalesce(url, F.lit("")))
    address = F.struct(parts.scheme.alias("scheme"), parts.authority.alias("authority"), parts.host.alias("host"))

    def safe(a: Column) -> Column:
        host = a["host"]
        reserved = (
            F.when(F.contains(host, F.lit(":")), _private_ipv6(host))
            .when(host.rlike("^[0-9.]+$"), _private_ipv4(host))
            .otherwise((host == "localhost") | host.endswith(".localhost"))
        )
        plain = a["scheme"].isin("http", "https") & (host != "") & ~F.contains(a["authority"], F.lit("@"))
        return F.when(plain, ~reserved).otherwise(False)

    return bind(address, safe)


def looks_like_notice(
    title: Column, url: Column, base_url: Column, keyword_hint: str | None = None,
    target_words: Sequence[str] = fv.LINK_TARGET_WORDS,
) -> Column:
    """Does an anchor on a board page lead to a notice?

    A keyword hint in the title ends the tests early: it skips the file-name and
    notice-word tests at the end, but none before them.
    """
    low_title = F.lower(normalize_space(title))
    low_url = F.lower(url)
    link, board = UrlParts(url), UrlParts(base_url)
    trimmed = lambda path: F.regexp_replace(path, r"/+$", "")
    same_page = (
        (link.authority == board.authority)
        & (trimmed(link.path) == trimmed(board.path))
        & (link.query == board.query)
    )
    hinted = F.contains(low_title, F.lit(keyword_hint.lower())) if keyword_hint else F.lit(False)
    relevant = hinted | any_word(low_title, target_words) | low_url.rlike(fv.DETAIL_URL_PATTERN)
    same_site = F.contains(link.authority, board.authority) | link.authority.endswith(board.authority)
    noise = any_word(F.lower(title), [w.lower() for w in fv.LINK_NOISE_WORDS])
    accepted = hinted | (
        ~low_title.rlike(fv.FILE_TITLE_PATTERN)
        & F.concat(low_url, F.lit(" "), title).rlike(fv.NOTICE_PATTERN)
    )
    return (
        F.length(title).between(3, 180)
        & ~same_page
        & ~low_title.isin(*fv.MENU_TITLES)
        & relevant
        & link.scheme.isin("http", "https")
        & same_site
        & ~any_word(low_url, fv.FILE_SUFFIXES)
        & ~noise
        & ~low_url.rlike(fv.RSS_PATTERN)
        & accepted
    )


def file_suffix(url: Column) -> Column:
    """Suffix in list order that ends the path, or blank."""
    path = F.lower(UrlParts(url).path)
    found = F.lit("")
    for suffix in reversed(fv.FILE_SUFFIXES):
        found = F.when(path.endswith(suffix), suffix).otherwise(found)
    return found


def detect_suffix(url: Column, disposition: Column, content_type: Column) -> Column:
    """File type from the url, else from the disposition's file name, else from the content type."""
    name = F.trim(F.regexp_extract(F.coalesce(disposition, F.lit("")), r"(?i)filename\*?=(?:UTF-8''|\")?([^\";]+)", 1))
    mime = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^([^;]*)", 1)))
    by_type = F.lit("")
    for known, suffix in fv.CONTENT_TYPE_SUFFIXES.items():
        by_type = F.when(mime == known, suffix).otherwise(by_type)
    return F.coalesce(non_empty(file_suffix(url)), non_empty(file_suffix(name)), by_type)


def is_attachment_link(href: Column, text: Column) -> Column:
    return any_word(F.lower(F.concat_ws(" ", href, normalize_space(text))), fv.FILE_SUFFIXES + ("download",))


def is_content_image(source: Column) -> Column:
    return (source != "") & ~source.startswith("data:") & ~any_word(F.lower(source), fv.IMAGE_LAYOUT_WORDS)
