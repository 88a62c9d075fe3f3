"""WARC archives and main texts of pages."""

from __future__ import annotations

import base64
import hashlib
import html as references
import io
import re
from collections import Counter, defaultdict

import pytest

from pagewatch.llm import id_files, warc, wrappers

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, bytes string, row string, text string"


def page_rows():
    bodies = [None, "", "<p>a</p>", "<p>a</p>", "é\U0001f600" * 40_000, "x", "<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n"]
    rows = [(10 - i, f"http://h{i % 2}.example.org/a b\n{i}", b, "b", "r", "t") for i, b in enumerate(bodies)]
    return [*rows, (None, None, "x", None, None, None), (None, "not a url", "<p>a</p>", None, None, None), rows[2], rows[2]]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(page_rows(), PAGES).cache()


def brute_records(rows, least=0):
    payloads = [(p, (h or "").encode()) for p, h in rows]
    groups = defaultdict(list)
    for p, b in payloads:
        groups[b].append(p)
    out, seen = Counter(), set()
    for p, b in sorted(payloads, key=lambda x: (x[0] is None, x[0] or 0)):
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = min(groups[b], key=lambda i: (i is None, i or 0))
        again = len(b) >= least and b in seen
        seen.add(b)
        out[p, len(b), digest, "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_archives_of_awkward_pages(spark, nasty, least):
    folder = id_files.new_folder(spark, "warc")
    records = warc.read_archives(warc.write_archives(nasty, folder, least, archive_bytes=2000), folder)
    found = Counter(
        (r["page"] and int(r["page"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"]))
        for r in warc.resolved(records).collect()
    )
    assert found == brute_records([(r[0], r[2]) for r in page_rows()], least)


def test_empty_archives(spark, nasty):
    none, folder = nasty.limit(0), id_files.new_folder(spark, "warc")
    assert warc.read_archives(warc.write_archives(none, folder), folder).count() == 0
    assert wrappers.extracted(none).count() == 0


def member(payload=b"body", page=1):
    digest = warc.digest_of(hashlib.sha1(payload).digest())
    return warc.record("response", warc.record_id(page, digest, 1), page, "http://x/", digest, payload, None)


class Drip(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, size=-1):
        return super().read(min(7, size) if size > 0 else size)


def test_reader_goes_piece_by_piece():
    raw = member() + member(b"", 2) + member(b"z" * 300_000, 3)
    found = list(warc.read_records(Drip(raw), with_payload=True))
    assert [b"".join(r.pieces) for r in found] == [b"body", b"", b"z" * 300_000]
    assert max(len(p) for p in found[2].pieces) <= warc.PIECE


def test_reader_refuses_damage():
    import gzip

    good = gzip.decompress(member())
    for bad in (
        good.replace(b"body", b"bodx"), good.replace(b"Content-Length: ", b"Content-Length: 1"), good[:-2], good + b"more",
    ):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(member()[:-9])))


# main texts

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a>'
    '</ul></nav><div class="cookie-notice">We use cookies</div>{before}<{tag}><header><h1>Title {n}</h1></header><p>First &amp;  best{n}<b>bold</b>'
    "<p>Second&nbsp;<i>one</i><ul><li>a<li>b</ul>{inside}</{tag}><aside>Side</aside><section id=\"comments\"><p>Nice {n}</section>"
    '<form><p>Mail</p><input></form><footer>&copy; me</footer><script>var x="<p>no</p>";</script></body></html>'
)


def page(n, tag="article", before="", inside=""):
    out = PAGE
    for key, value in {"n": str(n), "tag": tag, "before": before, "inside": inside}.items():
        out = out.replace("{" + key + "}", value)
    return out


def wanted(n):
    return f"Title {n}\nFirst & best{n}bold\nSecond one\na\nb"


@pytest.mark.parametrize("inside", ["", '<div class="ad">Buy</div>', "<nav>1 2</nav>", '<div class="userComments">hm</div>', "<!-- no -->"])
def test_main_text(inside):
    assert wrappers.main_text(page(1, inside=inside), None) == wanted(1)


def test_texts_of_hosts(spark):
    rows = [(i, f"http://a.example.org/{i}", page(i, before="<p>Teaser" if i % 3 else "")) for i in range(30)]
    rows += [(100 + i, f"http://b.example.org/{i}", page(i, tag="div")) for i in range(5)]
    rows += [(200, None, page(7)), (201, "http://[bad", None), (None, "http://a.example.org/x", ""), (203, "http://c.example.org", "just text")]
    found = {r["page_id"]: r for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    for i in range(30):
        assert found[i]["text"] == wanted(i)
    assert found[200]["text"] == wanted(7) and found[201]["text"] == "" == found[None]["text"]
    assert found[203]["text"] == "just text" and found[203]["n_chars"] == 9
    for i in range(5):
        assert f"First & best{i}bold" in found[100 + i]["text"] and "Side" not in found[100 + i]["text"] and "Nice" not in found[100 + i]["text"]


def test_wrapper_has_slots_options_and_repeats():
    one = wrappers.wrapper_of(wrappers.parse("<div><h2>Fixed</h2><p>a</p><p>b</p><p>c</p></div>"))
    two = wrappers.wrapper_of(wrappers.parse("<div><h2>Fixed</h2><p>z</p><hr><em>x</em></div>"))
    both = wrappers.merge(one, two)
    div = both[8][0]
    h2, p, hr = div[8][0], div[8][1], div[8][2]
    assert h2[8] == [["t", "Fixed", False]] and not h2[4]
    assert p[3] and p[8] == [["t", None, False]]
    assert hr[1] == "hr" and hr[4]
    pairs = wrappers.wrapper_of(wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert [(i[1], i[3]) for i in pairs[8][0][8]] == [("dt", True), ("dd", True)]


def test_deep_wide_and_broken_pages():
    for html in ("<div>" * 20_000 + "x", "<p>" * 20_000 + "y", "<b>" * 5000 + "z", "<a href='", "<" * 5000, "<i><p>q</b></i>" * 500, '<a "' * 2000):
        wrappers.main_text(html, None)
    wide = "<article>" + "".join(f"<s{i % 700}x>w</s{i % 700}x>" for i in range(1500)) + "</article>"
    assert wrappers.main_text(wide, None).count("w") == 1500
    wrapper = wrappers.wrapper_of(wrappers.parse(wide))
    assert wrappers.merge(wrapper, wrapper)[7] == 2


def test_texts_of_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(references.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    assert {r["page_id"]: r["text"] for r in wrappers.extracted(pages).collect()} == want


ARTICLE = "".join(f"<p>Sentence {i} of the article says something of its own.</p>" for i in range(6))
AROUND = [
    '<div class="elementor-widget-container">{}</div>',
    '<div class="page has-sidebar">{}</div>',
    '<main class="search-results">{}</main>',
    '<form id="aspnetForm" action="/">{}<input type="hidden" value="x"></form>',
    '<div class="post no-comments" id="content">{}</div>',
    '<section class="widget"><div class="menu-open"><article>{}</article></div></section>',
]


@pytest.mark.parametrize("around", AROUND)
def test_names_of_containers_do_not_cost_the_article(around):
    text = wrappers.main_text(f"<html><body><nav>Home About</nav>{around.format(ARTICLE)}<footer>Imprint</footer></body></html>", None)
    assert text.split("\n") == [f"Sentence {i} of the article says something of its own." for i in range(6)]


def test_nothing_beside_the_larger_block_is_dropped():
    first, second = ARTICLE, "".join(f"<p>Second block {i} goes on with it.</p>" for i in range(4))
    for page in (f"<div class=a>{first}</div><div class=b>{second}</div>", f"<article class=one>{first}</article><article class=two>{second}</article>"):
        lines = wrappers.main_text(f"<html><body>{page}</body></html>", None).split("\n")
        assert len(lines) == 10 and lines[-1] == "Second block 3 goes on with it."


def test_comments_longer_than_the_article_stay_out():
    comments = "".join(f"<article class='comment-body'><p>I think number {i} is wrong, and here is why, at length.</p></article>" for i in range(30))
    for body in (f"<article>{ARTICLE}</article>", f"<div class=text>{ARTICLE}</div>"):
        text = wrappers.main_text(f"<html><body>{body}<div id=comments>{comments}</div></body></html>", None)
        assert "I think" not in text and "Sentence 5" in text


def test_a_host_with_unique_names_has_a_bounded_wrapper_and_two_templates_work(spark):
    pages = []
    for i in range(400):
        if i % 4:
            heads = "".join(f"<h2 id='topic-{i}-{k}' class='t{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}x{k}'>Topic {k}</h2><p>Text {i} {k} is here.</p>" for k in range(3))
            pages.append((i, f"https://h.example/{i}", f"<html><body><article>{heads}</article></body></html>"))
        else:
            pages.append((i, f"https://h.example/{i}", f"<html><body><article>Teaser {i}.</article><div class=story>{ARTICLE}</div></body></html>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)
    sizes = []
    for n in (100, 400):
        rows = wrappers.wrappers(df.where(f"page_id < {n}")).collect()
        assert len(rows) == 1
        sizes.append(len(rows[0]["wrapper"]))
    assert sizes[1] < 2 * sizes[0] < 200_000
    texts = {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}
    assert texts[1].split("\n") == [x for k in range(3) for x in (f"Topic {k}", f"Text 1 {k} is here.")]
    assert "Sentence 5 of the article" in texts[4]
