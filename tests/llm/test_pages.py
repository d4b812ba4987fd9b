"""WARC archives and page extraction."""

import gzip
import random
import time

import numpy as np
import pytest

from barloom.llm import extract, warc

PAGE = "page_id long, url string, html string, _id int, payload_bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGE)


def test_round_trip(spark):
    html = "<p>Ünï\r\n\r\nWARC/1.0\r\n</p>"
    rows = [(1, "http://a/1", html), (2, None, html), (3, "http://a/3\r\nX: y", None), (4, "u", ""), (5, "u", "x" * 300_000)]
    got = sorted(tuple(r) for r in warc.round_trip(pages(spark, rows)).collect())
    assert got == sorted(tuple(r) for r in warc.round_trip(pages(spark, rows), max_words=0).collect())
    sizes = {r[0]: len((r[2] or "").encode()) for r in rows}
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(1, sizes[1], "response", None), (2, sizes[2], "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, sizes[5], "response", None)]
    assert got[0][2] == got[1][2] == warc._sha1(html.encode())
    assert {r[3] for r in (tuple(x) for x in warc.round_trip(pages(spark, rows), min_bytes=100).collect())} == {"response"}
    assert warc.round_trip(pages(spark, rows[:1]).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "double"])
def test_ids_of_any_type_come_back(spark, kind):
    ids = [("1",), ("7",), ("7",), (None,), (None,)] + [("a b/%>é",), ("",), ("null",)] * (kind == "string")
    df = spark.createDataFrame(ids, "page_id string").selectExpr(f"cast(page_id as {kind}) as page_id", "'u' as url", "coalesce(page_id, '') as html")
    got = warc.round_trip(df)
    assert got.schema["page_id"].dataType == got.schema["refers_to"].dataType == df.schema["page_id"].dataType
    assert sorted(map(str, (r.page_id for r in got.collect()))) == sorted(map(str, (r.page_id for r in df.collect())))


def record(n, body=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{warc._sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def names(data):
    return [x["record_id"] for x in warc.salvage(data) if x["kind"] == "record"], [(x["offset"], x["length"]) for x in warc.salvage(data) if x["kind"] == "gap"]


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_after_damage(zipped):
    parts = [record(i, f"body {i} ".encode() * 20) for i in range(5)]
    if zipped:
        parts = [gzip.compress(p, mtime=0) for p in parts]
    whole = b"".join(parts)
    assert names(whole) == ([f"<urn:page:{i}>" for i in range(5)], [])
    at = len(parts[0]) + len(parts[1]) // 2
    broken = bytearray(whole)
    broken[at] ^= 0xFF
    found, gaps = names(bytes(broken))
    assert found == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)] and gaps == [(len(parts[0]), len(parts[1]))]
    cut = whole[: -len(parts[4]) // 2]
    assert names(cut)[0] == [f"<urn:page:{i}>" for i in range(4)]
    junk = b"\x00" * 7 + whole
    assert names(junk)[1] == [(0, 7)] and len(names(junk)[0]) == 5


def test_every_single_byte_of_damage_leaves_the_others():
    parts = [record(i) for i in range(3)]
    whole, r = b"".join(parts), random.Random(1)
    for at in r.sample(range(len(parts[0]), len(parts[0]) + len(parts[1])), 60):
        broken = bytearray(whole)
        broken[at] ^= 0x55
        found = names(bytes(broken))[0]
        assert "<urn:page:0>" in found and "<urn:page:2>" in found


@pytest.mark.parametrize(
    "html,text",
    [
        ('<div class="content with-sidebar"><h1>T</h1><p>Main text</p></div>', "T\nMain text"),
        ('<div id="page" class="has-header"><h1>T</h1><p>Main text</p></div>', "T\nMain text"),
        ('<div class="page-menu-left"><h1>T</h1><p>Main text that goes on.</p><div class="menu-left">Home Shop</div></div>', "T\nMain text that goes on."),
        ('<div class="page-header"><h1>Title</h1></div><div id="content"><p>Main text that goes on.</p></div>', "Title\nMain text that goes on."),
        ('<div class="site-header"><h1>Shop</h1></div><div><h1>Title</h1><p>Main text that goes on.</p></div>', "Title\nMain text that goes on."),
        ('<form method="post"><div class="top-nav">Home</div><article><h1>T</h1><p>Main</p></article></form>', "T\nMain"),
        ('<form><p>All of the text stands in a form.</p></form><div class="footer">c 2024</div>', "All of the text stands in a form."),
        ('<form>Mail <input></form><p>Main text that goes on.</p>', "Main text that goes on."),
        ('<article><div class="social-history"><p>Long ago.</p></div><div class="related-work"><p>Others.</p></div><div class="social">Like</div></article>', "Long ago.\nOthers."),
        ("<article><p>Press <label>Start</label> to go.</p></article>", "Press Start to go."),
        ('<article><p>Main</p></article><div class="user-reviews"><article class="reply"><p>Me too</p></article><article><p>Nice</p></article></div>', "Main"),
        ('<div class="userReviews"><p>Nothing but what readers wrote.</p></div>', "Nothing but what readers wrote."),
        ('<div class="siteHeader">Shop</div><div class="nav_links2">Home</div><p>Main text that goes on.</p>', "Main text that goes on."),
        ('<div class="article__header"><h2>Part</h2></div><p>Main text that goes on and on.</p><p class="notice-board">Kept.</p>', "Main text that goes on and on.\nKept."),
    ],
)
def test_names_count_by_what_they_hold(html, text):
    assert "\n".join(t for t, verdict in extract.blocks(html) if verdict != extract.OUTSIDE) == text


@pytest.mark.parametrize("part", [b"WARC/ ", b"WARC/1.0\r\n", b"x WARC/1.0\r\n", b"WARC/1.0\r\na: b\r\n", b"a: WARC/1.0\r\n", b"WARC/1.0\r\n\r\n", b"\r\n"])
def test_salvage_takes_time_in_proportion(part):
    """Ten megabytes of what may start a record, before, between and inside records."""
    fill = part * (10_000_000 // len(part))
    began = time.perf_counter()
    assert names(record(1) + fill + record(2) + fill)[0] == ["<urn:page:1>", "<urn:page:2>"]
    assert time.perf_counter() - began < 40  # both reads of 20 MB


def test_a_record_begins_at_the_last_version_line():
    """A header that is cut off gives a gap, and what follows it is read as it is."""
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:8>\r\n"
    assert names(record(1) + cut + record(2)) == (["<urn:page:1>", "<urn:page:2>"], [(len(record(1)), len(cut))])
    odd = record(2).replace(b"WARC-Type", b"Software: reads WARC/1.0\r\nWARC-Type", 1)
    assert names(record(1) + b"garbage" + odd)[0] == ["<urn:page:1>", "<urn:page:2>"]


def test_salvage_inside_a_gzip_member():
    parts = [record(i, random.Random(i).randbytes(3000)) for i in range(9)]
    broken = bytearray(b"".join(parts))
    broken[len(parts[0]) * 4 + 500] ^= 0xFF
    wanted = [f"<urn:page:{i}>" for i in range(9) if i != 4]
    zipped = gzip.compress(bytes(broken), mtime=0) + gzip.compress(record(10), mtime=0)
    rows = list(warc.salvage(zipped))
    assert names(zipped)[0] == [*wanted, "<urn:page:10>"]
    assert [(x["inner_offset"], x["inner_length"], x["reason"]) for x in rows if x["kind"] == "gap"] == [(len(parts[0]) * 4, len(parts[4]), "block digest differs")]
    # a stream that breaks off, and one with a bad byte, give what comes before; the next member is found
    whole = gzip.compress(b"".join(parts), mtime=0)
    bad = bytearray(whole)
    bad[len(whole) // 2] ^= 0xFF
    for damaged in (whole[: len(whole) // 2], bytes(bad)):
        found = names(damaged + gzip.compress(record(10), mtime=0))
        assert found[0][:4] == wanted[:4] and found[0][-1] == "<urn:page:10>" and found[1]
    # without a digest nothing tells a damaged record
    bare = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert names(gzip.compress(bare))[0] == ["<urn:page:1>"] and names(gzip.compress(bare)[:-4])[0] == []


def test_long_addresses_come_back(spark):
    rows = [(1, "http://a/" + "x" * (3 << 20), "<p>one"), (2, "http://a/2", "<p>two")]
    assert sorted(x.page_id for x in warc.round_trip(pages(spark, rows)).collect()) == [1, 2]


def test_empty_archive():
    assert list(warc.salvage(b"")) == []


def text_of(html):
    return [t for t, v in extract.blocks(html) if v != extract.OUTSIDE]


def test_blocks():
    html = "<title>no</title><nav>no</nav><article><h1>A &amp; B</h1><p>one<br>two <b>bo</b>ld&nbsp;x<p>three<script>no</p></script><div class='ad'>no</div><form>no</form><aside>no</aside></article><footer>no</footer>"
    assert text_of(html) == ["A & B", "one", "two bold x", "three"]
    assert text_of("<body><div id=comments><p>no</div><ul><li>a<li>b</ul>1 < 2 and <!-- <p>no --> end") == ["a", "b", "1 < 2 and end"]
    assert text_of(None) == text_of("") == text_of("<style>p{}") == []
    assert text_of("<main><p>in</main><p>out") == ["in"]
    assert text_of("<article class=comment><p>no</article><p>yes") == ["yes"]


def test_attributes_are_whole_names():
    for attributes in ('style="overflow:hidden"', 'title="the hidden valley"', 'data-hidden="false"', 'data-id="nav"', "data-x='class=nav'", 'title="a" data-class=nav', "data-role=navigation", 'title=id=menu class="text"'):
        assert text_of(f"<div {attributes}><article><p>kept</article></div>") == ["kept"], attributes
    for attributes in ("hidden", "HIDDEN=''", 'title="x"hidden', "class = 'top nav'", "data-a=1 id=menu", 'role="navigation"', "aria-hidden=true", "/hidden"):
        assert text_of(f"<div {attributes}><p>gone</p></div><p>kept") == ["kept"], attributes
    assert text_of('<article title="comment" class="ad-free"><p>kept</article>') == ["kept"]


def test_parts_of_an_article_are_kept_whatever_their_class():
    html = '<article><div class="article-header"><h1>Title</h1></div><p class="side note">one</p><header><h2>Part</h2></header><p class="share-price">two</p>{}</article>'
    assert text_of(html.format("")) == ["Title", "one", "Part", "two"]
    for part in ('<div class="comments-area"><p>x</div>', '<p class="ad">x</p>', "<aside>x</aside>", "<footer>x</footer>", '<ul class="share">x</ul>', "<div id=related-posts>x</div>", '<div role="navigation">x</div>'):
        assert text_of(html.format(part)) == ["Title", "one", "Part", "two"], part


@pytest.mark.parametrize("part", ['<a "', "<a =\"", "<!", "<!--", "<b><hr>", "<div></span>", "<p title='", "<li><ul>", "<", "<script>", "</p", "&amp", "<a b=", "x "])
def test_broken_pages_take_time_in_proportion(part):
    began = time.process_time()
    extract.blocks("<p>one</p>" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 20


def test_repeated_equals_brute_force():
    r = random.Random(2)
    for _ in range(60):
        pages_ = [[r.randrange(3) for _ in range(r.randrange(0, 25))] for _ in range(4)]
        least = r.choice((1, 2, 3, 5, 8))
        seen = {}
        for k, p in enumerate(pages_):
            for i in range(len(p) - least + 1):
                seen.setdefault(tuple(p[i : i + least]), set()).add(k)
        wanted = []
        for p in pages_:
            own = [False] * len(p)
            for i in range(len(p) - least + 1):
                if len(seen[tuple(p[i : i + least])]) > 1:
                    own[i : i + least] = [True] * least
            wanted += own
        stream = np.array([t for p in pages_ for t in p], np.int64)
        assert extract.repeated(stream, np.repeat(np.arange(4), [len(p) for p in pages_]), least).tolist() == wanted


def test_host_boilerplate_without_elements(spark):
    notice = "This site uses small files to remember what you like to read"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{notice}</div><div>Page number {i} has its very own text {'abcdefgh'[i]} to show here</div>") for i in range(6)]
    rows += [(10, "http://other.example/1", f"<div>{notice}</div>"), (11, None, None), (12, "", ""), (0, "http://h.example/0", rows[0][2])]
    copy = "<article><p>" + "word " * 30 + "</article>"
    rows += [(20, "http://h.example/20", copy), (21, "http://h.example/21", copy + "<p>after")]
    for most in (1000, 3):
        got = sorted((r.page_id, r.text, r.n_chars) for r in extract.extract(pages(spark, rows), max_pages=most).collect())
        assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
        texts = dict((i, t) for i, t, _ in got)
        assert texts[10] == notice and texts[11] == texts[12] == "" and texts[20] == texts[21] == ("word " * 30).strip()
        if most == 1000:
            assert texts[3] == "Page number 3 has its very own text d to show here"
    assert extract.extract(pages(spark, rows).limit(0)).count() == 0


def test_large_hosts_find_every_repeat(spark):
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    pair, every = [words(12) for _ in range(20)], words(9)
    rows = []
    for i in range(60):
        parts = [words(r.randrange(3, 30)), pair[i % 20] if i < 40 else words(12), every, "x y " * 9]
        r.shuffle(parts)
        rows.append((i, "http://large.example/" + str(i), "<nav>" + every + "</nav>" * (i % 2) + "".join(f"<div>{p}</div>" for p in parts)))
    rows += [(100 + i, f"http://h{i}.example/", f"<div>{pair[i]}</div>") for i in range(5)] + [(200, "http://large.example/200", f"<article><p>{pair[0]}</article>")]
    text = {most: {x.page_id: x.text for x in extract.extract(pages(spark, rows), max_pages=most).collect()} for most in (1000, 10, 1)}
    assert text[1000] == text[10] == text[1]
    assert all(p not in text[10][i] for i in range(1, 60, 2) for p in [*pair, every])
    assert text[10][200] == pair[0] and text[10][101] == pair[1]


def extract_brute(rows, least=8, share=0.5):
    """Pages of plain div blocks: a block goes if half of its words lie in runs of ``least`` words that another page of the host has."""
    cut = {i: [b.split("</div>")[0].split() for b in html.split("<div>")[1:]] for i, _, html in rows}
    host = {i: url.split("/")[2] for i, url, _ in rows}
    content = {i: (host[i], html) for i, _, html in rows}
    seen = {}
    for i, blocks in cut.items():
        words = [w for b in blocks for w in b]
        for k in range(len(words) - least + 1):
            seen.setdefault((host[i], *words[k : k + least]), set()).add(content[i])
    out = {}
    for i, blocks in cut.items():
        words = [w for b in blocks for w in b]
        covered = [False] * len(words)
        for k in range(len(words) - least + 1):
            if len(seen[host[i], *words[k : k + least]]) > 1:
                covered[k : k + least] = [True] * least
        kept, at = [], 0
        for b in blocks:
            if b and sum(covered[at : at + len(b)]) < share * len(b):
                kept.append(" ".join(b))
            at += len(b)
        out[i] = "\n".join(kept)
    return out


def test_extract_equals_brute_force(spark):
    r = random.Random(9)
    words = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    common = [words(r.randrange(6, 16)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(common) if r.random() < 0.4 else f"{words(r.randrange(1, 12))} {r.choice(common) if r.random() < 0.3 else ''}" for _ in range(r.randrange(1, 7))]
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<div>{p}</div>" for p in parts)))
    rows.append((60, rows[0][1], rows[0][2]))  # the same page again is no other page
    wanted = extract_brute(rows)
    assert any(wanted[i] == "" for i in wanted) or any("\n" in t for t in wanted.values())
    for most in (1000, 1):
        assert {x.page_id: x.text for x in extract.extract(pages(spark, rows), max_pages=most).collect()} == wanted
