"""Main text of web pages, with a suffix array over each host to find what its pages share.

A page is cut into blocks of text by its block elements.  Elements that are never main text (menus,
footers, sidebars, forms, adverts, notices, comments, scripts) are set aside by element, role or name;
where a page has articles or a main part, what stands outside them is set aside too.

All blocks outside articles form the page's token stream.  For each host the streams are concatenated
into one array, whose suffixes are sorted by prefix doubling to the depth of a minimum length; equal
suffixes on distinct pages are substrings that the pages share, and overlapping ones join to the
longest repeats.  Hosts too large for one array compare hashes of all their windows of that length,
which finds the same.  A block that is mostly covered is boilerplate; what is left are the page's own runs.

Text inside an article is never removed for being repeated: copies of an article on two pages are
still both articles.  So the verdict of the suffix array decides over blocks that no element decides.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, join_counted, slices

# Element names of HTML by what they mean for text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside button canvas dialog footer form head header iframe input label menu nav noscript object script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words that class names and ids of what isn't main text end with.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adsbygoogle banner announcement topbar toolbar sponsor sponsored promo cookie cookies cookiebar cookiebanner consent gdpr notice newsletter subscribe popup modal overlay "
    "nav navbar topnav sidenav navigation menu breadcrumb breadcrumbs sidebar side aside widget footer header masthead share sharing social related recommended pagination pager login search".split()
)
#: Such words of what readers wrote.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies review reviews discussion".split())
#: Words that don't name a part of an article: inside it headers, sides, notes and banners belong to it.
OUTER = frozenset("banner announcement topbar toolbar notice side aside footer header masthead".split())
#: Words after a name that leave it what it is, and words before it that tell of something else.
NEUTRAL = frozenset("area articles bar block body bottom box buttons col column container content form group head icons inner item items left link links list main module media news outer panel posts primary right row secondary section slot stories top unit wrap wrapper".split())
ABOUT = frozenset("has with without no hide hides show shows is".split())
#: Elements of running text: inside an article only a whole class name sets them aside.
RUNNING = frozenset("p blockquote pre li dd dt td figcaption span b i em strong a".split())
#: A comment, declaration or tag.  Quotes count after an equals sign only, and nothing is looked at twice.
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</?([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>?", re.DOTALL)
#: One attribute, from its name on: whole names, values never searched.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
#: Elements that a start tag closes when it has no end tag of its own.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

INSIDE, OUTSIDE, OTHER = 0, 1, 2


_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_]+")

#: What a marked element is: never main text, so by name, readers' comments, a form, an article or main part.
HARD, NAMED, COMMENT, FORM, ARTICLE = 1, 2, 3, 4, 5


def _attributes(source: str) -> dict[str, str]:
    own: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(source):
        own.setdefault(key.lower(), "".join(values))
    return own


def _named(name: str, names: str, words: frozenset[str]) -> bool:
    """Whether one of the class names or ids ``names`` is or ends with one of ``words``, or has only neutral words after it."""
    for token in names.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        if not parts or ABOUT & set(parts[:-1]):
            continue
        if token.lower() in words or name not in RUNNING and (parts[-1] in words or parts[0] in words and all(p in NEUTRAL or p.isdigit() for p in parts[1:])):
            return True
    return False


def _kind(name: str, attributes: str, inside: bool) -> int:
    """How an element is marked, by itself alone; ``inside`` an article fewer elements and names count."""
    if name in DROPPED and not (inside and name in ("header", "label")):
        return FORM if name == "form" else HARD
    own = _attributes(attributes) if attributes else {}
    if name not in HEADINGS and name not in ("html", "body") and ("hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in ROLES):
        return HARD
    names = f"{own.get('class', '')} {own.get('id', '')}"
    if name not in HEADINGS and name not in ("html", "body") and _named(name, names, COMMENTS):
        return COMMENT
    if name in ("article", "main"):
        return ARTICLE
    if name in HEADINGS or name in ("html", "body"):
        return 0
    return NAMED if _named(name, names, NAMES - OUTER if inside else NAMES) else 0


def blocks(source: str | None) -> list[tuple[str, int]]:
    """(text, verdict) of a page's blocks in order: INSIDE an article or main part, OUTSIDE of what counts, OTHER (undecided).

    A name sets an element aside unless it holds an article, most of the page's text or its only first heading; a form,
    too.  Readers' comments go as long as anything else is left.  The time is in proportion to the page, also where its markup is broken.
    """
    source = source or ""
    stack: list[tuple[str, int]] = []  # (element, mark)
    opened: Counter[str] = Counter()
    parent, kind, inside = [-1], [0], [False]  # of each mark; the first is the page
    out: list[tuple[str, int, bool]] = []  # (text, mark, in a first heading)
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html_module.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append((text, stack[-1][1] if stack else 0, opened["h1"] > 0))

    def close(k: int) -> None:
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]

    at = 0
    n = len(source)
    while at < n:
        tag = _TAG.search(source, at)
        end = tag.start() if tag else n
        if end > at:
            parts.append(source[at:end])
        if not tag:
            break
        at = tag.end()
        name = (tag.group(1) or "").lower()
        if not name:
            continue
        closing = source.startswith("</", tag.start())
        above = stack[-1][1] if stack else 0
        if name in BLOCK or name in DROPPED and not (name == "label" and inside[above]):
            flush()
        if closing:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        closes, stops = _CLOSES.get(name, {"p"} if name in BLOCK and name != "br" else set()), _STOPS.get(name, {"div", "article", "section", "main", "body", "td", "li"})
        for k in range(len(stack) - 1, -1, -1) if any(opened[c] for c in closes) else ():
            if stack[k][0] in closes:
                close(k)
                break
            if stack[k][0] in stops:
                break
        if name in VOID or tag.group(2).endswith("/"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
            at = stop.end() if stop else n
            continue
        mark = stack[-1][1] if stack else 0
        found = _kind(name, tag.group(2), inside[mark])
        if found:
            parent.append(mark)
            kind.append(found)
            inside.append(inside[mark] or found == ARTICLE)
            mark = len(kind) - 1
        stack.append((name, mark))
        opened[name] += 1
    flush()
    return _verdicts(out, parent, kind)


def _verdicts(out: list[tuple[str, int, bool]], parent: list[int], kind: list[int]) -> list[tuple[str, int]]:
    """Decides over the marked elements of a page by what they hold, and so over its blocks."""
    marks = range(len(kind))
    never = [False] * len(kind)  # in an element that is set aside whatever it holds
    for m in marks:
        never[m] = kind[m] == HARD or m > 0 and never[parent[m]]
    text, heading, article = ([0] * len(kind) for _ in range(3))
    for block, m, first in out:
        if not never[m]:
            text[m] += len(block)
            heading[m] += first
    own_heading = list(heading)
    for m in reversed(marks):
        article[m] += kind[m] == ARTICLE and not never[m]
        if m:
            text[parent[m]] += text[m]
            heading[parent[m]] += heading[m]
            article[parent[m]] += article[m]
    doubtful = [False] * len(kind)  # in something named or written by readers
    for m in marks[1:]:
        doubtful[m] = doubtful[parent[m]] or kind[m] in (NAMED, COMMENT, FORM)
    titled = any(own_heading[m] for m in marks if not doubtful[m])
    gone, within = list(never), [False] * len(kind)

    def decide(comments: bool) -> None:
        for m in marks[1:]:
            holds = article[m] > 0 or 2 * text[m] > text[0] or kind[m] == NAMED and heading[m] > 0 and not titled
            gone[m] = never[m] or gone[parent[m]] or kind[m] == COMMENT and comments or kind[m] in (NAMED, FORM) and not holds
            within[m] = not gone[m] and (within[parent[m]] or kind[m] == ARTICLE)

    decide(True)
    if out and all(gone[m] for _, m, _ in out):
        decide(False)  # nothing but comments is left
    alone = any(within)
    return [(block, OUTSIDE if gone[m] or alone and not within[m] else INSIDE if within[m] else OTHER) for block, m, _ in out]


def repeated(tokens: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """Which places of a concatenated token stream lie in a substring of ``least`` tokens or more that occurs on distinct pages.

    Suffixes are ranked by their first 1, 2, 4 ... tokens, the last step going to ``least``; no substring
    runs over a page's end.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < least:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < least:
        step = min(depth, least - depth)
        following = np.full(n, -1, np.int64)
        following[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + following + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    whole = np.zeros(n, bool)
    whole[: n - least + 1] = pages[: n - least + 1] == pages[least - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.lexsort((pages[at], rank[at]))]  # the suffix array
    same = rank[order[1:]] == rank[order[:-1]]
    other = same & (pages[order[1:]] != pages[order[:-1]])
    group = np.concatenate([[0], np.cumsum(~same)])
    shared = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    shared[group[1:][other]] = True
    starts = order[shared[group]] if len(order) else order
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + least, -1)
    return np.cumsum(marks[:-1]) > 0


def _listed(lengths: list[int], undecided: list[bool], covered: np.ndarray, share: float) -> list[int]:
    """Numbers of a page's undecided blocks of which ``share`` or more is covered."""
    ends = np.cumsum(lengths)
    sums = np.concatenate([[0], np.cumsum(covered)])
    return [k for k, (size, end) in enumerate(zip(lengths, ends)) if undecided[k] and size and sums[end] - sums[end - size] >= share * size]


def window_verdicts(streams: DataFrame, least: int, share: float) -> DataFrame:
    """(_page, shared) as in :func:`host_verdicts`, for hosts of any number of pages.

    A window is ``least`` tokens of a page, known by a 128-bit hash of host and tokens.  Its least and
    greatest page are summed up before they are sent, so a window on every page of a host is few rows;
    where they differ it is shared.  Places of shared windows then come back to their pages.
    """
    asked_hosts = streams.where("array_contains(undecided, true)").select("_host").distinct()
    asked = streams.join(asked_hosts, "_host", "left_semi").withColumn("_p", F.xxhash64("_page"))

    def keys(only_undecided: bool):
        names = ["_key", "_page", "_at"] if only_undecided else ["_key", "_p"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1 << 20):
                found, pages, places = [], [], []
                for host, page, lengths, undecided, tokens in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    raw, head = np.array(tokens, np.int64).tobytes(), host.encode("utf-8", "replace") + b"\n"
                    at = np.arange(len(tokens) - least + 1)
                    if only_undecided:
                        asks = np.concatenate([[0], np.cumsum(np.repeat(np.array(undecided, bool), lengths))])
                        at = at[asks[at + least] > asks[at]]
                    own = [xxhash.xxh3_128_digest(head + raw[8 * k : 8 * (k + least)]) for k in at.tolist()]
                    if not only_undecided:
                        own = list(set(own))
                    found += own
                    pages += [page] * len(own)
                    places += at.tolist() if only_undecided else []
                for k in range(0, len(found), 50_000):
                    part = slice(k, k + 50_000)
                    columns = [pa.array(found[part], pa.binary()), pa.array(pages[part], pa.string() if only_undecided else pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(places[part], pa.int32())] if only_undecided else [])], names)

        source = asked.where("array_contains(undecided, true)") if only_undecided else asked
        return source.select("_host", "_page" if only_undecided else "_p", "lengths", "undecided", "tokens").mapInArrow(run, "_key binary, _page string, _at int" if only_undecided else "_key binary, _p long")

    pages_of = keys(False).groupBy("_key").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"), F.count(F.lit(1)).alias("_n"))
    shared = checkpoint(pages_of.where("_first <> _last").select("_key", "_n"))
    places = join_counted(keys(True), shared, "_key", "_n", shared.agg(F.sum("_n")).first()[0] or 0).groupBy("_page").agg(F.collect_list("_at").alias("_starts"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for lengths, undecided, starts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                marks = np.zeros(sum(lengths) + 1, np.int64)
                np.add.at(marks, starts, 1)
                np.add.at(marks, np.array(starts, np.int64) + least, -1)
                found.append(_listed(lengths, undecided, np.cumsum(marks[:-1]) > 0, share))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["_page", "shared"])

    return streams.select("_page", "lengths", "undecided").join(places, "_page").mapInArrow(judge, "_page string, shared array<int>")


def host_verdicts(streams: DataFrame, least: int, share: float, max_pages: int, max_tokens: int = 2_000_000) -> DataFrame:
    """(_page, shared): numbers of each page's blocks that are mostly covered by substrings its host repeats.

    ``streams``: _host, _page, lengths (array<int>), undecided (array<boolean>), tokens (array<long>) in
    page order; only undecided blocks are listed.  A host of at most ``max_pages`` pages and ``max_tokens`` tokens is one suffix
    array; the windows of larger ones are compared over all tasks, with the same verdicts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        lengths, undecided, tokens = (table[c].to_pylist() for c in ("lengths", "undecided", "tokens"))
        counts = np.array([len(t) for t in tokens], np.int64)
        stream = np.fromiter((t for page in tokens for t in page), np.int64, int(counts.sum()))
        covered = np.split(repeated(stream, np.repeat(np.arange(len(counts)), counts), least), np.cumsum(counts)[:-1])
        found = [_listed(page, asked, own, share) for page, asked, own in zip(lengths, undecided, covered)]
        yield pa.RecordBatch.from_arrays([table["_page"].combine_chunks() if table["_page"].num_chunks != 1 else table["_page"].chunk(0), pa.array(found, pa.list_(pa.int32()))], ["_page", "shared"])

    salted = streams.groupBy("_host", F.pmod(F.xxhash64("_page"), F.lit(64)).alias("_salt")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens").cast("long")).alias("t"))
    sizes = checkpoint(salted.groupBy("_host").agg(F.sum("n").alias("_pages"), ((F.sum("n") > max_pages) | (F.sum("t") > max_tokens)).alias("_large")))
    dealt = join_counted(streams, sizes, "_host", "_pages", streams.count())
    small = dealt.where(~F.col("_large")).select("_host", "_page", "lengths", "undecided", "tokens").groupBy("_host").applyInArrow(run, "_page string, shared array<int>")
    if sizes.where("_large").isEmpty():
        return small
    return small.unionByName(window_verdicts(dealt.where("_large").drop("_pages", "_large"), least, share))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 8, share: float = 0.5, max_pages: int = 1000, max_listed: int = 100_000) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars``.

    The text is the page's main blocks, character references decoded, white space made single blanks,
    blocks joined by line ends; empty if there are none (null and empty pages too).  Of the blocks that
    no element decides, those are left out of which ``share`` or more lies in substrings of ``least``
    tokens or more that distinct pages of the host repeat, whatever its number of pages (``max_pages``
    only says up to which a host is one suffix array).  Pages without an address form one host.
    Lists of such blocks are sent to the pages if at most ``max_listed`` pages have one, else joined by
    a shuffle.  Repeated rows are one page to the suffix array and give a row each; other columns are ignored.
    """
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    host = F.coalesce(F.lower(F.regexp_extract(F.col("_url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    named = source.withColumns({"_host": host, "_page": F.sha2(F.concat_ws("\n", host, F.coalesce("_html", F.lit(""))), 256)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lengths, undecided, tokens = [], [], []
            for text in batch.column(2).to_pylist():
                found = blocks(text)
                words = [t.split() if verdict != INSIDE else [] for t, verdict in found]
                undecided.append([verdict == OTHER for _, verdict in found])
                lengths.append([len(w) for w in words])
                tokens.append([xxhash.xxh3_64_intdigest(w) >> 1 for ws in words for w in ws])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.list_(pa.int32())), pa.array(undecided, pa.list_(pa.bool_())), pa.array(tokens, pa.list_(pa.int64()))], ["_host", "_page", "lengths", "undecided", "tokens"])

    streams = named.select("_host", "_page", "_html").mapInArrow(cut, "_host string, _page string, lengths array<int>, undecided array<boolean>, tokens array<long>")
    streams = checkpoint(streams.where("size(tokens) > 0").dropDuplicates(["_page"]))
    verdicts = checkpoint(host_verdicts(streams, least, share, max_pages).where("size(shared) > 0"))
    verdicts = F.broadcast(verdicts) if verdicts.count() <= max_listed else verdicts

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for page, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = set(shared or ())
                texts.append("\n".join(t for k, (t, verdict) in enumerate(blocks(page)) if verdict == INSIDE or verdict == OTHER and k not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {c: source.schema[c].dataType.simpleString() for c in ("_id", "_url")}
    both = named.join(verdicts, "_page", "left").select("_id", "_url", "_html", "shared")
    return both.mapInArrow(join, f"`{id_col}` {kinds['_id']}, `{url_col}` {kinds['_url']}, text string, n_chars long")
