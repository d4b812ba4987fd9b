"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Texts are lower-cased (A-Z) and cut into words; the automaton works on word numbers, so a match ends
at a word and is never part of a longer word.  Each text is scanned once; the words of a match are
mapped back to character offsets of the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Shared, slices

#: Each byte of UTF-8: letters lower-cased, digits and bytes of other characters kept, the rest blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Automata that a worker holds.
HELD = 2
#: Bytes of texts that are scanned at a time.
SLICE = 4 << 20
#: Items sharing a block from which on its windows are looked up instead of compared one by one.
COMMON = 16
#: A word in the original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, in UTF-8; none for null."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


class Automaton:
    """Where items occur in texts, by blocks of words that lie end to end in each item.

    A window of ``width`` words holds a whole block of (``width`` + 1) // 2 words.  So the automaton knows
    the blocks only, a node for each word of an item, and a block found in a text is compared with
    the item's words on both sides.  An item of fewer words than a window is found whole.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.width = width
        block = (width + 1) // 2
        reach = width - block
        whole: dict[tuple[int, ...], set[str]] = defaultdict(set)
        around: dict[tuple[int, ...], dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            numbers = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            if len(numbers) < width:
                whole[numbers] |= {item} - {None}
                continue
            for at in range(0, len(numbers) - block + 1, block):
                around[numbers[at : at + block]][numbers[max(0, at - reach) : at][::-1], numbers[at + block : at + width]] |= {item} - {None}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        patterns = {*whole, *around} - {()}
        for pattern in patterns:
            sides = around.get(pattern, {})
            windows = _windows(sides, reach) if len(sides) > COMMON else None
            self.trie.add_word(pattern, (len(pattern), whole.get(pattern), [] if windows else [(*side, of) for side, of in sides.items()], windows))
        self.any = bool(patterns)
        if self.any:
            self.trie.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """(words of the text, numbers of its hit words, items with occurring windows)."""
        found = words(text)
        hit: set[int] = set()
        items: set[str] = set()
        if self.any and found:
            own = tuple(map(self.numbers.get, found, repeat(0)))
            reach, seen = self.width - (self.width + 1) // 2, set()
            for end, (length, whole, around, windows) in self.trie.iter(own):
                start, end = end - length + 1, end + 1
                if whole is not None:
                    hit.update(range(start, end))
                    items |= whole
                for left, right, of in around:
                    a, b = start - _alike(left, own[max(0, start - len(left)) : start][::-1]), end + _alike(right, own[end : end + len(right)])
                    if b - a >= self.width:
                        hit.update(range(a, b))
                        items |= of
                for left in range(max(0, reach - len(own) + end), min(reach, start) + 1) if windows else ():
                    own_sides = (left, own[start - left : start] + own[end : end + reach - left])
                    of = windows.get(own_sides)
                    if of is not None:
                        hit.update(range(start - left, end + reach - left))
                        if (start_of := (length, own[start:end], own_sides)) not in seen:
                            seen.add(start_of)
                            items |= of
        return len(found), sorted(hit), items


def _windows(sides: dict[tuple, set[str]], reach: int) -> dict[tuple, set[str]]:
    """The windows around a block that many items share: words on its left and all words beside it, to the items that have them.

    So an occurrence is looked up once for each place of the block in a window, however many items share it.
    """
    found: dict[tuple, set[str]] = defaultdict(set)
    for (left, right), of in sides.items():
        for k in range(max(0, reach - len(right)), min(reach, len(left)) + 1):
            found[k, left[:k][::-1] + right[: reach - k]] |= of
    return dict(found)


def _alike(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """How many items two sequences have in common from their start on."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def shards(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> list[Shared]:
    """The items, broadcast in shards of about ``max_bytes`` of text each, one shard at least."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-total // max_bytes))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    spark = benchmark.sparkSession
    return [Shared(spark, [tuple(r) for r in dealt.where(F.col("shard") == k).select("item", "text").collect()]) for k in range(n)]


def scan_all(parts: list[Shared], texts: list[str | None], width: int) -> list[tuple[int, list[int], set[str]]]:
    """What :meth:`Automaton.scan` finds in each text with the items of all ``parts`` together.

    A worker holds HELD automata; with more parts they are built again for each slice of texts.
    """
    found: list[tuple[int, list[int], set[str]]] = []
    for part in parts:
        finder = part.get(lambda items: Automaton(items, width), f"windows of {width}", HELD)
        new = [finder.scan(text) for text in texts]
        found = [(n, sorted({*hit, *more}), items | others) for (n, hit, items), (_, more, others) in zip(found, new)] if found else new
    return found


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, max_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, ``n_words``, ``hits`` (each hit word's number and its character offsets, in order), ``items`` (sorted ids).

    A window is ``width`` consecutive item words; an item with fewer, but not none, is one window.
    Every word inside an occurrence of a window is hit.  Null and empty texts have no words and no
    hits; repeated documents give a row each; items with the same text all count; an item without an
    id hits words but is not listed; an empty benchmark hits nothing.  Other columns are ignored.

    Benchmarks of more than ``max_bytes`` are scanned in several shards, one automaton each, in the
    same task, so a row is united with no other row; a worker holds two automata at most.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "_id " + kind + ", n_words long, hits array<struct<word:int,start:int,end:int>>, items array<string>"
    parts = shards(benchmark, item_col, item_text_col, max_bytes)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE if len(parts) <= HELD else 8 * SLICE):
            n_words, hits, items = [], [], []
            texts = batch.column(1).to_pylist()
            for text, (n, hit, found) in zip(texts, scan_all(parts, texts, width)):
                n_words.append(n)
                items.append(sorted(found))
                spans = [m.span() for m in _WORD.finditer(text)] if hit else []
                hits.append([{"word": k, "start": spans[k][0], "end": spans[k][1]} for k in hit])
            hit_type = pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_pydict({"_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, hit_type), "items": pa.array(items, pa.list_(pa.string()))})

    return source.mapInArrow(run, schema).select(F.col("_id").alias(id_col), "n_words", "hits", "items")


def is_contaminated(n_hit, n_words, share: int = 20):
    """At least one word hit, and at least one of ``share`` words."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Digest of :func:`find_hits`: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    n_hit = F.size("hits").cast("long")
    return find_hits(docs, benchmark, id_col, text_col, **options).select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, max_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are and nothing shuffled.

    A benchmark of several shards is scanned shard by shard in the same task.
    """
    parts, at = shards(benchmark, item_col, item_text_col, max_bytes), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE if len(parts) <= HELD else 8 * SLICE):
            texts = pc.struct_field(batch.column(0), at).to_pylist()
            clean = [not is_contaminated_counts(len(hit), n) for n, hit, _ in scan_all(parts, texts, width)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.mapInArrow(run, packed.schema).select("_row.*")


def is_contaminated_counts(n_hit: int, n_words: int, share: int = 20) -> bool:
    return n_hit > 0 and share * n_hit >= n_words
