"""Removing long byte strings that occur elsewhere, by suffix arrays and longest previous factors.

A string of ``length`` bytes is called a window.  No suffix array of a whole corpus is made; windows meet
by their content:

1. Texts that are equal as a whole form a class, and each class is cut up once.
2. Each window chooses an anchor: of all short grams in it the one with the least hash (the first of
   equals).  Equal windows choose the same gram at the same place.  Neighbouring windows with one anchor
   make a context, known by a digest of its bytes.  Only digests are shuffled.
3. A context whose digest occurs twice is repeated as a whole.  Anchors with one context only are done.
4. The other anchors' distinct contexts are fetched.  Those of one anchor go to one task, which sorts
   their suffixes; for each window the previous and next smaller positions in suffix order give the
   earlier text that agrees with it longest.  Mirrored, that gives later text.
5. An anchor with too many contexts for a task is split by content: its windows are cut into halves by
   their distance from the anchor, and contexts go on together only where they agree on all bytes
   common to the windows of their half.  Once halves are single windows, equal digests decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from barloom.llm.common import checkpoint, join_counted, slices, stored
from barloom.llm.exact_dedup import split_by

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTES = np.random.default_rng(20_250_212).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Window starts that are hashed together; longer texts are cut into overlapping pieces.
PIECE = 1 << 20


def gram_size(length: int) -> int:
    """Bytes of an anchor: a power of two, a sixth of a window at most and 64 at most."""
    return 1 << max(0, min(6, (length // 6).bit_length() - 1))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes (a power of two) of ``text``."""
    h, width, power = _BYTES[text], 1, _POWER
    while width < gram:
        h = h[:-width] * power + h[width:]
        h ^= h >> np.uint64(32)
        width, power = 2 * width, power * power
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    return (h ^ (h >> np.uint64(29))) * _MIX2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def cut_contexts(pieces: list[tuple[int, int, memoryview]], length: int) -> tuple[np.ndarray, ...]:
    """The contexts of some pieces of texts (row, offset in the row's text, bytes).

    Returns their rows, starts in the text, numbers of windows, anchors' distances from the start, anchors'
    hashes and digests.
    """
    gram = gram_size(length)
    whole = b"".join(p[2] for p in pieces)
    text = np.frombuffer(whole, np.uint8)
    h = gram_hashes(text, gram)
    # hash above, place below: of equal hashes the first counts, wherever the text lies
    least = sliding_least((h & _HIGH) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    at = np.repeat(np.arange(len(pieces)), sizes - length + 1)
    first = np.cumsum(sizes - length + 1) - (sizes - length + 1)
    begins = (ends - sizes)[at] + np.arange(len(at)) - first[at]
    anchor = (least[begins] & ~_HIGH).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1])]))
    count = np.diff(np.concatenate([new, [len(at)]]))
    begin, piece = begins[new], at[new]
    view = memoryview(whole)
    digests = [blake2b(view[b : b + n + length - 1], digest_size=16).digest() for b, n in zip(begin.tolist(), count.tolist())]
    rows, offsets = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return rows[piece], begin - (ends - sizes)[piece] + offsets[piece], count, anchor[new] - begin, h[anchor[new]].view(np.int64), digests


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, memoryview]]]:
    held: list[tuple[int, int, memoryview]] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = memoryview(text)[at : at + PIECE + length - 1]
            held.append((row, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


CONTEXT = ["key", "digest", "ord", "cls", "starts", "windows", "off"]


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """(key, digest, ord, cls, starts, windows, off): the contexts of each text of ``texts`` (ord, cls, text).

    ``starts`` lists where one text has the same context, so a text of one repeated letter gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ords, classes = batch.column(0), batch.column(1)
            for pieces in _pieces(batch.column(2).to_pylist(), length):
                row, start, windows, off, key, digest = cut_contexts(pieces, length)
                lists = [[s] for s in start.tolist()]
                _, same, times = np.unique(key ^ (row * np.int64(0x1C69B3F74AC4AE35)), return_inverse=True, return_counts=True)
                again = np.flatnonzero(times[same] > 1)
                if len(again):
                    keep, seen = np.ones(len(row), bool), {}
                    for i in again.tolist():
                        first = seen.setdefault((row[i], digest[i]), i)
                        if first != i:
                            lists[first].append(int(start[i]))
                            keep[i] = False
                    kept = np.flatnonzero(keep)
                    row, windows, off, key = row[kept], windows[kept], off[kept], key[kept]
                    lists, digest = [lists[i] for i in kept.tolist()], [digest[i] for i in kept.tolist()]
                places = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(digest, pa.binary()), ords.take(places), classes.take(places), pa.array(lists, pa.list_(pa.int32())), pa.array(windows.astype(np.int32)), pa.array(off.astype(np.int32))],
                    CONTEXT,
                )

    kinds = {"key": LongType(), "digest": BinaryType(), "ord": texts.schema["ord"].dataType, "cls": BinaryType(), "starts": ArrayType(IntegerType()), "windows": IntegerType(), "off": IntegerType()}
    return texts.select("ord", "cls", "text").mapInArrow(run, StructType([StructField(n, kinds[n]) for n in CONTEXT]))


class Suffixes:
    """Suffixes of ``text`` compared on their first ``length`` bytes, by ranks of their first 8, 16, 32, ... bytes."""

    def __init__(self, text: np.ndarray, length: int):
        self.length, n = length, len(text)
        self.base = min(8, length)
        padded = np.concatenate([text, np.zeros(self.base, np.uint8)]).astype(np.uint64)
        self.head = np.zeros(n, np.uint64)
        for k in range(self.base):
            self.head = (self.head << np.uint64(8)) | padded[k : k + n]
        self.levels = [(self.base, self._rank(self.head))]
        while 2 * self.levels[-1][0] <= length:
            self.levels.append((2 * self.levels[-1][0], self._join(*self.levels[-1], self.levels[-1][0])))
        width, rank = self.levels[-1]
        self.rank = rank if width == length else self._join(width, rank, length - width)

    @staticmethod
    def _rank(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.int32)

    def _join(self, width: int, rank: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by ``width`` bytes at a place and as many ``shift`` bytes on."""
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - shift] = rank[shift:] + np.int64(1)
        return self._rank(rank * np.int64(int(rank.max()) + 2) + after)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share, ``length`` at most; both must have so many."""
        found = np.where(self.rank[a] == self.rank[b], self.length, 0)
        rest = np.flatnonzero(found == 0)
        a, b, got = a[rest].copy(), b[rest].copy(), np.zeros(len(rest), np.int64)
        for width, rank in reversed(self.levels):
            step = np.where((got + width <= self.length) & (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)]), width, 0)
            a, b, got = a + step, b + step, got + step
        for _ in range(self.base - 1):  # fewer than the smallest level's bytes are left
            last = len(self.head) - 1
            top = np.uint64(8 * (self.base - 1))
            same = (got < self.length - 1) & (a <= last) & (b <= last)
            same &= (self.head[np.minimum(a, last)] >> top) == (self.head[np.minimum(b, last)] >> top)
            a, b, got = a + same, b + same, got + same
            if not same.any():
                break
        found[rest] = got
        return found


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value; -1 where there is none.

    All places climb a tree of minima until a block on their left holds a smaller value, then go down in it.
    """
    tree = [values]
    while len(tree[-1]) > 1:
        low = tree[-1]
        low = np.append(low, np.iinfo(low.dtype).max) if len(low) % 2 else low
        tree.append(np.minimum(low[0::2], low[1::2]))
    found, level, block = np.full(len(values), -1), np.full(len(values), -1), np.arange(len(values))
    climbing = np.arange(len(values))
    for k, low in enumerate(tree):
        b = block[climbing]
        left = (b % 2 == 1) & (low[np.maximum(b - 1, 0)] < values[climbing])
        there = climbing[left]
        level[there], found[there] = k, b[left] - 1
        climbing = climbing[~left]
        block[climbing] >>= 1
    for k in range(len(tree) - 2, -1, -1):
        on = np.flatnonzero(level > k)
        right = 2 * found[on] + 1
        inside = right < len(tree[k])
        right -= ~(inside & (tree[k][np.minimum(right, len(tree[k]) - 1)] < values[on]))
        found[on] = right
    return found


def previous_factors(suffixes: Suffixes, at: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array of the suffixes at ``at``: bytes, ``length`` at most, that each shares
    with one listed before it.

    In suffix order the longest agreement with an earlier suffix is with the nearest one on either side whose
    number in the list is smaller.
    """
    order = np.lexsort((np.arange(len(at)), suffixes.rank[at]))
    before = smaller_before(order)
    after = len(order) - 1 - smaller_before(order[::-1])[::-1]
    longest = np.zeros(len(at), np.int64)
    for near, has in ((before, before >= 0), (after, after < len(order))):
        one, two = order[has], order[near[has]]
        longest[one] = np.maximum(longest[one], suffixes.common(at[one], at[two]))
    return longest


def _whole_groups(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.Table]:
    """Tables of about ``target`` bytes from rows sorted by ``key``; no key is in two of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, target):
        keys = batch.column(0).to_numpy()
        if size >= target and held:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(keys != last, True)) if len(keys) else 0
            if cut < len(keys):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def compared(fetched: DataFrame, length: int, first: bool, target: int = 1 << 20) -> DataFrame:
    """(cls, start, stop): repeated bytes of the contexts ``fetched``, all of one key together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, target):
            # in the order of texts, so that earlier is before
            table = table.sort_by([("key", "ascending"), ("ord", "ascending"), ("cls", "ascending"), ("start", "ascending")], null_placement="at_start").combine_chunks()
            classes, start, windows, done = (table[c] for c in ("cls", "start", "windows", "done"))
            texts = table["bytes"].to_pylist()
            text = np.frombuffer(b"".join(texts), np.uint8)
            sizes, n = np.array([len(t) for t in texts]), windows.to_numpy()
            place = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(n)), n)
            own = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            suffixes = Suffixes(text, length)
            at = place[row] + own
            hit = previous_factors(suffixes, at) >= length
            if not first:
                hit |= (previous_factors(suffixes, at[::-1]) >= length)[::-1]
            hit &= ~done.to_numpy(zero_copy_only=False)[row]
            found = np.flatnonzero(hit)
            if not len(found):
                continue
            new = np.concatenate([[True], (np.diff(found) > 1) | (np.diff(row[found]) > 0)])
            begin, end = found[new], found[np.concatenate([new[1:], [True]])]
            from_ = start.to_numpy()[row[begin]] + own[begin]
            yield pa.RecordBatch.from_arrays(
                [classes.combine_chunks().take(pa.array(row[begin])), pa.array(from_.astype(np.int32)), pa.array((from_ + end - begin + length).astype(np.int32))], ["cls", "start", "stop"]
            )

    dealt = fetched.select("key", "ord", "cls", "start", "windows", "done", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "cls binary, start int, stop int")


def _halves(fetched: DataFrame, length: int, width: int) -> DataFrame:
    """The contexts ``fetched`` cut where the distance from the anchor passes a multiple of ``width``; keys and digests anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[Any]] = [[] for _ in range(7)]
            column = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names) if name in ("key", "start", "windows", "off", "bytes")}
            for i, (key, start, windows, off, text) in enumerate(zip(*(column[n] for n in ("key", "start", "windows", "off", "bytes")))):
                for part in range((off - windows + 1) // width, off // width + 1):
                    far, near = min(off, part * width + width - 1), max(off - windows + 1, part * width)
                    skip = off - far
                    common = text[off - part * width : off - part * width - width + 1 + length]
                    own = text[skip : skip + far - near + length]
                    name = blake2b(common, digest_size=8, salt=part.to_bytes(4, "big"), key=key.to_bytes(8, "big", signed=True)).digest()
                    for to, value in zip(out, (int.from_bytes(name, "big", signed=True), blake2b(own, digest_size=16).digest(), i, start + skip, far - near + 1, far, own)):
                        to.append(value)
            take = pa.array(out[2], pa.int64())
            ordered, classes, done = (batch.column(batch.schema.get_field_index(n)).take(take) for n in ("ord", "cls", "done"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), ordered, classes, pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()), done, pa.array(out[6], pa.binary())], FETCHED
            )

    return fetched.select(*FETCHED).mapInArrow(run, fetched.select(*FETCHED).schema)


FETCHED = ["key", "digest", "ord", "cls", "start", "windows", "off", "done", "bytes"]


def _many(rows: DataFrame) -> DataFrame:
    """(key, n): the keys with several digests in ``rows``, which has a row for each."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _fetch(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The contexts ``wanted`` (FETCHED without bytes, and n) with their bytes."""
    own = wanted.groupBy("cls").agg(F.collect_list(F.struct("key", "digest", "ord", "start", "windows", "off", "done", "n", "size")).alias("list"))  # a text's contexts, fewer than its bytes
    source = split_by(texts.select("cls", "text"), "cls", own.select("cls"))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists, texts = batch.column(1), batch.column(2).to_pylist()
            rows = lists.flatten()
            parent = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, size = rows.field("start").to_numpy(zero_copy_only=False), rows.field("size").to_numpy(zero_copy_only=False)
            found = [texts[p][s : s + n] for p, s, n in zip(parent.tolist(), start.tolist(), size.tolist())]
            fields = {**{n: rows.field(n) for n in ("key", "digest", "ord", "start", "windows", "off", "done", "n")}, "cls": batch.column(0).take(pa.array(parent)), "bytes": pa.array(found, pa.binary())}
            yield pa.RecordBatch.from_arrays([fields[n] for n in [*FETCHED, "n"]], [*FETCHED, "n"])

    kinds = {f.name: f.dataType for f in wanted.schema.fields} | {"bytes": BinaryType()}
    return own.join(source, "cls").select("cls", "list", "text").mapInArrow(run, StructType([StructField(n, kinds[n]) for n in [*FETCHED, "n"]]))


def repeated_bytes(texts: DataFrame, length: int, first: bool, group: int) -> DataFrame:
    """(cls, start, stop) of bytes of ``texts`` (ord, cls, text; a row for each distinct text) under windows that occur elsewhere.

    With ``first`` only windows count that occur earlier: in a text with a smaller ``ord``, or before in their own.
    """
    cut = stored(contexts(texts, length))
    least = F.min(F.struct("ord", "cls", F.array_min("starts").alias("start"))).alias("least")
    known = cut.groupBy("key", "digest").agg(F.sum(F.size("starts")).alias("times"), F.count(F.lit(1)).alias("rows"), F.first("windows").alias("windows"), F.first("off").alias("off"), least)
    known = checkpoint(known.select("key", "digest", "times", "rows", "windows", "off", "least.*"))

    # contexts that occur more than once are repeated as a whole; with ``first`` all but the earliest
    again = known.where("times > 1").select("digest", F.col("rows").alias("_n"), "ord", "cls", "start")
    again = again.toDF("digest", "_n", "_ord", "_cls", "_start")
    each = join_counted(cut.select("digest", "cls", "starts", "windows"), again, "digest", "_n", cut.count()).select("cls", F.explode("starts").alias("start"), "windows", "_cls", "_start")
    if first:
        each = each.where("not (cls = _cls and start = _start)")
    found = [each.select("cls", "start", (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("stop"))]

    many = checkpoint(_many(known))
    named = known.select("key", "digest", "ord", "cls", "start", "windows", "off", (F.lit(not first) & (F.col("times") > 1)).alias("done"))
    wanted = join_counted(named, many, "key", "n", known.count()).withColumn("size", F.col("windows") + F.lit(length - 1))
    fetched = checkpoint(_fetch(wanted, texts))
    width = 1 << ((length // 2).bit_length() - 1) if length > 1 else 1
    while True:
        found.append(compared(fetched.where(F.col("n") <= group), length, first))
        large = fetched.where(F.col("n") > group)
        if not large.limit(1).count():
            break
        halves = checkpoint(_halves(large, length, width))
        # in a window over one digest the rows are counted by a join, so that a common one is not one task
        counted = halves.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("ord", "cls", "start")).alias("_least"), F.max("done").alias("_done"), F.min_by("bytes", F.struct("ord", "cls", "start")).alias("bytes"), F.first("windows").alias("windows"), F.first("off").alias("off"))
        counted = checkpoint(counted)
        more = counted.where("_n > 1").select("digest", "_n", F.col("_least").alias("_l")).groupBy("digest").agg(F.sum("_n").alias("_n"), F.min("_l").alias("_l"))
        each = join_counted(halves.select("digest", "ord", "cls", "start", "windows", "done"), more, "digest", "_n", halves.count()).where("not done")
        if first:
            each = each.where("not (cls = _l.cls and start = _l.start)")
        found.append(each.select("cls", "start", (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("stop")))
        many = checkpoint(_many(counted))
        done = F.col("_done") | (F.lit(not first) & (F.col("_n") > 1))
        left = counted.select("key", "digest", "_least.*", "windows", "off", done.alias("done"), "bytes")
        fetched = checkpoint(join_counted(left, many, "key", "n", counted.count()).select(*FETCHED, "n"))
        if width == 1:
            break  # a window alone: its digest has told
        width //= 2
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (_id, text, found, m) with what is left: ``n_bytes``, ``n_removed``, ``spans`` that go, ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, removed, kept, sizes = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2)):
                own: list[list[int]] = []
                if found.is_valid and len(found.values):
                    begin, end = (found.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
                    own = [[int(b), int(e)] for b, e in zip(begin[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])])]
                at, parts = 0, []
                for b, e in own:
                    parts.append(text[at:b])
                    at = e
                parts.append(text[at:])
                kept.append(b"".join(parts))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": b, "stop": e} for b, e in own])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column(3)], [*OUT, "m"])

    span = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
    kinds = [rows.schema["_id"].dataType, LongType(), LongType(), ArrayType(span), BinaryType(), LongType()]
    return rows.select("_id", "text", "found", "m").mapInArrow(run, StructType([StructField(n, k) for n, k in zip([*OUT, "m"], kinds)]))


OUT = ["_id", "n_bytes", "n_removed", "spans", "kept"]


def _untouched(rows: DataFrame) -> DataFrame:
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    return rows.select("_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), F.col("text").alias("kept"), "m")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", group: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``spans`` (start and stop of each maximal run
    that goes) and ``kept``, the other bytes.

    Texts are UTF-8 bytes; null counts as empty.  Every byte under a string of ``length`` bytes that also starts
    at another place goes, whether in another row or overlapping in its own; with ``keep="first"`` only if the other
    place is earlier, in a row with a smaller id (null comes first) or before it in its own, so the first copy stays.
    Strings are judged on the texts as they came, and none crosses rows.  ``kept`` may hold parts of characters.

    Repeated rows of one id and text are copies of one another; with ``keep="first"`` they share a decision.  Texts
    shorter than ``length`` stay as they are.  Other columns are ignored; an empty table gives an empty result.
    ``group`` bounds how many contexts of one anchor a task sorts; larger groups are split, with the same result.
    """
    if keep not in ("none", "first") or length < 1:
        raise ValueError("keep is 'none' or 'first', length at least 1")
    first = keep == "first"
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text"))
    short, long = rows.where(F.length("text") < length), rows.where(F.length("text") >= length)
    long = long.withColumn("cls", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    slim = long.select("_id", "cls", F.length("text").cast("long").alias("n_bytes"))

    ids = slim.groupBy("cls", "_id", "n_bytes").agg(F.count(F.lit(1)).alias("_m"))
    copied = ids.groupBy("cls", "n_bytes").agg(F.sum("_m").alias("n"), F.min(F.struct("_id", "_m")).alias("_f")).where("n > 1")
    copied = checkpoint(copied.select("cls", "n", F.col("_f._id").alias("_first"), F.col("_f._m").alias("_m")))
    alone, maybe = split_by(long, "cls", copied.select("cls"))
    met = maybe.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id"))["_id"].alias("ord"), F.first("text").alias("text"))
    met = stored(met.join(copied.select("cls", "_m"), "cls", "left").select("ord", "cls", "text", "n", F.coalesce("_m", F.lit(1).cast("long")).alias("m")))
    one = F.lit(1).cast("long")
    texts = alone.select(F.col("_id").alias("ord"), "cls", "text", one.alias("n"), one.alias("m")).unionByName(met)

    found = repeated_bytes(texts.select("ord", "cls", "text"), length, first, group)
    if not first:  # texts with a copy go as a whole
        found = found.join(copied.select("cls"), "cls", "left_anti")
    found = checkpoint(found.groupBy("cls").agg(F.collect_list(F.struct("start", "stop")).alias("found")))  # a text's runs, fewer than its bytes
    safe, hit = split_by((texts if first else texts.where("n = 1")).withColumnRenamed("ord", "_id"), "cls", found.select("cls"))
    out = _untouched(short.withColumn("m", one)).unionByName(_untouched(safe)).unionByName(_cut(hit.join(found, "cls", "left")))
    copies = join_counted(slim, copied, "cls", "n", slim.count())
    if first:  # the rows of a first copy's id, m in number, come from its text
        copies = copies.where("not (_id <=> _first)")
        out = out.select(*OUT, F.explode(F.sequence(one, F.col("m")))).drop("col")
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    gone = copies.select("_id", "n_bytes", F.col("n_bytes").alias("n_removed"), span.alias("spans"), F.lit(b"").alias("kept"))
    return out.select(*OUT).unionByName(gone).withColumnRenamed("_id", id_col)
