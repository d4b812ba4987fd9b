"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A text is cut into leaves, runs of pre-tokens of about a fixed number of characters.  Leaves hold the
lengths of their characters and tokens; inner nodes hold sums.  After an edit only the leaves that it
touches are cut into pre-tokens and encoded again, together with boundary context: the leaf before
(its last pre-token may grow, and the pattern looks ahead) and as many leaves after as it takes until
the new cut meets an old leaf boundary.  Sums are then updated on the path to the root.

The boundaries that leaves may begin at are such that cutting from there gives the same pre-tokens as
cutting the whole text: a leaf begins where a pre-token begins with a letter, or a blank and a letter,
after something that is neither white space nor an apostrophe.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import PLAIN, WHITE, byte_bpe, character_class
from barloom.llm.common import slices

# The pattern of the byte-level vocabulary.
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LETTERS, _NUMBERS = (character_class(kind, PLAIN) for kind in "LN")
#: The same for texts below the character PLAIN, with the classes written out.
_PLAIN = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{WHITE}{_LETTERS}{_NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
Edit = tuple[int, int, str]


def split(text: str) -> list[str]:
    """The pre-tokens of a text."""
    return (_PLAIN if text.isascii() or max(text) < chr(PLAIN) else PATTERN).findall(text)


class PieceCounts(dict):
    """Numbers of tokens of pre-tokens, for the texts at hand."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe = byte_bpe(path)

    def __missing__(self, piece: str) -> int:
        found = self[piece] = len(self.bpe.encode_piece(piece.encode("utf-8", "replace")))
        return found

    def fill(self, texts: list[list[str]]) -> None:
        """Counts the distinct pre-tokens of cut texts together."""
        new = [p for p in set().union(*texts) if p not in self]
        self.update(zip(new, map(len, self.bpe.encode_pieces([p.encode("utf-8", "replace") for p in new]))))


def count(text: str, counts: PieceCounts) -> int:
    """Tokens of a text, encoded whole."""
    return sum(map(counts.__getitem__, split(text)))


def _may_begin(before: str, piece: str) -> bool:
    """Whether a cut from the start of ``piece``, after ``before``, goes on as a cut of the whole text does."""
    letter = piece[1:2] if piece[0] == " " else piece[0]
    return letter.isalpha() and not before[-1].isspace() and before[-1] != "'" and "'" not in before


class CountTree:
    """Leaves (text, tokens) under a heap-ordered tree of (characters, tokens)."""

    def __init__(self, text: str, counts: PieceCounts, leaf: int = 256, pieces: list[str] | None = None):
        self.counts, self.leaf_size, self.encoded = counts, leaf, 0
        self.leaves = self._cut(text, pieces)
        self._build()

    def _cut(self, text: str, pieces: list[str] | None = None) -> list[tuple[str, int]]:
        pieces = split(text) if pieces is None else pieces
        if not pieces:
            return []
        self.encoded += len(pieces)
        ends = list(accumulate(map(len, pieces)))
        sums = [0, *accumulate(map(self.counts.__getitem__, pieces))]
        leaves: list[tuple[str, int]] = []
        first = start = 0
        while first < len(pieces):
            at = bisect_left(ends, start + self.leaf_size, first) + 1
            while at < len(pieces) and not _may_begin(pieces[at - 1], pieces[at]):
                at += 1
            at = min(at, len(pieces))
            leaves.append((text[start : ends[at - 1]], sums[at] - sums[first]))
            first, start = at, ends[at - 1]
        return leaves

    def _build(self) -> None:
        self.width = 1
        while self.width < max(1, len(self.leaves)):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (text, tokens) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = len(text), tokens
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(leaf for leaf, _ in self.leaves)

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds an offset; the last leaf for the end."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if offset >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def replace(self, start: int, end: int, new: str) -> None:
        """The characters from ``start`` to ``end`` become ``new``; both are cut to the text."""
        size = self.chars[1]
        start, end = max(0, min(start, size)), max(0, min(end, size))
        if end < start:
            start, end = end, start
        if not self.leaves:
            self.leaves = self._cut(new)
            self._build()
            return
        first, at = self.leaf_at(start)
        last, _ = self.leaf_at(end)
        if first:
            first -= 1
            at -= len(self.leaves[first][0])
        whole = "".join(leaf for leaf, _ in self.leaves[first : last + 1])
        changed = whole[: start - at] + new + whole[end - at :]
        while True:
            # the next leaf's beginning must still be one
            after = self.leaves[last + 1][0] if last + 1 < len(self.leaves) else ""
            if not after:
                break
            pieces = split(changed + after[: self.leaf_size])
            offset, before = 0, ""
            for piece in pieces:
                if offset >= len(changed):
                    break
                offset += len(piece)
                before = piece
            if changed and offset == len(changed) and _may_begin(before, split(after)[0]):
                break
            last += 1
            changed += after
        fresh = self._cut(changed)
        if len(fresh) == last + 1 - first:
            self.leaves[first : last + 1] = fresh
            for i in range(first, last + 1):
                self.chars[self.width + i], self.tokens[self.width + i] = len(self.leaves[i][0]), self.leaves[i][1]
            low, high = (self.width + first) // 2, (self.width + last) // 2
            while low:
                for k in range(low, high + 1):
                    self._sum(k)
                low, high = low // 2, high // 2
        else:
            self.leaves[first : last + 1] = fresh
            self._build()  # sums only; no leaf is encoded again


def standard_edits(doc_id, text: str, n: int = 3) -> list[Edit]:
    """A fixed series of edits that depends on the id and the text's length: a replacement, an insertion, a deletion, over again."""
    edits: list[Edit] = []
    size = len(text)
    for k in range(n):
        digest = hashlib.blake2b(f"{doc_id}:{k}".encode(), digest_size=8).digest()
        at = int.from_bytes(digest[:4], "big") % (size + 1)
        span = digest[4] % 12
        end = min(size, at + (span if k % 3 != 1 else 0))
        new = "" if k % 3 == 2 else " edited" if digest[5] % 2 else "x's 12"
        edits.append((at, end, new))
        size += len(new) - (end - at)
    return edits


def count_edited(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, leaf: int = 256) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_pieces``, ``n_edits``, ``n_tokens_edited``, ``n_pieces_encoded``, ``text_sha256``.

    ``n_tokens`` and ``n_pieces`` are of the text as it is, ``n_tokens_edited`` and ``text_sha256`` after all
    edits, ``n_pieces_encoded`` how many pre-tokens the edits made the tree encode again.
    ``edits_col`` holds an array of (start, end, new) by code points of the text as edited so far; offsets
    outside are moved to its ends, and a null array has no edits.  Without that column the edits are
    :func:`standard_edits`.  A null text is empty; repeated rows give a row each; other columns are
    ignored.  A document is held whole, with its tree, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            given = batch.column(2).to_pylist() if edits_col else [None] * len(ids)
            cut, counts = [split(t) if t else [] for t in texts], PieceCounts(vocabulary)
            counts.fill(cut)
            for doc, text, pieces, own in zip(ids, texts, cut, given):
                tree = CountTree(text, counts, leaf, pieces)
                before, tree.encoded = tree.total, 0
                edits = [(e["start"], e["end"], e["new"] or "") for e in own or ()] if edits_col else standard_edits(doc, text)
                for edit in edits:
                    tree.replace(*edit)
                rows.append((before, len(pieces), len(edits), tree.total, tree.encoded, hashlib.sha256(tree.text.encode("utf-8", "replace")).hexdigest()))
            names = ["n_tokens", "n_pieces", "n_edits", "n_tokens_edited", "n_pieces_encoded"]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)] + [pa.array([r[5] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names, "text_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = [F.col(id_col), F.col(text_col).cast("string").alias("_text0")]
    if edits_col:
        source.append(F.col(edits_col).cast("array<struct<start:int,end:int,new:string>>").alias("_edits0"))
    return docs.select(*source).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_pieces long, n_edits long, n_tokens_edited long, n_pieces_encoded long, text_sha256 string")
