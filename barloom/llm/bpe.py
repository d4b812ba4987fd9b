"""Byte-pair encoding with a contiguous rank array, and its decoding.

A word is held as the ids of its parts, one for each part boundary, beside the array of ranks of
adjacent parts.  Encoding scans the ranks for their (leftmost) minimum, deletes the boundary there,
and refreshes the two neighbouring ranks, until no adjacent parts merge.  The distinct words of a
batch are encoded together: words of one length are the rows of one array, and each step merges one
pair in every row.  Words are short, so the scan beats a heap; the few long ones take a heap.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices

#: Texts below this character take a pattern with its classes written out.
PLAIN = 0x250
#: Larger than any rank.
NO_RANK = (1 << 31) - 1
#: Words of more units take a heap instead of a scan.
SHORT = 48

# White space as Unicode defines it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The English contractions that the vocabulary's pattern splits off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class Merges:
    """The pairs of parts that merge: their ranks and what they become."""

    def __init__(self, pairs: dict[tuple[int, int], int], merged: list[int]):
        """``pairs``: rank of (left id, right id); ``merged``: id by rank."""
        self.of = {a << 32 | b: rank for (a, b), rank in pairs.items()}
        keys = np.fromiter(self.of, np.int64, len(self.of))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(self.of.values(), np.int32, len(self.of))[order], np.int32(NO_RANK))
        self.merged = np.array(merged, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], np.int32(NO_RANK))

    def scan(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their parts) of words of one length, given as rows of unit ids."""
        rows = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                yield rows, parts
                return
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NO_RANK
            if done.any():
                yield rows[done], parts[done]
                going = ~done
                rows, parts, ranks, at, least = rows[going], parts[going], ranks[going], at[going], least[going]
            n, width = ranks.shape
            own = np.arange(n)
            # the boundary behind the place of the minimum goes, with one rank
            later = np.arange(width) > at[:, None]
            parts = np.where(later, parts[:, 1:], parts[:, :-1])
            parts[own, at] = self.merged[least]
            ranks = np.where(later[:, 1:], ranks[:, 1:], ranks[:, :-1])
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(parts[has, at[has] - 1], parts[has, at[has]])
            has = np.flatnonzero(at < width - 1)
            ranks[has, at[has]] = self.rank(parts[has, at[has]], parts[has, at[has] + 1])

    def heap(self, parts: list[int]) -> list[int]:
        """The same for one long word: pairs wait in a heap by rank and place, parts are linked."""
        parts, rank = list(parts), self.of.get
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [rank(parts[i] << 32 | parts[i + 1], NO_RANK) for i in range(n - 1)] + [NO_RANK]
        waiting = [r << 40 | i for i, r in enumerate(current) if r != NO_RANK]
        heapify(waiting)
        while waiting:
            entry = heappop(waiting)
            i = entry & (1 << 40) - 1
            if current[i] != entry >> 40:
                continue
            parts[i] = int(self.merged[entry >> 40])
            gone = after[i]
            current[gone] = NO_RANK
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    current[k] = rank(parts[k] << 32 | parts[after[k]], NO_RANK) if after[k] < n else NO_RANK
                    if current[k] != NO_RANK:
                        heappush(waiting, current[k] << 40 | k)
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return out

    def encode(self, words: list[bytes], units: np.ndarray, last: np.ndarray) -> list[list[int]]:
        """The ids of each word; ``units`` and ``last`` are the ids of bytes, and of bytes that end a word."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        ends = np.flatnonzero(np.diff(lengths[order], append=-1)) + 1
        for group in np.split(order, ends[:-1]):
            size = int(lengths[group[0]]) if len(group) else 0
            if not size:
                continue
            for at in range(0, len(group), 8192):
                own = group[at : at + 8192]
                raw = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(-1, size)
                parts = units[raw]
                parts[:, -1] = last[raw[:, -1]]
                if size > SHORT:
                    for i, row in zip(own.tolist(), parts):
                        out[i] = self.heap(row.tolist())
                    continue
                for rows, found in self.scan(parts):
                    for i, ids in zip(own[rows].tolist(), found.tolist()):
                        out[i] = ids
        return out


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(kept))}
    return [letters[b] for b in range(256)]


def character_class(kind: str, below: int) -> str:
    """A class of the characters under ``below`` whose Unicode category starts with ``kind``."""
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == kind)


class WordBPE:
    """BPE over lower-cased words with an end-of-word mark; white space is dropped.

    Decoding joins token strings with one space, as a vocabulary file without a decoder says.
    Code points that no Unicode version up to 15.1 assigns may be classed otherwise than by the
    vocabulary's own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix: str = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges({(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}, [ids[a + b] for a, b in pairs])
        letters = byte_letters()
        self.units, self.last = np.array([ids[c] for c in letters], np.int64), np.array([ids[c + suffix] for c in letters], np.int64)
        self.names = {i: str(i) for i in self.tokens}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters, numbers = character_class("L", PLAIN), character_class("N", PLAIN)
        self.plain = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")
        self.wide = regex.compile(f"{CONTRACTIONS}|[\\p{{L}}]+|[\\p{{N}}]|[^{WHITE}\\p{{L}}\\p{{N}}]+")

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, lower-cased, split."""
        if text.isascii():
            return self.plain.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # a final sigma is lower-cased as any other
        return (self.plain if max(text, default="") < chr(PLAIN) else self.wide).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Special tokens as they stand, and the words of what is between them."""
        if not self.cut or not any(s in text for s in self.special):
            return self.words(text)
        return [w for piece in self.cut.split(text) for w in ([piece] if piece in self.special else self.words(piece))]

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[str, int, str]]:
        """(decimal ids joined by a space, their number, decoded text) of each text; equal words are encoded once."""
        cut = [self.pieces(text) for text in texts]
        found = dict.fromkeys(chain.from_iterable(cut))
        words = [w for w in found if w not in self.special]
        name, token = self.names.__getitem__, self.tokens.__getitem__
        for word, ids in zip(words, self.merges.encode([w.encode("utf-8", "replace") for w in words], self.units, self.last)):
            found[word] = (" ".join(map(name, ids)), " ".join(map(token, ids)))
        for text in self.special:
            if text in found:
                found[text] = (str(self.special[text]), text)
        for own in cut:
            parts = list(map(found.__getitem__, own))
            ids = " ".join(map(itemgetter(0), parts))
            yield ids, ids.count(" ") + bool(ids), " ".join(map(itemgetter(1), parts))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encode_all([text]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class ByteBPE:
    """BPE over bytes from a file of base64 tokens and ranks; any byte string can be encoded."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}
        self.tokens = {r: t for t, r in self.ranks.items()}
        # parts merge where their bytes together are a token
        ids = self.ranks
        splits = ((t[:k], t[k:], r) for t, r in ids.items() for k in range(1, len(t)))
        self.merges = Merges({(ids[a], ids[b]): r for a, b, r in splits if a in ids and b in ids}, list(range(max(self.tokens) + 1)))
        self.units = np.array([ids[bytes([b])] for b in range(256)], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; a piece that is a token is that token."""
        out = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.merges.encode([pieces[k] for k in rest], self.units, self.units)):
            out[k] = ids
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece, without arrays."""
        return [self.ranks[piece]] if piece in self.ranks else self.merges.heap(self.units[list(piece)].tolist())

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def word_bpe(path: str) -> WordBPE:
    """One for each Python worker."""
    return WordBPE(path)


@lru_cache(1)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``full`` also ``ids`` (array<int>) and ``decoded``.

    ``vocabulary`` is the path of the vocabulary file on every machine.  A null text counts as
    empty: no tokens, decoded to the empty text.  Repeated rows each give a row; a null id stays
    null; other columns are ignored.  Texts of any length, and words of any length, are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in slices(batches):
            rows = list(bpe.encode_all(t or "" for t in batch.column(1).to_pylist()))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out = {
                id_col: batch.column(0),
                "n_tokens": pa.array([r[1] for r in rows], pa.int64()),
                "ids_sha256": pa.array([sha(r[0]) for r in rows], pa.string()),
                "decoded_sha256": pa.array([sha(r[2]) for r in rows], pa.string()),
            }
            if full:
                out["ids"] = pa.array([list(map(int, r[0].split())) for r in rows], pa.list_(pa.int32()))
                out["decoded"] = pa.array([r[2] for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
