"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: homoglyphs of other scripts and full-width forms become plain letters,
digits and symbols inside words become the letters they stand for, everything else becomes single
spaces.  Lexicon entries start at a word; an entry with a closing blank is a whole word, one without
also matches longer words.  Of the entries that match in one word the heaviest counts.  A match
inside an exception phrase counts nothing.  The sum of weights and the same sum normalised by length
go through a logistic curve.

Weights, exception phrases and curve are learned from labelled rows only; the number of rows used is
bounded by a parameter.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Shared, checkpoint, slices

# Letters of other scripts that look like Latin ones, by what they look like.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "ьв", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "пη",
    "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
# Digits and symbols, by the letters they stand for.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
PREFIXES = (4, 5, 6, 7, 8)


@lru_cache(1)
def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 65,536: the folded letter (a blank for none), and the letter it may stand for inside a word (0 for none)."""
    plain, stands = np.full(65_536, 32, np.uint32), np.zeros(65_536, np.uint32)
    for code in range(65_536):
        if 0xD800 <= code < 0xE000:
            continue
        plain[code] = _plain_letter(code)
    for letter, looks in HOMOGLYPHS.items():
        for look in looks:
            for form in (look, look.upper()):
                if len(form) == 1:
                    plain[ord(form)] = ord(letter)
    for sign, letter in SUBSTITUTES.items():
        stands[ord(sign)] = ord(letter)
    return plain, stands


def _plain_letter(code: int) -> int:
    """The lower-case letter or digit that a code point stands for, such as that of a mathematical one; a blank for none."""
    form = unicodedata.normalize("NFKC", chr(code)).lower()
    return ord(form) if len(form) == 1 and unicodedata.category(form)[0] in "LN" else 32


def fold(text: str | None) -> str:
    """The text as folded words between single blanks, one at either end."""
    if not text:
        return " "
    plain, stands = fold_tables()
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    high = raw > 65_535
    if high.any():
        codes, at = np.unique(raw[high], return_inverse=True)
        raw = raw.copy()
        raw[high] = np.array([_plain_letter(int(code)) for code in codes], np.uint32)[at]
    low = np.minimum(raw, 65_535)
    out, other = np.where(raw > 65_535, raw, plain[low]), stands[low]
    letter = (out != 32) & (other == 0)
    sub = other != 0
    if sub.any():
        digit = (raw >= 48) & (raw <= 57)
        before, after, word_before, word_after = (np.zeros(len(raw), bool) for _ in range(4))
        before[1:], after[:-1] = letter[:-1], letter[1:]
        word_before[1:], word_after[:-1] = (letter | digit)[:-1], (letter | digit)[1:]
        # a digit stands for a letter beside one; a symbol also needs a letter or digit on either side
        out = np.where(sub & (before | after) & (digit | (word_before & word_after)), other, out)
    return " " + " ".join(out.astype("<u4").tobytes().decode("utf-32-le").split()) + " "


def entries_of(folded: str) -> set[str]:
    """Whole words and word beginnings of a folded text."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for n in PREFIXES for w in words if len(w) >= n}


def _counted(rows: DataFrame, make, limit: int = 1 << 20) -> DataFrame:
    """(toxic, entry, n): in how many rows (toxic, _text) each entry occurs; summed within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {"toxic": pa.array([k[0] for k in part], pa.int32()), "entry": pa.array([k[1] for k in part], pa.string()), "n": pa.array([counts[k] for k in part], pa.int64())}
                )
            counts.clear()

        for batch in slices(batches):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((toxic, e) for e in make(fold(text)))
                if len(counts) > limit:
                    yield from out()
        yield from out()

    return rows.select("toxic", "_text").mapInArrow(run, "toxic int, entry string, n long").groupBy("toxic", "entry").agg(F.sum("n").alias("n"))


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = ()):
        self.trie = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.trie.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.trie.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        self.any = len(self.trie) > 0
        if self.any:
            self.trie.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of each word that counts."""
        if not self.any:
            return []
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.trie.iter(folded):
            start = end - length + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > best.get(start, 0):
                best[start] = weight
        for a, b in spared:
            for at in [k for k in best if a <= k < b]:
                del best[at]
        return sorted(best.items())

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + the sum of weights, log of 1 + that sum for 100 words)."""
        folded = fold(text)
        total = sum(w for _, w in self.matches(folded))
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + penalty * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: DataFrame, max_rows: int = 20_000, support: int = 5, least_weight: float = 3.0, least_z: float = 3.5) -> dict:
    """Lexicon and curve from ``rows`` (_id, _text, toxic): at most about ``max_rows`` rows of each label.

    An entry needs ``support`` toxic rows, a log ratio of its shares in toxic and clean rows of
    ``least_weight`` and a ratio to its standard error of ``least_z``.  Exception phrases are an entry's
    word with the word before or after it, where they occur in ``support`` rows and mostly in clean ones.
    Without rows of both labels every score is that of the one label there is, clean if there is none.
    """
    rows = rows.where("toxic in (0, 1)")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, max_rows / max(1, sizes.get(k, 0))))])
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 20)) / (1 << 20)
    sample = checkpoint(rows.where(place < F.element_at(share, F.col("toxic"))))
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    spark = rows.sparkSession
    # Entries need support, so at most (entries of the bounded sample) / support are kept
    seen = _counted(sample.where("toxic = 1"), entries_of).where(F.col("n") >= support).collect()
    candidates = Shared(spark, {r["entry"] for r in seen})
    others = {r["entry"]: r["n"] for r in _counted(sample.where("toxic = 0"), lambda f: entries_of(f) & candidates.get(lambda x: x)).collect()}
    weights = {}
    for r in seen:
        a, b = r["n"] + 0.5, others.get(r["entry"], 0) + 0.5
        weight = math.log(a / (toxic + 1)) - math.log(b / (clean + 1))
        if weight >= least_weight and weight / math.sqrt(1 / a + 1 / b) >= least_z:
            weights[r["entry"]] = round(weight, 6)

    first = Shared(spark, weights)

    def phrases(folded: str) -> set[str]:
        lexicon = first.get(Lexicon)
        found = set()
        for at, _ in lexicon.matches(folded):
            end = folded.find(" ", at + 1)
            before = folded.rfind(" ", 0, at) if at else -1
            after = folded.find(" ", end + 1)
            found |= {folded[before + 1 : end]} if before >= 0 else set()
            found |= {folded[at + 1 : after]} if after > 0 else set()
        return found

    shared: dict[str, list[int]] = {}
    for r in _counted(sample, phrases).where(F.col("n") >= support).collect():
        shared.setdefault(r["entry"], [0, 0])[r["toxic"]] = r["n"]
    exceptions = sorted(p for p, (c, t) in shared.items() if c >= support and c * max(1, toxic) > 2 * t * max(1, clean))

    final = Shared(spark, (weights, exceptions))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = final.get(lambda x: Lexicon(*x))
        for batch in slices(batches):
            f = [lexicon.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(10 * x[0]) for x in f], pa.int32()), pa.array([round(10 * x[1]) for x in f], pa.int32())], ["toxic", "a", "b"])

    grid = sample.select("toxic", "_text").mapInArrow(bins, "toxic int, a int, b int").groupBy("toxic", "a", "b").count().orderBy("toxic", "a", "b").collect()
    curve = [0.0, 0.0, 0.0]
    if toxic and clean:
        x = np.array([[1.0, r["a"] / 10, r["b"] / 10] for r in grid])
        # the two labels weigh the same
        weigh = np.array([r["count"] * 0.5 * (toxic + clean) / (toxic if r["toxic"] else clean) for r in grid])
        curve = _logistic(x, np.array([r["toxic"] for r in grid], float), weigh).tolist()
    else:  # one label or none to learn from
        curve = [5.0 if toxic else -5.0, 0.0, 0.0]
    return {"weights": weights, "exceptions": exceptions, "curve": curve}


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on), ``n_matches``.

    Scores are rounded to nine digits.  Null and empty texts score as texts without matches.  Texts are
    read whole; repeated rows give a row each; other columns are ignored.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.get(lambda m: Lexicon(m["weights"], m["exceptions"]))
        a, b, c = shared.sent.value["curve"]
        for batch in slices(batches):
            scores, counts = [], []
            for text in batch.column(1).to_pylist():
                folded = fold(text)
                found = lexicon.matches(folded)
                total = sum(w for _, w in found)
                z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, folded.count(" ") - 1))
                scores.append(round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 9))
                counts.append(len(found))
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), predicted, pa.array(counts, pa.int64())], [id_col, "score", "predicted", "n_matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_matches long")


def held_out(doc_id: Column) -> Column:
    """One row of five is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_ids: int = 4_000_000, **options) -> DataFrame:
    """:func:`score_documents` with ``held_out``, learned from the labelled rows that are not held out.

    ``labels`` are sent to the documents if there are at most ``max_ids``, else joined by a shuffle.
    Documents without an id are not learned from.
    """
    usable = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("toxic")).where(~held_out(F.col("_lid"))).where("_lid is not null")
    usable = usable.groupBy("_lid").agg(F.max("toxic").alias("toxic"))
    usable = F.broadcast(usable) if usable.count() <= max_ids else usable
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model = learn(source.join(usable, F.col("_id") == F.col("_lid")).select("_id", "_text", "toxic"), **options)
    found = score_documents(docs.select(id_col, text_col), model, id_col, text_col)
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", "predicted", "n_matches")
