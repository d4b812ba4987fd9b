"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters as they are, four at a time, and grows with the text it is trained on.

Training: n-grams of all trusted text are counted, summed within a task first; continuation counts,
discounts, context masses and interpolated probabilities come from joins of count tables, sharded by
n-gram and context.

Scoring: texts are taken in blocks of some megabytes.  Each block asks for its distinct n-grams, and
these join the sharded tables; so a frequent n-gram is asked for once by a block, not once by each
text.  The answers meet the block's texts again (a third of their size, packed), where the log
probabilities of all places are looked up and summed for each document.  Nothing is broadcast.

A document is kept if its log perplexity lies between two limits from quantiles of the trusted documents
of its language, as distances from their median; a distance counts by how far a mean over that many
characters strays.  Both sides matter: noise is too surprising, endless repetition not surprising enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, give_back, without
from barloom.llm.exact_dedup import split_by

ORDER = 4
#: Stands before the start of a text; no text should hold this noncharacter (one that does is scored with it).
MARK = "\U0010ffff"
#: Code points that there are: the model below the unigrams is uniform.
ALPHABET = 0x110000
#: Smallest step of a log perplexity in the histograms that quantiles are read from.
STEP = 0.001
#: Width of a bin of the distances from a median.
WIDTH = 0.01
#: Characters whose mean spreads as much by chance as whole documents differ.
LEVEL = 4096


def _numbered(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes below ``size`` as numbers from 0 on, equal for equal codes."""
    if size > 1 << 22:
        return np.unique(codes, return_inverse=True)[1].astype(np.int64)
    place = np.zeros(size, bool)
    place[codes] = True
    place = np.cumsum(place, dtype=np.int32) - 1
    return place[codes].astype(np.int64)


class Grams:
    """The n-grams of some texts, order by order: a number for each start, and one start of each number."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        marks = MARK * (ORDER - 1)
        self.raw = np.frombuffer((marks + marks.join(texts)).encode("utf-32-le", "replace"), np.uint32)
        self.raw = np.where(self.raw == 0, np.uint32(0xFFFD), self.raw)
        letters = _numbered(self.raw, ALPHABET)
        size = int(letters.max()) + 1
        self.ids = [np.zeros(len(letters) + 1, np.int64), letters]
        for order in range(2, ORDER + 1):
            above = self.ids[-1]
            n = max(0, len(letters) - order + 1)
            self.ids.append(_numbered(above[:n] * size + letters[order - 1 :], (int(above.max()) + 1) * size))
        self.first = []
        for ids in self.ids:
            first = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
            first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
            self.first.append(first)

    def strings(self, order: int) -> list[str]:
        """The distinct n-grams by number."""
        if not order:
            return [""]
        first = self.first[order]
        window = np.ascontiguousarray(self.raw[first[:, None] + np.arange(order)])
        return window.view(f"<U{order}").ravel().tolist()

    def own(self) -> np.ndarray:
        """Numbers of the n-grams of the highest order that end at each character."""
        starts = np.cumsum(self.lengths + ORDER - 1) - self.lengths - (ORDER - 1)
        at = np.arange(int(self.lengths.sum())) + np.repeat(starts - np.cumsum(self.lengths) + self.lengths, self.lengths)
        return self.ids[ORDER][at]

    def surprise(self, p: dict[str, float], mass: dict[str, float]) -> np.ndarray:
        """Negative log probability of each n-gram of the highest order: its own, or what its context leaves to shorter ones."""
        below, left = np.array([p.get("", 1 / ALPHABET)]), np.array([mass.get("", 1.0)])
        for order in range(1, ORDER + 1):
            names, first = self.strings(order), self.first[order]
            found = np.array([p.get(g, np.nan) for g in names])
            shorter = self.ids[order - 1]
            rest = left[shorter[first]] * below[shorter[first + 1]]
            below = np.where(np.isnan(found), rest, found)
            left = np.array([mass.get(g, 1.0) for g in names]) if order < ORDER else left
        return -np.log(below)


def _cut(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least; the cut depends on the texts alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def _blocks(batches: Iterator[pa.RecordBatch], column: int, block_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Groups of small batches with about ``block_bytes`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in _cut(batches, column, min(block_bytes, 1 << 20)):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def _name(block: list[pa.RecordBatch], column: int) -> int:
    """A block's number, from its texts."""
    name = xxhash.xxh3_64()
    for part in block:
        for text in _texts(part, column):
            name.update(text.encode("utf-8", "replace"))
            name.update(b"\xff")
    return name.intdigest() - (1 << 63)


def count_ngrams(trusted: DataFrame, text_col: str) -> DataFrame:
    """(gram, c): how often each n-gram of the highest order occurs in all of ``trusted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cut(batches, 0, 1 << 20):
            grams = Grams(_texts(part, 0))
            counts = np.bincount(grams.own(), minlength=len(grams.first[ORDER]))
            kept = np.flatnonzero(counts)
            names = grams.strings(ORDER)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in kept.tolist()], pa.string()), pa.array(counts[kept], pa.int64())], ["gram", "c"])

    return trusted.select(F.col(text_col).cast("string")).mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order, from its numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    if not (n1 and n2):
        return 0.5, 0.75, 0.9  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, p, mass) for each n-gram of any order: p is its interpolated probability, or mass what it gives as a context to the next lower order.

    An n-gram that is both has two rows.  The highest order has raw counts, the others count distinct
    left neighbours; the empty n-gram has the uniform probability.
    """
    levels = [checkpoint(count_ngrams(trusted, text_col))]
    for _ in range(ORDER - 1):
        levels.insert(0, checkpoint(levels[0].groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("c"))))
    nothing = F.lit(None).cast("double")
    lower = trusted.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(1 / ALPHABET).alias("p"))
    tables = [lower.withColumn("mass", nothing)]
    for order, counts in enumerate(levels, 1):
        d1, d2, d3 = _discounts(counts)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        cut = counts.select("gram", F.substring("gram", 1, order - 1).alias("context"), F.substring("gram", 2, ORDER).alias("suffix"), "c", discount.alias("d"))
        contexts = checkpoint(cut.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("mass")))
        joined = cut.join(contexts, "context").join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        lower = checkpoint(joined.select("gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("mass") * F.col("q")).alias("p")))
        tables += [lower.withColumn("mass", nothing), contexts.select(F.col("context").alias("gram"), nothing.alias("p"), "mass")]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def scored(docs: DataFrame, model: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """The columns of ``docs`` but the last, a text, with ``_n`` (characters) and ``_nll`` (mean negative log probability, null for no characters).

    ``docs`` is read twice, and must give the same rows in the same order both times, as a table does;
    a block that differs is noticed and stops the job.
    """
    column, keep = len(docs.columns) - 1, docs.columns[:-1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, column, block_bytes):
            wanted = {""}
            for part in block:
                grams = Grams(_texts(part, column))
                for order in range(1, ORDER + 1):
                    wanted.update(grams.strings(order))
            yield pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.string()), pa.array([_name(block, column)] * len(wanted), pa.int64())], ["gram", "_block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, column, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                for part in block:
                    file.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([_name(block, column)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_block", "docs"])

    def score(packed: pa.Table, found: pa.Table) -> pa.Table:
        tables: list[dict[str, float]] = []
        for name in ("p", "mass"):
            some = found.filter(pc.is_valid(found[name]))
            tables.append(dict(zip(some["gram"].to_pylist(), some[name].to_pylist())))
        del some
        if "" not in tables[0] or not packed.num_rows:
            raise RuntimeError("The documents changed between two reads; write them to a table first.")
        out = []
        for docs in packed["docs"]:
            for part in pa.ipc.open_stream(docs.as_py()):
                grams = Grams(_texts(part, column))
                lengths, ends = grams.lengths, np.cumsum(grams.lengths)
                sums = np.concatenate([[0.0], np.cumsum(grams.surprise(*tables)[grams.own()])])
                mean = np.divide(sums[ends] - sums[ends - lengths], lengths, out=np.zeros(len(lengths)), where=lengths > 0)
                out.append(pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lengths), pa.array(mean, mask=lengths == 0)], [*keep, "_n", "_nll"]))
        del tables
        give_back()
        return pa.Table.from_batches(out)

    asked = docs.mapInArrow(ask, "gram string, _block long")
    found = asked.join(model, "gram")
    packed = docs.mapInArrow(pack, "_block long, docs binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return packed.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(score, f"{schema}, _n long, _nll double")


def _quantile(q: float) -> Column:
    return F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))


def _ranked(bins: DataFrame, key: str) -> DataFrame:
    """A histogram with running sums (``upto``) and sums (``total``) of each key."""
    sums = bins.groupBy(key, "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(key)
    return sums.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "total": F.sum("n").over(own)})


def _spread() -> Column:
    """How far a document's mean may stray: less the more characters it has, but texts of any length differ."""
    return F.sqrt(1 / F.greatest(F.col("_n"), F.lit(1)) + F.lit(1 / LEVEL))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= 100_000 else df


def fences(scores: DataFrame, tail: float, least: int) -> tuple[DataFrame, tuple[float, float, float] | None]:
    """(lang, mid, low, high) of each language in ``scores`` (lang, _n, _nll), and (mid, low, high) for a language not in it.

    ``mid`` is a language's median of ``_nll``; ``low`` and ``high`` are the quantiles ``tail`` and 1 - ``tail``
    of the distances from it, in units of :func:`_spread`.  A language of fewer than ``least`` documents takes
    these two from the distances of all languages, each from its own median; one without any takes the
    median and the distances of all.  Quantiles are exact to a bin: they are read from histograms, never
    from a gathered list.
    """
    known = scores.where("_nll is not null")
    count = F.count(F.lit(1)).alias("n")
    bins = checkpoint(known.groupBy("lang", F.round(F.col("_nll") / STEP).cast("long").alias("bin")).agg(count))
    mids = checkpoint(_ranked(bins, "lang").groupBy("lang").agg((_quantile(0.5) * STEP).alias("mid")))
    # a bin is a thousandth of a log probability, so there are some 20,000 of these
    middle = _ranked(bins.select(F.lit(0).alias("all"), "bin", "n"), "all").agg(_quantile(0.5) * STEP).first()[0]
    if middle is None:
        return mids.select("lang", "mid", F.col("mid").alias("low"), F.col("mid").alias("high")), None
    cell = lambda own, lang, mid: F.struct(F.lit(own).alias("own"), lang.alias("lang"), F.floor((F.col("_nll") - mid) / _spread() / WIDTH).alias("bin"))
    off = known.join(_few(mids), "lang").select(F.explode(F.array(cell(True, F.col("lang"), F.col("mid")), cell(False, F.lit(""), F.lit(middle)))).alias("cell"))
    cells = checkpoint(off.groupBy("cell.own", "cell.lang", "cell.bin").agg(count))
    limits = [(_quantile(tail) * WIDTH).alias("low"), ((_quantile(1 - tail) + 1) * WIDTH).alias("high")]
    every = {r.own: r for r in _ranked(cells, "own").groupBy("own").agg(*limits).collect()}  # two rows
    own = _ranked(cells.where("own"), "lang").groupBy("lang").agg(*limits, F.first("total").alias("total"))
    pick = lambda side: F.when(F.col("total") >= least, F.col(side)).otherwise(F.lit(every[True][side])).alias(side)
    return mids.join(own, "lang").select("lang", "mid", pick("low"), pick("high")), (middle, every[False].low, every[False].high)


def judged(docs: DataFrame, trusted_ids: DataFrame, tail: float, margin: float, least: int, max_ids: int, block_bytes: int) -> DataFrame:
    """``docs`` (_id, more columns, _lang, _text) without the text, with ``_n``, ``_nll``, ``low``, ``high``, ``kept``."""
    ids = trusted_ids.distinct()
    ids = F.broadcast(ids) if ids.count() <= max_ids else ids
    among = lambda df: df.join(ids, F.col("_id") == F.col("_trusted"), "left_semi")
    scores = checkpoint(scored(docs, train(among(docs.select("_id", "_text")), "_text"), block_bytes))
    own, rest = fences(among(scores.select("_id", F.col("_lang").alias("lang"), "_n", "_nll")), tail, least)
    own = checkpoint(own.select(F.col("lang").alias("_lang"), F.col("mid").alias("_mid"), F.col("low").alias("_low"), F.col("high").alias("_high")))
    mid, low, high = (F.coalesce(c, F.lit(x).cast("double")) for c, x in zip(("_mid", "_low", "_high"), rest or (None, None, None)))
    found = scores.join(_few(own), "_lang", "left").select(*scores.columns, (mid + margin * low * _spread()).alias("low"), (mid + margin * high * _spread()).alias("high"))
    return found.withColumn("kept", F.coalesce(F.col("_nll").between(F.col("low"), F.col("high")), F.lit(True)))


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tail: float = 0.001, margin: float = 2.0, least: int = 25, max_ids: int = 4_000_000, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, ``n_chars``, ``perplexity``, ``low``, ``high``, ``kept``.

    ``trusted_ids``: one column, ``_trusted``, the ids of the trusted documents; the model counts all
    of them.  Perplexity is per character.  The limits are the quantiles ``tail`` and
    1 - ``tail`` of a language's trusted documents, ``margin`` times as far from their median: the model has
    seen these documents, so others that are as good are more surprising.  A language with fewer than ``least`` of them has the distances from the median
    of all languages, and one without any the fences of all trusted text.  So each document with text is
    judged.  Null and empty texts have no perplexity and are kept, as is everything when nothing is
    trusted.  A null language is one of its own.  Repeated rows give a row each; repeated trusted ids
    count once.  A text of any length is scored whole.
    """
    rows = docs.select(F.col(id_col).alias("_id"), _language(lang_col).alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    found = judged(rows, trusted_ids, tail, margin, least, max_ids, block_bytes)
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.exp("_nll").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), "kept")


def drop_poor(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tail: float = 0.001, margin: float = 2.0, least: int = 25, max_ids: int = 4_000_000, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, columns as they are.

    A verdict depends on language and text alone, so rows are told by a hash of both; only rows that a
    Bloom filter of rejected hashes lets through are shuffled.
    """
    key = lambda lang, text: F.sha2(F.concat(F.length(lang).cast("string"), F.lit(":"), lang, F.coalesce(text, F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("_id"), _language(lang_col).alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("_id", key(F.col("_lang"), F.col("_text")).alias("_key"), "_lang", "_text")
    poor = judged(rows, trusted_ids, tail, margin, least, max_ids, block_bytes).where("not kept")
    poor = checkpoint(poor.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
    packed = docs.select(key(_language(lang_col), F.col(text_col).cast("string")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    safe, maybe = split_by(packed, "_key", poor.select("_key"))
    return safe.select("_row.*").unionByName(without(maybe, poor, "_key", "_n").select("_row.*"))
