"""Audit of how the sources of a language differ in their words.

The divergence of two sources sums f(p, q) over all kept terms of the language.  f depends on a term only
through its two counts, so the sum is taken apart by inclusion and exclusion over the terms' supports:

* a constant for terms that neither source has, times the number of kept terms;
* for the terms of one source, its histogram of counts, each priced once against a count of zero;
* for the terms that both have, a join of their postings, which corrects the two one-sided prices.

No table of sources times terms is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, slices, stored

#: Letters and all bytes from 128 on are kept, A-Z lower-cased; the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Parts that the histograms of a language are dealt to.
SALTS = 32


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each task's rows; a row with a null term for every group seen.

    Terms are the runs of letters and characters from U+0080 on, A-Z lower-cased; n counts occurrences, docs
    the rows that hold the term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            pair = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy(zero_copy_only=False)
            groups, group = np.unique(pair, return_inverse=True)
            texts = pa.array([t.translate(_TERMS) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
            # the bytes are UTF-8 with some ASCII characters replaced, so they are text again
            words = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).cast(pa.large_string()))
            row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            full = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
            here = full[code] if len(code) else np.zeros(0, bool)
            size = max(len(terms), 1)
            places, times = np.unique(row[here].astype(np.int64) * size + code[here], return_counts=True)
            key, at = np.unique(group[places // size] * size + places % size, return_inverse=True)
            n, docs_ = np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
            of = np.concatenate([key // size, np.arange(len(groups))])
            names = pa.concat_arrays([terms.take(pa.array(key % size)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
            zero = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(groups[of] // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(groups[of] % max(len(source.dictionary), 1))),
                    names, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs_, zero])),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any counts."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", (wide(count) + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total))


def price(p: Column, q: Column) -> Column:
    """floor((p - q) squared / q); both are at most SCALE + 1, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), q)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Exact sums of ``value``, which may be near the limits of 64 bits, by ``keys``."""
    return rows.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _one_sided(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the constants of each ordered pair and the prices of its one-sided terms."""
    bare = groups.select("lang", "source", "p0", F.lit(None).cast("long").alias("p"), F.col("v").alias("m"))
    counts = posted.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("m")).select("lang", "source", "p0", "p", "m")
    salted = bare.unionByName(counts).withColumn("_salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("i0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    met = salted.join(others, ["lang", "_salt"]).where("source != item")
    p, m, p0, i0 = (F.col(c) for c in ("p", "m", "p0", "i0"))
    own = F.when(p.isNull(), m * price(p0, i0)).otherwise(m * (price(p, i0) - price(p0, i0)))
    back = F.when(p.isNotNull(), m * (price(i0, p) - price(i0, p0)))
    wide = lambda x: F.sum(F.coalesce(x, F.lit(0)).cast("decimal(19,0)"))
    found = met.groupBy("lang", "source", "item").agg(wide(own).alias("_own"), wide(back).alias("_back"))
    return found.select("lang", "source", "item", F.col("_own").alias("value")).unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("_back").alias("value")))


def _overlaps(posted: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms of both sources add to their two one-sided prices.

    Each unordered pair of postings is joined once and gives both orders; tasks sum before the shuffle.
    """
    x = posted.select("lang", "term", "source", "p", "p0")
    y = posted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    added = lambda a, a0, b, b0: price(a, b) - price(a, b0) - price(a0, b) + price(a0, b0)
    met = x.join(y, ["lang", "term"]).where("source < item")
    # a group's probabilities add up to SCALE and one a term, so these sums stay within 64 bits
    found = met.groupBy("lang", "source", "item").agg(F.sum(added(p, p0, q, q0)).alias("_xy"), F.sum(added(q, q0, p, p0)).alias("_yx"))
    return found.select("lang", "source", "item", F.col("_xy").alias("value")).unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("_yx").alias("value")))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language, and by which terms.

    A language keeps the terms that at least ``least`` of its rows hold.  In a group (or language) with N
    occurrences of its V kept terms, a term that occurs c times has p = 1 + floor(SCALE * (c + 1) / (N + V)).
    Part ``pair`` has for each other source of the language the sum over all kept terms of
    floor((p - q)^2 / q), q being the other's; part ``term`` has the ``top`` terms of the source with p above
    the language's q, and their value.  Ranks count from 1 by falling value, then the item's UTF-8 bytes.

    Null texts, languages and sources count as empty ones; a group without terms and a language without kept
    terms (value 0) take part.  Repeated rows and ids count as rows.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    source = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stored(term_counts(source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = counts.where("term is not null")
    kept = stored(words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    posts = words.drop("docs").join(kept, ["lang", "term"])
    sizes = posts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("whole"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "whole"])
    groups = checkpoint(groups.withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0), F.col("size") + F.col("v")))))
    p, q = probability(F.col("n"), F.col("size") + F.col("v")), probability(F.col("total"), F.col("whole") + F.col("v"))
    posted = stored(posts.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0"))

    pairs = _sums(_one_sided(posted, groups).unionByName(_overlaps(posted)), "lang", "source", "item").withColumn("value", F.col("value").cast("long"))
    terms = _ranked(posted.where("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(_ranked(pairs), "pair").unionByName(part(terms, "term"))
