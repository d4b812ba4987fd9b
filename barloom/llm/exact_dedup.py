"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass one counts, for each slot of a partitioned Bloom filter (two hash functions, each with slots of
its own), how many rows fall into it, and keeps one bit for each slot with two rows or more.  Pass
two probes that filter: a row with a bit missing is certainly alone and passes straight through.
Only the other rows (true copies and the filter's few false positives) are shuffled by their hash
and grouped, so false positives cost a little time and never change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, join_counted

#: The characters of [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Text without white space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _slots(key: Column, bits: int) -> list[Column]:
    """One slot for each hash function, in ranges that don't overlap."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) + F.lit(i * bits) for i in range(2)]


def repeated_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, bits): 64 slots a row; a bit is set where two rows or more fall into its slot."""
    slots = keys.select(F.explode(F.array(*_slots(F.col(key), bits))).alias("slot"))
    return _words(slots.groupBy("slot").count().where("count >= 2"))


def _words(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    )


def split_by(rows: DataFrame, key: str, wanted: DataFrame, bits_per_row: int = 16, max_words: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is certainly not in the one column of ``wanted``, rows where it may be), nothing shuffled.

    The Bloom filter is broadcast up to ``max_words`` words; beyond that the wanted keys themselves meet
    the rows in one shuffle join.
    """
    keys = wanted.toDF("_wanted")
    bits = max(1 << 10, 1 << (bits_per_row * max(1, keys.count()) // 2).bit_length())
    words = checkpoint(_words(keys.select(F.explode(F.array(*_slots(F.col("_wanted"), bits))).alias("slot")).distinct()))
    marked = mark(rows, words, key, bits, words.count() <= max_words, keys)
    return marked.where("not _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe")


def mark(rows: DataFrame, words: DataFrame, key: str, bits: int, small: bool, wanted: DataFrame) -> DataFrame:
    """``rows``, which hold texts, with ``_maybe``: by a ``small`` filter's broadcast, else by one join with the ``wanted`` keys.

    So texts are shuffled once at most, where the filter is too large to send to every executor.
    """
    if small:
        return probe(rows, words, key, bits, True)
    flags = wanted.toDF("_wanted").distinct().withColumn("_found", F.lit(True))
    return rows.join(flags, F.col(key).eqNullSafe(F.col("_wanted")), "left").withColumn("_maybe", F.coalesce("_found", F.lit(False))).drop("_wanted", "_found")


def probe(rows: DataFrame, words: DataFrame, key: str, bits: int, small: bool) -> DataFrame:
    """``rows`` with ``_maybe``: false only for rows whose key certainly occurs once."""
    hit = F.lit(True)
    for i, slot in enumerate(_slots(F.col(key), bits)):
        side = words.select(F.col("word").alias(f"_w{i}"), F.col("bits").alias(f"_b{i}"))
        rows = rows.withColumn(f"_s{i}", slot)
        rows = rows.join(F.broadcast(side) if small else side, F.shiftright(f"_s{i}", 6) == F.col(f"_w{i}"), "left")
        hit = hit & F.expr(f"coalesce(shiftrightunsigned(_b{i}, cast(_s{i} & 63 as int)) & 1L, 0L) = 1L")
    return rows.withColumn("_maybe", hit).drop("_s0", "_w0", "_b0", "_s1", "_w1", "_b1")


def _split(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, max_words: int):
    """(rows with _key and _size that are alone, rows that may be repeated joined to their group)."""
    text = normalised(F.col(text_col))
    rows = docs.withColumns({"_key": F.sha2(text, 256), "_size": F.length(F.coalesce(F.col(text_col), F.lit("")))})
    slim = checkpoint(rows.select(F.col(id_col).alias("_id"), "_key", "_size"))
    n = slim.count()
    bits = max(1 << 10, 1 << (bits_per_row * n // 2).bit_length())
    words = checkpoint(repeated_filter(slim, "_key", bits))
    small = words.count() <= max_words
    maybe = probe(slim, words, "_key", bits, small).where("_maybe")
    best = F.min(F.struct((-F.col("_size")).alias("size"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    groups = checkpoint(
        maybe.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), best.alias("_best"))
        .select("_key", "_n", F.col("_best.id").alias("_keep"))
    )
    return slim, rows, groups, n, lambda df: probe(df, words, "_key", bits, small), lambda df: mark(df, words, "_key", bits, small, groups.where("_n > 1").select("_key"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_words: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical without white space; null counts as the empty text.  Of equal
    texts the one with the most code points stays, then the smallest id (a null id comes last).
    Repeated rows of one id share a decision.  Other columns of ``docs`` are ignored, whatever their
    names.  An empty table gives an empty result.

    The filter is broadcast while it has at most ``max_words`` words of 64 bits; a larger one is
    joined by a shuffle of ids and hashes.
    """
    slim, _, groups, n, probed, _ = _split(docs.select(id_col, text_col), id_col, text_col, bits_per_row, max_words)
    marked = probed(slim)
    alone = marked.where("not _maybe").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_key").alias("text_sha256")
    )
    many = join_counted(marked.where("_maybe").drop("_maybe"), groups, "_key", "_n", n).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_key").alias("text_sha256")
    )
    return alone.unionByName(many)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_words: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are; one row for each text.

    Same rules as :func:`exact_groups`; of repeated rows with the same id, text and length any one
    stays.  Texts of rows that are certainly alone are not shuffled, but where the filter is larger than
    ``max_words``: there each text is shuffled once.
    """
    columns = docs.columns
    packed = docs.select(F.col(id_col).alias("_id0"), F.col(text_col).alias("_text0"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    _, rows, groups, n, _, marking = _split(packed, "_id0", "_text0", bits_per_row, max_words)
    marked = marking(rows.drop("_text0"))
    alone = marked.where("not _maybe").select("_row")
    winners = groups.select("_key", "_n", F.col("_keep"))
    same = F.col("_id0").eqNullSafe(F.col("_keep"))
    many = join_counted(marked.where("_maybe").drop("_maybe"), winners, "_key", "_n", n).where(same)
    many = many.dropDuplicates(["_key"]).select("_row")
    return alone.unionByName(many).select("_row.*")
