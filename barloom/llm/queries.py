"""The queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, chat, decontaminate, divergence, exact_dedup, extract, minhash, quality, repeats, tokencount, toxicity, warc, whitening
from barloom.llm.common import table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, on this machine as on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that are labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id as _trusted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.canonical_turns(table(spark, sf_dir, "conversations"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_edited(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), full=False)


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's deviation is a long; null where it doesn't fit
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_minhash": op3_minhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat": op5_chat,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_extract": op10_extract,
    "op11_divergence": op11_divergence,
    "op12_repeats": op12_repeats,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
        WITH h AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
        ), d AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
                       (list_reduce(list_transform(range(10), lambda k: CAST(instr('0123456789ABCDEF', substr(hex, 10 * (i // 8) + k + 1, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)
                       >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
            FROM h
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f
    """,
    "op4_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), spans AS (
            SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos FROM b WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, size, array_to_string(w[pos : pos + size - 1], ' ') AS win FROM spans
        ), sizes AS (
            SELECT DISTINCT size FROM windows
        ), places AS (
            SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size
        ), found AS (
            SELECT p.doc_id, p.pos, p.size, win.item_id FROM places p JOIN windows win
            ON win.size = p.size AND win.win = array_to_string(p.w[p.pos : p.pos + p.size - 1], ' ')
        ), hits AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), k AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), t AS (
            SELECT id, lang, source, unnest(w) AS term FROM d
        ), kept AS MATERIALIZED (
            SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3
        ), g AS MATERIALIZED (
            SELECT DISTINCT lang, source FROM d
        ), v AS (
            SELECT l.lang, count(term) AS v, coalesce(sum(total), 0) AS whole FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN kept USING (lang) GROUP BY ALL
        ), c AS MATERIALIZED (
            SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
        ), s AS (
            SELECT g.lang, g.source, v.v, v.whole, coalesce(sum(c.n), 0) AS size FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL
        ), p AS MATERIALIZED (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + s.v) AS p,
                   1 + (1000000000::HUGEINT * (k.total + 1)) // (s.whole + s.v) AS q
            FROM s JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), every AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), both_ AS (
            SELECT lang, source, 'pair' AS part, item, value FROM every
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
