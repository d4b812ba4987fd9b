"""Awkward documents: nulls, empty and very long texts, copies, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string, _row string, kept boolean, component_id long, _maybe boolean, cls string, hits int"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
A = "The quick brown fox jumps over the lazy dog and runs far away from here today."


def rows() -> list[tuple]:
    texts = [(1, A), (2, None), (3, ""), (4, " \t\n"), (5, A), (5, A), (6, A.replace(" ", "\n") + "  "), (7, LONG), (8, "one two"), (9, "ONE TWO"), (None, A), (None, None), (10, "é ü 日本 ß"), (11, A.replace("today", "now"))]
    return [(i, t, None if k % 3 == 0 else "en", None, None, k, "k", "r", k % 2 == 0, 0, True, "c", 1) for k, (i, t) in enumerate(texts)]


def docs(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)
