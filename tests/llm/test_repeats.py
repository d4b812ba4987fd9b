"""Repeated byte strings against their definition, and the arrays that find them."""

import hashlib
import random

import numpy as np
import pytest

from barloom.llm.queries import QUERIES
from barloom.llm.repeats import Suffixes, previous_factors, remove_repeats, smaller_before
from tests.llm import odd
from tests.oracle import DATA


def brute(rows: list[tuple], length: int, keep: str = "none") -> list[tuple]:
    """Rows (id, text) as (id, n_bytes, n_removed, spans, kept), window by window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    seen: dict[bytes, list[tuple]] = {}
    for k in order:
        for at in range(len(texts[k][1]) - length + 1):
            seen.setdefault(texts[k][1][at : at + length], []).append((texts[k][0], at, k))
    out = []
    for k, (i, text) in enumerate(texts):
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - length + 1):
            places = seen[text[at : at + length]]
            # rows of one id and text share the first one's decision
            earlier = (places[0][0], places[0][1]) != (i, at) or texts[places[0][2]][1] != text
            if len(places) > 1 if keep == "none" else earlier:
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        spans = [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2])]
        out.append((i, len(text), int(gone.sum()), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return out


def found(df, **options) -> list[tuple]:
    rows = remove_repeats(df, **options).collect()
    return [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows]


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def corpus(rng: random.Random, n: int) -> list[tuple]:
    """Texts of shared passages with edits, copies, periodic runs and nothing at all."""
    word = lambda: "".join(rng.choices("abcé ", k=rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(rng.randrange(2, 30))) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [rng.choice([word(), rng.choice(passages), "ab" * rng.randrange(40), "a" * rng.randrange(60)]) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + 1 :]
        rows.append((k, rng.choice([text, text, text, None, "", passages[0]])))
    return rows


@pytest.mark.parametrize("length,keep,group", [(12, "none", 2048), (12, "none", 2), (24, "first", 2048), (24, "first", 2), (1, "none", 3), (7, "first", 3)])
def test_against_brute_force(spark, length, keep, group):
    rows = corpus(random.Random(length), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(found(df, length=length, keep=keep, group=group)) == ordered(brute(rows, length, keep))


def test_a_common_passage_between_different_texts(spark):
    """A group of more contexts than a task takes: their edges differ, the passage in the middle does not."""
    rng = random.Random(4)
    common = "".join(rng.choices("abcdefgh", k=90))
    rows = [(k, "".join(rng.choices("ijklm", k=70)) + common + "".join(rng.choices("nopqr", k=70))) for k in range(40)]
    rows += [(40, rows[0][1]), (41, common[10:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        assert ordered(found(df, length=60, keep=keep, group=4)) == ordered(brute(rows, 60, keep))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_odd_documents(spark, keep):
    rows = [(r[0], r[1]) for r in odd.rows()]
    assert ordered(found(odd.docs(spark), length=40, keep=keep)) == ordered(brute(rows, 40, keep))
    assert found(odd.docs(spark, empty=True), keep=keep) == []


def test_long_texts_take_time_in_proportion(spark):
    rows = [(1, "a" * 300_000), (2, "ab" * 100_000), (3, odd.LONG), (4, "z" + odd.LONG), (5, "a" * 400), (6, "a" * 399)]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    whole = {i: (len(t), len(t), [(0, len(t))], b"") for i, t in rows if i in (1, 2, 3, 5)}
    assert {i: got[i][1:] for i in whole} == whole
    assert got[4][2:] == (len(odd.LONG), [(1, 1 + len(odd.LONG))], b"z") and got[6][2:] == (0, [], b"a" * 399)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    wanted = {(i, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute(rows, 400)}
    assert {tuple(r) for r in QUERIES["op12_repeats"](spark, f"{DATA}/sf0.001").collect()} == wanted
    assert sum(w[2] > 0 for w in wanted) > 5


@pytest.mark.parametrize("seed", range(20))
def test_arrays(seed):
    rng = np.random.default_rng(seed)
    values = rng.permutation(int(rng.integers(1, 60)))
    assert smaller_before(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    text, length = rng.integers(97, 99, 200).astype(np.uint8), int(rng.integers(1, 40))
    at = np.sort(rng.choice(200 - length, 100, replace=False)) if length < 90 else np.arange(100)
    raw = text.tobytes()
    common = lambda a, b: next((k for k in range(length) if raw[a + k] != raw[b + k]), length)
    wanted = [max((common(at[i], at[j]) for j in range(i)), default=0) for i in range(len(at))]
    assert previous_factors(Suffixes(text, length), at).tolist() == wanted
