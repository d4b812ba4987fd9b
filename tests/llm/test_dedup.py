"""Exact and near deduplication against brute force."""

import random

import pytest

from barloom.llm import exact_dedup, minhash
from tests.llm import odd


def key(text):
    return (text or "").translate({ord(c): None for c in exact_dedup.SPACE})


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((i, t))
    best = {k: min(v, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0] for k, v in groups.items()}
    return sorted(((i, best[key(t)], len(groups[key(t)]), i == best[key(t)]) for i, t in rows), key=str)


@pytest.mark.parametrize("bits,words", [(16, 4_000_000), (1, 4_000_000), (16, 0)])
def test_exact_groups(spark, bits, words):
    got = exact_dedup.exact_groups(odd.docs(spark), bits_per_row=bits, max_words=words).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == exact_brute([(r[0], r[1]) for r in odd.rows()])
    assert exact_dedup.exact_groups(odd.docs(spark, True)).count() == 0


@pytest.mark.parametrize("words", [4_000_000, 0])
def test_exact_drop_keeps_columns_and_one_row(spark, words):
    docs = odd.docs(spark)
    kept = exact_dedup.drop_exact_copies(docs, max_words=words)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(key(r.text) for r in rows) == sorted({key(r[1]) for r in odd.rows()})
    wanted = {b[1] for b in exact_brute([(r[0], r[1]) for r in odd.rows()])}
    assert {r.doc_id for r in rows} == wanted
    assert exact_dedup.drop_exact_copies(odd.docs(spark, True)).count() == 0


def test_plan_has_no_python(spark):
    plan = exact_dedup.exact_groups(odd.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text, width=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (text or "").translate(lower).encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        component = min((x for x in ids if x is not None), default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def near(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect()), key=str)


def test_near_groups_on_odd_rows(spark):
    assert near(minhash.near_groups(odd.docs(spark))) == near_brute([(r[0], r[1]) for r in odd.rows()])
    assert minhash.near_groups(odd.docs(spark, True)).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_near_groups_of_edited_texts(spark, block):
    # two clouds of edits around the threshold, texts that share a long passage, and loners
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    rows = []
    for cloud in range(2):
        base = [word() for _ in range(120)]
        for k in range(40):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = word()
            rows.append((100 * cloud + k, " ".join(own)))
    passage = [word() for _ in range(60)]
    rows += [(300 + k, " ".join(passage + [word() for _ in range(40)])) for k in range(30)]
    rows += [(400 + k, " ".join(word() for _ in range(r.randrange(1, 30)))) for k in range(30)]
    r.shuffle(rows)
    assert near(minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block)) == near_brute(rows)


def test_near_drop(spark):
    docs = odd.docs(spark)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    wanted = sorted((str(x[0]) for x in near_brute([(r[0], r[1]) for r in odd.rows()]) if x[3]), key=str)
    assert sorted(str(r.doc_id) for r in kept.collect()) == wanted
    assert minhash.drop_near_copies(odd.docs(spark, True)).count() == 0


def test_pruning_bound():
    need = minhash.needed_matches((32, 160), 0.85, 1e-6)
    assert 10 < need[0] < 27 and 90 < need[1] < 136
    assert minhash.needed_matches((32,), 0.85, 0.5)[0] > need[0]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (5, 5)], "x long, y long")
    got = {r.node: r.comp for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90}
