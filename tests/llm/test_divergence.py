"""The source audit against its definition, on rows of every odd kind."""

import random
import re
from collections import Counter, defaultdict

import pytest

from barloom.llm.divergence import audit, term_counts
from tests.llm import odd


def brute(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    """Rows of (text, lang, source) audited term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        held[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]

        def p(counts: Counter, kept=kept) -> dict:
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        own = {s: p(c) for (g, s), c in groups.items() if g == lang}
        whole = p(sum((c for (g, _), c in groups.items() if g == lang), Counter()))
        for s, a in own.items():
            pairs = [(sum((a[t] - b[t]) ** 2 // b[t] for t in kept), o) for o, b in own.items() if o != s]
            terms = [((a[t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[lang, s][t] and a[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string, p long, term string").repartition(5)
    result = [tuple(r) for r in audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(result) == len(set(result))
    return set(result)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Été", "日本", "WA", "don't", "x1y", ""]
    rows = []
    for k in range(150):
        source = rng.choice(["hot"] * 5 + ["a", "b", "c", None, ""])
        text = rng.choice([None, "", "12 3 !"]) if rng.random() < 0.1 else " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "de", None]), source, k, "t"))
    rows += [("alone", "fr", "a", 0, ""), (None, "fr", "b", 0, ""), ("", "fr", "c", 0, "")]  # a language that keeps no term
    assert found(spark, rows) == brute([r[:3] for r in rows])
    assert found(spark, rows, least=1, top=3) == brute([r[:3] for r in rows], 1, 3)


def test_odd_documents(spark):
    rows = [(r[1], r[2], r[3]) for r in odd.rows()]
    assert {tuple(r) for r in audit(odd.docs(spark), least=2).select("lang", "source", "part", "item", "value", "rank").collect()} == brute(rows, 2)
    assert audit(odd.docs(spark, empty=True)).count() == 0


def test_counting_takes_a_few_megabytes_at_once(spark):
    docs = spark.range(0, 12, 1, 1).selectExpr("'en' AS lang", "'a' AS source", "repeat('ab ', 350000) AS text")
    found = term_counts(docs).where("term = 'ab'").collect()
    assert len(found) >= 3 and sum(r.n for r in found) == 12 * 350_000 and sum(r.docs for r in found) == 12
