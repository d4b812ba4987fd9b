"""The corpus pipeline against a brute-force version of all its stages, and on awkward tables."""

import hashlib
import math
import random
import re

import corpus_pipeline
from barloom.llm.queries import vocabulary
from tests.llm import odd
from tests.llm.test_texts import contaminated_brute, fences_brute, kneser_ney

SPACE = re.compile(r"[\x20\x09-\x0D]")


def fixture():
    """(documents, labels, benchmark): two languages in two scripts, poor documents, exact and near copies, benchmark passages."""
    r = random.Random(12)
    sounds = {"en": "ta re mi so lun der king ing".split(), "ru": "да не при сту ком гор ла мир".split()}
    word = lambda lang: "".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 4)))
    text = lambda lang: " ".join(word(lang) for _ in range(60))
    docs = [(i, text("en" if i % 2 else "ru"), "en" if i % 2 else "ru") for i in range(140)]
    docs += [(200 + k, "".join(r.choice("#$%&*@XQZ") for _ in range(400)), "en") for k in range(5)] + [(210, "ла ла " * 70, "ru"), (211, "ing " * 100, "en")]
    docs += [(300 + k, docs[k][1] + " " * k, docs[k][2]) for k in range(1, 8)]  # exact copies but for white space
    for k in range(10, 16):  # near copies: one or two words differ
        words = docs[k][1].split()
        words[30] = word(docs[k][2])
        docs.append((320 + k, " ".join(words), docs[k][2]))
    passages = [text("en") for _ in range(3)]
    for k in range(3):
        words = docs[40 + k][1].split()
        docs.append((400 + k, " ".join([*words[:20], *passages[k].split()[:20], *words[40:]]), docs[40 + k][2]))
    docs += [(500, None, "en"), (501, "", "ru"), (502, "", None), (503, "short", "en"), (5, docs[5][1], docs[5][2])]
    return docs, [(i, 1, 0) for i in range(0, 140)] + [(200, 0, 0)], [(f"b{k}", p) for k, p in enumerate(passages)]


def kept_by_quality(docs, trusted):
    """The model by its definition, quantiles from sorted lists."""
    nll = kneser_ney([t for i, t, _ in docs if i in trusted and t])
    scores = [(i, len(t or ""), lang or "", nll(t) if t else None) for i, t, lang in docs]
    own, rest = fences_brute([(lang, n, x) for i, n, lang, x in scores if i in trusted])
    out = []
    for _, n, lang, x in scores:
        mid, low, high = own.get(lang, rest)
        out.append(x is None or 2 * low <= (x - mid) / math.sqrt(1 / n + 1 / 4096) <= 2 * high)
    return out


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in SPACE.split(words) if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}


def brute(docs, labels, benchmark):
    """The documents that stay."""
    kept = [d for d, k in zip(docs, kept_by_quality(docs, {i for i, good, _ in labels if good})) if k]
    groups = {}
    for d in kept:
        groups.setdefault(SPACE.sub("", d[1] or ""), []).append(d)
    kept = [min(g, key=lambda d: (-len(d[1] or ""), d[0])) for g in groups.values()]
    sets, parent = {d[0]: shingles(d[1]) for d in kept}, {d[0]: d[0] for d in kept}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [d for d in kept if find(d[0]) == d[0] and not contaminated_brute(d[1], benchmark)[4]]


def write(spark, folder, docs, labels, benchmark):
    spark.createDataFrame([(*d, "s", len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    docs, labels, benchmark = fixture()
    write(spark, tmp_path, docs, labels, benchmark)
    wanted = brute(docs, labels, benchmark)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {d[0] for d in wanted}
    assert not {1, 7, 200, 204, 210, 211, 330, 400, 402} & set(got) and {301, 307, 10, 40, 500} <= set(got)
    for i, text, _ in wanted:
        if i in got:
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_odd_and_empty_tables_go_through(spark, tmp_path):
    bench = [("b", "one two"), (None, None), ("c", "")]
    odd.docs(spark).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    docs = odd.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "a"))
        assert docs.columns == odd.docs(spark).columns
    kept = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()]
    assert set(kept) <= {r[0] for r in odd.rows()} and 1 in kept and not {8, 9} & set(kept)
    write(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
