"""Operators on single documents against brute force, libraries and held-out labels."""

import base64
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, quality, tokencount, toxicity
from barloom.llm.queries import vocabulary
from tests.llm import odd

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated_brute(text, items):
    words = re.findall(WORD, (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(WORD, (t or "").translate(LOWER))
        for at in range(max(len(own) - 12, min(1, len(own)))):
            window = own[at : at + 13]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("shard", [8 << 20, 40])
def test_contamination(spark, shard):
    passage = " ".join(f"q{i}" for i in range(20))
    items = [(1, passage), (2, "Short item!"), (3, None), (4, "..."), (5, passage), (None, "brown fox jumps")]
    rows = [(1, f"x y {passage} z"), (2, "a short ITEM here"), (3, None), (4, ""), (5, " ".join(passage.split()[:12])), (6, odd.A), (7, odd.LONG + " " + passage), (8, "shorts item")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _text string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, _t int")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, max_bytes=shard).collect()}
    assert got == {i: contaminated_brute(t, items) for i, t in rows}
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, max_bytes=shard).collect()}
    assert kept == {i for i, t in rows if not contaminated_brute(t, items)[4]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_blocks_find_what_windows_find():
    r = random.Random(11)
    for _ in range(400):
        width, letters = r.choice((1, 2, 3, 4, 5, 8, 13)), "abc"[: r.choice((1, 2, 3))]
        items = [(f"i{k}", " ".join(r.choice(letters) for _ in range(r.randrange(0, 3 * width)))) for k in range(r.randrange(1, 5))]
        text = " ".join(r.choice(letters + "z") for _ in range(r.randrange(0, 60)))
        words, hit, found = text.split(), set(), set()
        for item, t in items:
            own = t.split()
            for at in range(max(len(own) - width + 1, min(1, len(own)))):
                window = own[at : at + width]
                for k in range(len(words) - len(window) + 1):
                    if words[k : k + len(window)] == window:
                        hit |= set(range(k, k + len(window)))
                        found.add(item)
        assert decontaminate.Automaton(items, width).scan(text) == (len(words), sorted(hit), found)


def test_items_that_share_words(monkeypatch):
    """Looking windows up around a common block finds what comparing items one by one finds, in time that the items don't multiply."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(20)]
    items = [(f"i{k}", " ".join(common[: rng.randrange(8, 20)] + rng.choices("abc", k=rng.randrange(3, 12)))) for k in range(120)]
    texts = [" ".join(rng.choices("abc", k=3) + common[rng.randrange(4) : rng.randrange(10, 20)] + rng.choices("abc", k=9)) for _ in range(80)] + [t for _, t in items[:20]]
    found = {}
    for least in (0, 16, 10**9):
        monkeypatch.setattr(decontaminate, "COMMON", least)
        finder = decontaminate.Automaton(items, 13)
        found[least] = [finder.scan(t) for t in texts]
    assert found[0] == found[16] == found[10**9] and sum(len(f[1]) > 0 for f in found[0]) > 20
    monkeypatch.setattr(decontaminate, "COMMON", 16)
    took = {}
    for n in (1000, 4000):
        finder = decontaminate.Automaton([(f"i{k}", " ".join(common[:9] + [f"w{k}", f"v{k}", f"u{k}", f"t{k}", f"s{k}"])) for k in range(n)], 13)
        began = time.perf_counter()
        finder.scan(" and ".join([" ".join(common[:9])] * 2000))
        took[n] = time.perf_counter() - began
    assert took[4000] < 3 * took[1000] + 0.05


@pytest.mark.parametrize("empty", [False, True])
def test_contamination_of_odd_documents(spark, empty):
    benchmark = spark.createDataFrame([("q", odd.A), (None, "one two"), ("n", None)], "item_id string, text string")
    rows = decontaminate.contamination(odd.docs(spark, empty), benchmark).collect()
    assert len(rows) == (0 if empty else len(odd.rows()))
    assert {r.doc_id for r in rows if r.contaminated} == (set() if empty else {1, 5, 6, 8, 9, 11, None})


def test_repeated_documents_give_a_row_each_with_many_shards(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    items = [(1, passage), (2, "short item"), (3, "brown fox")]
    rows = [(1, passage + " z"), (1, passage + " z"), (1, "a short item"), (None, "brown fox"), (None, "brown fox"), (2, None), (2, None), (2, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.find_hits(docs, bench, max_bytes=m).collect())) for m in (8 << 20, 20))
    assert one == many and len(one) == len(rows)


def test_hit_offsets_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünd: Brown  FOX jumps!")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "brown fox")], "item_id long, text string")
    hits = decontaminate.find_hits(docs, bench).first().hits
    assert ["Ünd: Brown  FOX jumps!"[h.start : h.end] for h in hits] == ["Brown", "FOX"]


def test_odd_rows_decontaminate(spark):
    assert decontaminate.drop_contaminated(odd.docs(spark), spark.createDataFrame([(1, "one two")], "item_id long, text string")).columns == odd.docs(spark).columns


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=80) | st.text(alphabet="aAbé'sS tllΣσẞİ12 \n<|startoftext|>end", max_size=60))
def test_word_bpe_equals_library(library, text):
    own = bpe.word_bpe(vocabulary("word_bpe_49k.json"))
    wanted = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == wanted
    assert own.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


def test_long_words_equal_library(library):
    own, r = bpe.word_bpe(vocabulary("word_bpe_49k.json")), random.Random(6)
    for size in (47, 48, 49, 200, 3000):
        word = "".join(r.choice("abenstir") for _ in range(size))
        assert own.encode(word) == own.encode(f"x {word}")[1:] == library.encode(word, add_special_tokens=False).ids
    assert len(own.encode("qwxz" * 250_000)) == 750_000  # seconds, not hours


def test_scan_equals_heap():
    own, r = bpe.byte_bpe(vocabulary("byte_bpe_50k.tiktoken")), random.Random(7)
    words = ["".join(r.choice("aaabenstir é") for _ in range(r.randrange(1, 49))).encode() for _ in range(2000)] + [b"", b"aaaaaaaaaa"]
    assert own.encode_pieces(words) == [own.encode_piece(w) if w else [] for w in words]


def test_encode_documents(spark, library):
    got = bpe.encode_documents(odd.docs(spark), vocabulary("word_bpe_49k.json")).collect()
    wanted = []
    for doc, text, *_ in odd.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got), key=str) == sorted(wanted, key=str)
    assert bpe.encode_documents(odd.docs(spark, True), vocabulary("word_bpe_49k.json")).count() == 0


def test_byte_bpe_round_trip():
    own = bpe.byte_bpe(vocabulary("byte_bpe_50k.tiktoken"))
    data = "héllo wörld 日本 \x00".encode()
    assert b"".join(own.tokens[i] for i in own.encode_piece(data)) == data


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_count_tree_equals_whole_count():
    counts, whole, r = tokencount.PieceCounts(vocabulary("byte_bpe_50k.tiktoken")), tiktoken_encoding(), random.Random(5)
    letters = "abé 's'tll12  \n\n.,'x  日本"
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randrange(300)))
        tree = tokencount.CountTree(text, counts, leaf=r.choice((1, 4, 16, 64)))
        for _ in range(r.randrange(6)):
            a = r.randrange(len(text) + 1)
            b, new = min(len(text), a + r.randrange(30)), "".join(r.choice(letters) for _ in range(r.randrange(20)))
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == len(whole.encode_ordinary(text))


def test_count_edited(spark):
    edits = [[(0, 3, "New"), (10**6, 10**6, " end"), (5, 2, None)], None]
    docs = spark.createDataFrame([(1, odd.A, edits[0]), (2, None, edits[1]), (3, "x", [])], "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    path, whole = vocabulary("byte_bpe_50k.tiktoken"), tiktoken_encoding()
    got = {r.doc_id: r for r in tokencount.count_edited(docs, path, edits_col="edits").collect()}
    text = "New" + odd.A[3:] + " end"
    text = text[:2] + text[5:]
    assert got[1].n_tokens_edited == len(whole.encode_ordinary(text)) and got[1].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (got[2].n_tokens, got[2].n_edits, got[3].n_tokens_edited) == (0, 0, 1)
    for r in tokencount.count_edited(odd.docs(spark), path).where("doc_id = 7").collect():
        assert r.n_pieces > 60_000 and r.n_pieces_encoded < 2_000
    assert tokencount.count_edited(odd.docs(spark, True), path).count() == 0


def kneser_ney(texts):
    """The model by its definition, over dictionaries of strings."""
    mark = chr(0x10FFFF)
    levels = [{} for _ in range(4)]
    for t in texts:
        s = mark * 3 + t
        for i in range(3, len(s)):
            gram = s[i - 3 : i + 1]
            levels[3][gram] = levels[3].get(gram, 0) + 1
    for order in (2, 1, 0):
        for gram in levels[order + 1]:
            levels[order][gram[1:]] = levels[order].get(gram[1:], 0) + 1
    discounts = []
    for counts in levels:
        n = [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            discounts.append((0.5, 0.75, 0.9))
            continue
        y = n[0] / (n[0] + 2 * n[1])
        raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5)
        discounts.append(tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)))

    def p(gram):
        if not gram:
            return 1 / 0x110000
        counts, d = levels[len(gram) - 1], discounts[len(gram) - 1]
        same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        cut = lambda c: d[min(c, 3) - 1]
        own = counts.get(gram, 0)
        return ((own - cut(own)) / total if own else 0) + sum(cut(c) for c in same.values()) / total * p(gram[1:])

    return lambda t: sum(-math.log(p((mark * 3 + t)[i : i + 4])) for i in range(len(t))) / len(t)


@pytest.mark.parametrize("letters", ["ab cdE.", "абв гдЖ.", "日本語文 字。"])
def test_perplexity_equals_its_definition(spark, letters):
    r = random.Random(2)
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(30)] + ["héllo 日 1"]
    trained = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    asked = [texts[0], "", "zzz?", letters * 30, "\0\0x", "щ", None, texts[0]]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    wanted = kneser_ney(texts)
    for block in (1, 100, 16 << 20):
        got = {x.doc_id: x for x in quality.scored(docs, quality.train(trained), block).collect()}
        assert {i: x._n for i, x in got.items()} == {i: len(t or "") for i, t in enumerate(asked)}
        assert all(math.isclose(got[i]._nll, wanted(t.replace("\0", chr(0xFFFD))), rel_tol=1e-9) if t else got[i]._nll is None for i, t in enumerate(asked))


def fences_brute(rows, tail=0.001, least=25):
    """What ``quality.fences`` gives for (lang, n, nll), from sorted lists."""
    at = lambda values, q: sorted(values)[max(math.ceil(q * len(values) - 1e-9), 1) - 1]
    rows = [(lang, n, x) for lang, n, x in rows if x is not None]
    mid = {g: at([round(x / 0.001) for lang, _, x in rows if lang == g], 0.5) * 0.001 for g in {r[0] for r in rows}}
    every = at([round(x / 0.001) for *_, x in rows], 0.5) * 0.001
    off = lambda n, x, m: math.floor((x - m) / math.sqrt(1 / max(n, 1) + 1 / 4096) / 0.01)
    limits = lambda z: (at(z, tail) * 0.01, (at(z, 1 - tail) + 1) * 0.01)
    pooled = limits([off(n, x, mid[lang]) for lang, n, x in rows])
    own = {}
    for g in mid:
        z = [off(n, x, mid[g]) for lang, n, x in rows if lang == g]
        own[g] = (mid[g], *(limits(z) if len(z) >= least else pooled))
    return own, (every, *limits([off(n, x, every) for _, n, x in rows]))


@pytest.mark.parametrize("tail", [0.0, 0.001, 0.05, 0.2])
def test_fences_are_quantiles(spark, tail):
    r = random.Random(8)
    size = lambda: r.choice([1, 7, 90, 700, 5000, 2_000_000])
    rows = [("ru", size(), r.gauss(2, 0.1)) for _ in range(101)] + [("ja", size(), r.gauss(4, 0.3)) for _ in range(57)]
    rows += [("", size(), r.gauss(3, 0.2)) for _ in range(9)] + [("xx", 12, 2.5), ("ru", 0, None), ("nn", 0, None)] + [("yy", 30, 3.25)] * 40
    own, rest = quality.fences(spark.createDataFrame(rows, "lang string, _n long, _nll double"), tail, 25)
    wanted, every = fences_brute(rows, tail)
    got = {x.lang: (x.mid, x.low, x.high) for x in own.collect()}
    assert set(got) == set(wanted) == {"ru", "ja", "", "xx", "yy"}
    assert all(got[g] == pytest.approx(wanted[g], abs=1e-9) for g in got) and rest == pytest.approx(every, abs=1e-9)
    assert quality.fences(spark.createDataFrame([("nn", 0, None)], "lang string, _n long, _nll double"), tail, 25)[1] is None


def test_very_long_text_is_scored_whole(spark):
    text = "a b" * 700_000 + "#" * 700_000
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.scored(docs, quality.train(docs.where("doc_id = 2"))).collect()}
    assert got[1]._n == len(text) and got[1]._nll > got[2]._nll + 2


def test_quality_keeps_clean_and_drops_noise(spark):
    r = random.Random(3)
    syllables = "ta re mi so lun der king ing".split()
    good = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(60))
    rows = [(i, good(), "en" if i % 2 else "de") for i in range(300)] + [(1000 + i, "".join(r.choice("#$%&*@XQZ") for _ in range(300)), "en") for i in range(20)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, good(), None), (None, good(), "en"), (5, rows[5][1], "xx")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, low double")
    ids = spark.createDataFrame([(i,) for i in range(200)] + [(1,)], "_trusted long")
    got = quality.classify(docs, ids, least=20).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.kept} == set(range(1000, 1020))
    kept = quality.drop_poor(docs, ids, least=20)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 20
    assert quality.drop_poor(docs, ids.limit(0)).count() == len(rows)
    assert quality.classify(docs.limit(0), ids).count() == 0
    assert quality.drop_poor(odd.docs(spark), ids).columns == odd.docs(spark).columns
    strange = quality.classify(odd.docs(spark), ids).collect()
    assert len(strange) == len(odd.rows()) and all(r.kept for r in strange if not r.n_chars)


def test_quality_judges_all_lengths_and_unknown_languages(spark):
    r = random.Random(4)
    syllables = "ta re mi so lun der king ing".split()
    good = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))
    noise = lambda n: "".join(r.choice("#$%&*@XQZ") for _ in range(n))
    rows = [(i, good(60), "en" if i % 2 else "de") for i in range(200)] + [(200 + k, good(n), "en") for k, n in enumerate((3, 1, 600, 3000))]
    wanted = {300: (good(2), True), 301: (noise(20), False), 302: (good(1500), True), 303: (noise(9000), False), 304: ("ta " * 9000, False), 305: (good(60), True), 306: (noise(300), False), 307: (noise(9000), False)}
    docs = spark.createDataFrame(rows + [(i, t, "en" if i < 305 else "xx") for i, (t, _) in wanted.items()] + [(400, "", "en"), (401, None, "xx")], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in range(204)], "_trusted long")
    got = {x.doc_id: x for x in quality.classify(docs, ids).collect()}
    assert all(got[i].low is not None and got[i].high is not None for i in got)
    assert {i: got[i].kept for i in wanted} == {i: k for i, (_, k) in wanted.items()}
    assert all(got[i].kept for i in [*range(204), 400, 401])


def test_folding_of_all_planes():
    bold = lambda t: "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else chr(0x1D7CE + int(c)) if c.isdigit() else c for c in t)
    assert toxicity.fold(bold("bad") + " bad") == " bad bad " and toxicity.fold(bold("b4d")) == " bad "
    assert toxicity.fold("x\U00020000y \U0001F600 z") == " x\U00020000y z "


def test_folding():
    assert toxicity.fold("You 1d10t, mоrоn! SCUM!! ｌｏｓｅｒ l0ser") == " you idiot moron scum loser loser "
    assert toxicity.fold(None) == " " and toxicity.fold("...") == "  "


def test_lexicon_weights_prefixes_and_exceptions():
    found = toxicity.Lexicon({" scum ": 3.0, " idio": 2.0, " idiot ": 4.0}, ["scum line"])
    assert [w for _, w in found.matches(toxicity.fold("idiot idiotic scum scumline, scum line"))] == [4.0, 2.0, 3.0]
    assert toxicity.Lexicon({}).matches(" a ") == []


def test_toxicity_learns_from_the_rest_only(spark):
    r = random.Random(4)
    plain = "the a of and in house tree water stone light".split()
    text = lambda bad: " ".join(r.choice(plain) for _ in range(40)) + (" you vile " + r.choice(("grub", "GRUB!", "gr0b".replace("0", "u"))) if bad else "")
    rows = [(i, text(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (None, "vile grub"), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert 40 < len(held) < 130 and all(got[i].predicted == int(i % 3 == 0) for i in held)
    assert got[1000].score == got[1001].score < 0.5 and not got[None].held_out
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.toxicity(docs, other).collect()} == {k: v.score for k, v in got.items()}
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def toxicity_brute(text, model):
    """A model's score by its definition: each place's heaviest entry, none inside an exception phrase."""
    folded, best = toxicity.fold(text), {}
    places = lambda part: [i for i in range(len(folded)) if folded.startswith(part, i)]
    for entry, weight in model["weights"].items():
        for i in places(entry):
            best[i] = max(best.get(i, 0), weight)
    spared = {k for phrase in model["exceptions"] for i in places(f" {phrase} ") for k in range(i, i + len(phrase) + 1)}
    total = sum(w for i, w in best.items() if i not in spared)
    a, b, c = model["curve"]
    z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, len(folded.split())))
    return round(1 / (1 + math.exp(-z)), 9)


def test_toxicity_scores_equal_their_definition(spark):
    model = {"weights": {" scum ": 3.5, " idio": 3.25, " idiot ": 4.0, " grub ": 3.75}, "exceptions": ["scum line", "white grub"], "curve": [-3.0, 1.5, 0.5]}
    texts = ["You 1d10t!", "scum line, scum", "a white grub and a grub", "nothing here", "", None, "idiotic SCUM " * 3, "word " * 400_000 + "sсum", "grub", "grub"]
    docs = spark.createDataFrame([(i // 2 if i > 7 else i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, model).collect())
    assert got == sorted((i // 2 if i > 7 else i, toxicity_brute(t if t is None or len(t) < 9999 else "word " * 400_000 + "scum", model) if t is None or len(t) < 9999 else round(1 / (1 + math.exp(3.0 - 1.5 * math.log1p(3.5) - 0.5 * math.log1p(350 / 400_001))), 9)) for i, t in enumerate(texts))
