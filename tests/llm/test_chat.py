"""Transcript parsing: blocked decoding equals whole decoding, roles come back."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat


def conversations(n=60):
    r = random.Random(7)
    words = "sun moon river stone bread lamp wood".split()
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = []
    for c in range(n):
        turn = 0
        if c % 4 == 0:
            rows.append((c, turn, "system", say(8)))
            turn += 1
        for _ in range(r.randrange(1, 5)):
            rows.append((c, turn, "user", say(6) + "?"))
            rows.append((c, turn + 1, "assistant", "\n".join(say(30) for _ in range(r.randrange(1, 4)))))
            turn += 2
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, _conv int")


def test_roles_and_texts_come_back(spark):
    rows = conversations()
    got = {(r.conv_id, r.turn): r for r in chat.canonical_turns(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    right = [got[c, t].recovered == role and got[c, t].opens for c, t, role, _ in rows]
    assert sum(right) / len(right) > 0.97
    held = [got[c, t].recovered == role for c, t, role, _ in rows if got[c, t].held_out]
    assert held and sum(held) / len(held) > 0.9


def test_blocks_do_not_change_the_result(spark):
    df = frame(spark, conversations(20)).selectExpr("conv_id as _conv", "turn as _turn", "role as _role", "text as _text")
    pasted = chat.as_transcript(df)
    model = chat.learn(pasted)
    wanted = sorted(map(str, chat.parse(pasted, model, 1000).collect()))
    for block in (1, 3):
        assert sorted(map(str, chat.parse(pasted, model, block).collect())) == wanted


def test_chain_is_viterbi():
    r = np.random.default_rng(1)
    log = lambda *shape: np.log(r.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = {"start": log(1, chat.N_STATES), "move": log(chat.N_STATES, chat.N_STATES), "emit": log(chat.N_STATES, chat.N_SYMBOLS)}
    for _ in range(40):
        blocks = [r.integers(0, chat.N_SYMBOLS, r.integers(0, 6)).tolist() for _ in range(5)]
        whole = chat.decode([s for b in blocks for s in b], model, None, None)
        matrices, begun = [], False
        for b in blocks:
            matrices.append((chat.transfer(b if begun else b[1:], model) if b else None, b[0] if b else -1))
            begun = begun or bool(b)
        out = []
        for b, (before, end) in zip(blocks, chat.chain(matrices, model)):
            out += chat.decode(b, model, before, end if b else None)
        score = lambda path, seq: model["start"][0][path[0]] + sum(model["emit"][s, o] for s, o in zip(path, seq)) + sum(model["move"][a, b] for a, b in zip(path, path[1:]))
        flat = [s for b in blocks for s in b]
        assert len(out) == len(flat) and (not flat or abs(score(out, flat) - score(whole, flat)) < 1e-9)


def test_decoding_beats_all_paths():
    r = np.random.default_rng(2)
    log = lambda *shape: np.log(r.dirichlet(np.ones(shape[-1]), shape[:-1]))
    for size in (1, 2, 3, 5):
        model = {"start": log(1, chat.N_STATES), "move": log(chat.N_STATES, chat.N_STATES), "emit": log(chat.N_STATES, chat.N_SYMBOLS)}
        seq = r.integers(0, chat.N_SYMBOLS, size).tolist()
        score = lambda path: model["start"][0][path[0]] + sum(model["emit"][s, o] for s, o in zip(path, seq)) + sum(model["move"][a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(chat.N_STATES), repeat=size), key=score)
        assert abs(score(chat.decode(seq, model, None, None)) - score(best)) < 1e-9


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_any_number_of_conversations_in_a_task(spark, n):
    df = spark.range(n).coalesce(1).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'User: hello?' as text")
    got = chat.canonical_turns(df)
    assert got.count() == n and got.where("recovered = 'user'").count() == n


@pytest.mark.parametrize("kind", ["string", "int", "timestamp"])
def test_ids_of_any_type(spark, kind):
    df = frame(spark, conversations(12)).withColumn("conv_id", F.col("conv_id").cast(kind))
    found = chat.canonical_turns(df)
    assert found.schema["conv_id"].dataType == df.schema["conv_id"].dataType
    assert {(r.conv_id, r.turn) for r in found.collect()} == {(r.conv_id, r.turn) for r in df.collect()}
    nothing = df.limit(3).withColumns({"conv_id": F.lit(None).cast(kind), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string")})
    assert [r.conv_id for r in chat.canonical_turns(nothing).collect()] == [None] * 3


def test_very_long_turn(spark):
    line = "some words of a turn that goes on and on"
    rows = [(1, 0, "user", "\n".join([line] * 20_000)), (1, 1, "assistant", line * 20_000)]
    got = {r.turn: r for r in chat.canonical_turns(frame(spark, rows)).collect()}
    assert (got[0].n_lines, got[1].n_lines, len(got)) == (20_000, 1, 2)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "hi"), (2, None, "assistant", "a\n\nb"), (3, 0, "user", ""), (3, 0, "user", ""), (4, 5, "other", "Q: one\nA: two")]
    got = chat.canonical_turns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert chat.canonical_turns(frame(spark, rows).limit(0)).count() == 0


def test_markers():
    assert [chat.marker_of(x)[0] for x in ("User: a", "### Human:", "**AI**: x", "A: b", "[system] >", "A house: b", "plain")] == [1, 1, 2, 2, 0, 3, 3]


def test_render():
    rows = [(0, 0, "user", "User: hello"), (0, 1, "assistant", "Assistant: yes\nmore")]
    model = {"start": np.log(np.full((1, 6), 1 / 6)), "move": np.log(np.full((6, 6), 1 / 6)), "emit": np.full((6, chat.N_SYMBOLS), -5.0)}
    for k in range(3):
        model["emit"][2 * k, (k * 2) * 10 : (k * 2 + 2) * 10] = -0.1
        model["emit"][2 * k + 1, 60:80] = -0.1
    text = "\n".join(r[3] for r in rows)
    assert chat.render_text(text, model).startswith("<|user|>\nhello\n<|end|>\n<|assistant|>\nyes\n")
