"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered in one form.

Each line of a transcript gives one symbol: which speaker marker it opens with, whether a blank line
stands before it, its length class, and whether it ends as a question.  Hidden states are a role with
either the first line of a turn or a further one.  Start, transition and emission probabilities are
counted from labelled conversations.

Decoding is exact Viterbi in three steps, so that no task holds a whole conversation: each block of
turns is reduced to a matrix (the best score from the state before it to the state at its end), the
few matrices of a conversation are chained to fix the states at block borders, and each block is then
decoded between its two fixed states.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Shared, checkpoint

ROLES = ("system", "user", "assistant")
#: Two states for each role: first line of a turn, further line.
N_STATES = 2 * len(ROLES)
# Words that speaker markers are made of, by role.
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "prompter", "question", "q", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a"),
}
_ROLE_OF = {word: k for k, role in enumerate(ROLES) for word in MARKERS[role]}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*(?::(?:\*\*)?|>|$)[ \t]?", re.IGNORECASE)
N_SYMBOLS = (len(ROLES) + 1) * 2 * 5 * 2
NEVER = -1e9


def marker_of(line: str) -> tuple[int, int]:
    """(role number, length) of a line's speaker marker; (3, 0) without one."""
    found = _MARKER.match(line)
    return (_ROLE_OF[found.group(1).lower()], found.end()) if found else (len(ROLES), 0)


def symbols(text: str) -> tuple[list[str], list[int]]:
    """(lines without blank ones, their symbols)."""
    lines, out = [], []
    gap = 0
    for line in text.split("\n"):
        if not line.strip():
            gap = 1
            continue
        length = min(4, max(0, len(line).bit_length() - 5))
        out.append(((marker_of(line)[0] * 2 + gap) * 5 + length) * 2 + line.rstrip().endswith("?"))
        lines.append(line)
        gap = 0
    return lines, out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, from rows that are sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _typed(batches: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The same batches; their columns' types are noted in ``kinds``, for what is built from their values."""
    for batch in batches:
        kinds.update(zip(batch.schema.names, batch.schema.types))
        yield batch


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def learn(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities (start, move, emit) from labelled ``turns``: _conv, _turn, _role, _text.

    Counts are summed within tasks first; add-half smoothing.  A turn is followed by the one whose
    number is one more.  Rows with other roles are left out.
    """
    known = turns.where(F.col("_role").isin(*ROLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, inner = np.zeros((N_STATES, N_SYMBOLS), np.int64), np.zeros((N_STATES, N_STATES), np.int64)
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = 2 * ROLES.index(role)
                for k, symbol in enumerate(symbols(text)[1]):
                    emit[first + (k > 0), symbol] += 1
                    if k:
                        inner[first + (k > 1), first + 1] += 1
        rows = [("emit", i, j, emit[i, j]) for i, j in zip(*np.nonzero(emit))] + [("move", i, j, inner[i, j]) for i, j in zip(*np.nonzero(inner))]
        yield _batch(rows, ["kind", "i", "j", "n"], [pa.string(), pa.int32(), pa.int32(), pa.int64()])

    counted = known.select("_role", "_text").mapInArrow(run, "kind string, i int, j int, n long")
    many = F.size(F.filter(F.split("_text", "\n"), lambda line: F.trim(line) != "")) > 1
    index = F.array_position(F.lit(list(ROLES)), F.col("_role")).cast("int") - 1
    ends = known.select("_conv", "_turn", (2 * index).alias("first"), (2 * index + many.cast("int")).alias("last"))
    ends = ends.groupBy("_conv", "_turn").agg(F.min("first").alias("first"), F.min("last").alias("last"))  # repeated turns count once
    later = ends.select("_conv", (F.col("_turn") - 1).alias("_turn"), F.col("first").alias("j"))
    between = ends.join(later, ["_conv", "_turn"]).selectExpr("'move' as kind", "last as i", "j", "1L as n")
    starts = ends.where("_turn = 0").selectExpr("'start' as kind", "0 as i", "first as j", "1L as n")
    found = counted.unionByName(between).unionByName(starts).groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect()
    tables = {"start": np.full((1, N_STATES), 0.5), "move": np.full((N_STATES, N_STATES), 0.5), "emit": np.full((N_STATES, N_SYMBOLS), 0.5)}
    for row in found:
        tables[row["kind"]][row["i"], row["j"]] += row["n"]
    further = np.arange(N_STATES) % 2 == 1
    for i in range(N_STATES):  # a further line follows a line of its own role only
        tables["move"][i, further & (np.arange(N_STATES) // 2 != i // 2)] = 0
    tables["start"][0, further] = 0
    with np.errstate(divide="ignore"):
        return {k: np.maximum(np.log(t / t.sum(axis=1, keepdims=True)), NEVER) for k, t in tables.items()}


def transfer(observed: list[int], model: dict[str, np.ndarray]) -> np.ndarray:
    """Best score from each state before a block to each state at its end."""
    matrix = np.where(np.eye(N_STATES, dtype=bool), 0.0, NEVER)
    for symbol in observed:
        matrix = (matrix[:, :, None] + model["move"][None]).max(axis=1) + model["emit"][:, symbol][None, :]
    return matrix


def decode(observed: list[int], model: dict[str, np.ndarray], before: int | None, end: int | None) -> list[int]:
    """The best states of a block; ``before`` is the state before it (None at the start), ``end`` its last state (None if free)."""
    if not observed:
        return []
    score = (model["start"][0] if before is None else model["move"][before]) + model["emit"][:, observed[0]]
    back = []
    for symbol in observed[1:]:
        paths = score[:, None] + model["move"]
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + model["emit"][:, symbol]
    states = [int(score.argmax()) if end is None else end]
    for step in reversed(back):
        states.append(int(step[states[-1]]))
    return states[::-1]


def chain(matrices: list[tuple[np.ndarray | None, int]], model: dict[str, np.ndarray]) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of each block of a conversation, from (matrix, first symbol) in order.

    The first block's matrix starts at its second line; a block without lines has none.
    """
    score: np.ndarray | None = None
    back: list[np.ndarray | None] = []
    for matrix, symbol in matrices:
        if matrix is None:
            back.append(None)
        elif score is None:
            paths = (model["start"][0] + model["emit"][:, symbol])[:, None] + matrix
            back.append(None)
            score = paths.max(axis=0)
        else:
            paths = score[:, None] + matrix
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0)
    if score is None:
        return [(None, -1)] * len(matrices)
    out: list[tuple[int | None, int]] = []
    state = int(score.argmax())
    for (matrix, _), step in zip(reversed(matrices), reversed(back)):
        if matrix is None:
            out.append((state, -1))
            continue
        end = state
        before = None if step is None else int(step[end])
        out.append((before, end))
        state = end if before is None else before
    return out[::-1]


RENDER: Callable[[str, str], str] = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"


def parse(transcripts: DataFrame, model: dict[str, np.ndarray], turns_in_block: int = 64) -> DataFrame:
    """One row per row of ``transcripts``: _conv, _turn, _role, ``recovered``, ``opens``, ``n_lines``, ``rendered``.

    ``transcripts``: _conv, _turn, _role (passed through), _text; _turn (a whole number, from 0 on) orders
    the pieces of a conversation.  ``recovered`` is the role of the piece's first line, ``opens`` whether
    that line starts a turn, ``rendered`` its turns in canonical form, markers taken off.  A piece without
    lines belongs to nobody.  A null conversation is one of its own; null turns come first, as turn -1.
    Repeated turns of a conversation follow each other in the order of their texts.
    """
    shared = Shared(transcripts.sparkSession, model)
    turn = F.coalesce(F.col("_turn").cast("long"), F.lit(-1))
    blocked = transcripts.withColumns({"_place": turn, "_block": F.floor(turn / turns_in_block).cast("long"), "_text": F.coalesce("_text", F.lit(""))})
    conv_kind, turn_kind = (transcripts.schema[c].dataType.simpleString() for c in ("_conv", "_turn"))
    blocked = blocked.select("_conv", "_block", "_place", "_text", "_turn", "_role").repartition("_conv", "_block").sortWithinPartitions("_conv", "_block", "_place", "_text", "_role")

    def reduce_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities, kinds = shared.sent.value, {}
        rows: list[tuple] = []
        for group in _groups(_typed(batches, kinds), 2):
            observed = [s for row in group for s in symbols(row[3])[1]]
            after_first = transfer(observed[1:], probabilities).ravel().tolist() if observed else None
            whole = transfer(observed, probabilities).ravel().tolist() if observed else None
            rows.append((*group[0][:2], observed[0] if observed else -1, after_first, whole))
            if len(rows) >= 1000:
                yield out(rows, kinds)
                rows = []
        if rows:
            yield out(rows, kinds)

    def out(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        matrix = pa.list_(pa.float64())
        return _batch(rows, ["_conv", "_block", "symbol", "after", "whole"], [kinds["_conv"], pa.int64(), pa.int32(), matrix, matrix])

    reduced = blocked.mapInArrow(reduce_blocks, f"_conv {conv_kind}, _block long, symbol int, after array<double>, whole array<double>")
    reduced = reduced.repartition("_conv").sortWithinPartitions("_conv", "_block")

    def chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities, kinds = shared.sent.value, {}
        rows: list[tuple] = []
        for group in _groups(_typed(batches, kinds), 1):
            begun = False
            matrices: list[tuple[np.ndarray | None, int]] = []
            for _, _, symbol, after, whole in group:
                chosen = whole if begun else after
                matrices.append((np.array(chosen).reshape(N_STATES, N_STATES) if chosen else None, symbol))
                begun = begun or chosen is not None
            rows += [(g[0], g[1], *states) for g, states in zip(group, chain(matrices, probabilities))]
            if len(rows) >= 1000:
                yield borders(rows, kinds)
                rows = []
        if rows:
            yield borders(rows, kinds)

    def borders(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        return _batch(rows, ["_conv", "_block", "_before", "_end"], [kinds["_conv"], pa.int64(), pa.int32(), pa.int32()])

    ends = checkpoint(reduced.mapInArrow(chain_blocks, f"_conv {conv_kind}, _block long, _before int, _end int"))
    ends = ends.select(F.col("_conv").alias("_c"), F.col("_block").alias("_b"), "_before", "_end")
    joined = blocked.join(ends, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    joined = joined.select("_conv", "_block", "_place", "_text", "_turn", "_role", "_before", "_end").repartition("_conv", "_block").sortWithinPartitions("_conv", "_block", "_place", "_text", "_role")

    def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities, kinds = shared.sent.value, {}
        rows: list[tuple] = []
        for group in _groups(_typed(batches, kinds), 2):
            pieces = [symbols(row[3]) for row in group]
            end = group[0][7]
            states = decode([s for p in pieces for s in p[1]], probabilities, group[0][6], None if end is None or end < 0 else end)
            at = 0
            for row, (lines, _) in zip(group, pieces):
                own = states[at : at + len(lines)]
                at += len(lines)
                rendered: list[tuple[str, list[str]]] = []
                for line, state in zip(lines, own):
                    if state % 2 == 0 or not rendered:
                        rendered.append((ROLES[state // 2], []))
                    role, length = marker_of(line)
                    line = line[length:] if state % 2 == 0 and role == state // 2 else line
                    if line.strip() or state % 2:
                        rendered[-1][1].append(line)
                text = "".join(RENDER(role, "\n".join(part)) for role, part in rendered)
                rows.append((row[0], row[4], row[5], ROLES[own[0] // 2] if own else None, bool(own) and own[0] % 2 == 0, len(lines), text))
            if len(rows) >= 500:
                yield turns(rows, kinds)
                rows = []
        if rows:
            yield turns(rows, kinds)

    def turns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        names = ["_conv", "_turn", "_role", "recovered", "opens", "n_lines", "rendered"]
        return _batch(rows, names, [kinds["_conv"], kinds["_turn"], pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()])

    return joined.mapInArrow(decode_blocks, f"_conv {conv_kind}, _turn {turn_kind}, _role string, recovered string, opens boolean, n_lines long, rendered string")


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Conversations (_conv, _turn, _role, _text) as people paste them: each in one of four marker styles, one turn of six without a marker but after a blank line."""
    style = F.pmod(F.crc32(F.coalesce(F.col("_conv").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    bare = F.pmod(F.crc32(F.concat_ws(":", F.col("_conv").cast("string"), F.col("_turn").cast("string")).cast("binary")), F.lit(6)) == 0
    words = [("System: ", "User: ", "Assistant: "), ("### System:\n", "### Human:\n", "### Assistant:\n"), ("Context: ", "Q: ", "A: "), ("**System**: ", "**You**: ", "**AI**: ")]
    marker: Column = F.lit("")
    for k, row in enumerate(words):
        for role, word in zip(ROLES, row):
            marker = F.when((style == k) & (F.col("_role") == role), word).otherwise(marker)
    return conversations.withColumn("_text", F.concat(F.when(bare, "\n").otherwise(marker), F.coalesce("_text", F.lit(""))))


def canonical_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations written as transcripts, parsed again and rendered: one row per row.

    Columns: conversation, turn, role (the true one), ``recovered``, ``opens``, ``n_lines``,
    ``rendered_sha256`` and ``held_out`` (conversations that the model has not learned from: one of five
    by crc32 of the id).  Other columns are ignored; an empty table gives an empty result.
    """
    rows = conversations.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).cast("string").alias("_role"), F.col(text_col).cast("string").alias("_text"))
    pasted = as_transcript(rows)
    held_out = F.coalesce(F.crc32(F.col("_conv").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = parse(pasted, learn(pasted.where(~held_out)))
    return found.select(F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), F.col("_role").alias(role_col), "recovered", "opens", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"), held_out.alias("held_out"))


def render_text(text: str | None, model: dict[str, np.ndarray]) -> str:
    """One transcript in canonical form."""
    lines, observed = symbols(text or "")
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, decode(observed, model, None, None)):
        if state % 2 == 0 or not out:
            out.append((ROLES[state // 2], []))
        role, length = marker_of(line)
        line = line[length:] if state % 2 == 0 and role == state // 2 else line
        if line.strip() or state % 2:
            out[-1][1].append(line)
    return "".join(RENDER(role, "\n".join(part)) for role, part in out)
