"""Greedy choice of intervals that don't overlap: the one sequential primitive of swings, trades and moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the chunks of start values that a group is cut into.
CHUNK = 1 << 16


def exits(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each candidate of a chunk (sorted by start) what ends the chain that begins with it: the ``stop`` of its last link in the chunk.

    Each candidate's successor is the first that starts at or after its stop; chains are followed by pointer doubling.
    """
    n = len(start)
    last = np.arange(n)
    jump = np.maximum(np.searchsorted(start, stop), last + 1)
    while True:
        on = np.flatnonzero(jump < n)
        if not len(on):
            return stop[last]
        last[on], jump[on] = last[jump[on]], jump[jump[on]]


def _steps(start: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map from entry to exit as its steps: entering at or before ``upto[k]`` (and after the one before) leaves at ``leave[k]``."""
    end = np.flatnonzero(np.concatenate([leave[1:] != leave[:-1], [True]]))
    return start[end], leave[end]


def hop_select(candidates: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, chunk: int = CHUNK) -> DataFrame:
    """From each group, in order of start (then end): the first candidate, then each that starts at ``end + gap`` of the last chosen or later.

    ``start`` and ``end`` are whole numbers.  A group is cut into chunks of ``chunk`` start values.  Each chunk is
    first summed up as a map from the place where the chain enters it to where it leaves; chains soon meet, so the map has few
    steps.  The maps are applied one after another, a binary search for each chunk, and with its entry known each chunk is
    chosen from on its own.  So a group of any size is many tasks, and none holds more than a chunk.
    """
    columns = candidates.columns
    names = [*keys, "_chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    fields = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    cut = candidates.withColumn("_chunk", F.floor(F.col(start) / chunk))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Each batch and where groups begin in it; the caller knows whether the first goes on."""
        for batch in batches:
            if batch.num_rows:
                own = list(zip(*(batch.column(k).to_pylist() for k in range(len(names)))))
                yield batch, own

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            begin, stop = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            upto, leave = _steps(begin, exits(begin, stop))
            columns_ = [*([g] for g in group), [upto.tolist()], [leave.tolist()]]
            types = [*key_types, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, types)], [*names, "upto", "leave"])

        key_types: list[pa.DataType] = []
        for batch, own in groups(batches):
            key_types = [batch.schema.field(k).type for k in range(len(keys))]
            begin, stop = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy() + gap
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for a, b in zip(edges, edges[1:]):
                if own[a] != group:
                    if held:
                        yield row()
                    group, held = own[a], []
                held.append((begin[a:b], stop[a:b]))
        if held:
            yield row()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free = None, None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))))) if keys else [()] * batch.num_rows
            found = []
            for g, upto, leave in zip(own, batch.column(len(keys) + 1), batch.column(len(keys) + 2)):
                if g != group:
                    group, free = g, None
                found.append(free)
                upto, leave = upto.values.to_numpy(), leave.values.to_numpy()
                k = 0 if free is None else int(np.searchsorted(upto, free))
                free = int(leave[k]) if k < len(leave) else free
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(found, pa.int64())], [*names, "_free"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free = None, None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in range(len(names)))))
            keep = []
            for g, s, e, entry in zip(own, *(batch.column(len(names) + k).to_pylist() for k in range(3))):
                if g != group:
                    group, free = g, entry
                chosen = free is None or s >= free
                if chosen:
                    free = e + gap
                keep.append(chosen)
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1).field(k) for k in range(len(columns))], columns).filter(pa.array(keep, pa.bool_()))

    slim = cut.select(*names, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    mapped = slim.repartition(*names).sortWithinPartitions(*names, "_s", "_e").mapInArrow(maps, f"{fields}_chunk long, upto array<long>, leave array<long>")
    by_group = mapped.repartition(*keys) if keys else mapped.coalesce(1)
    entered = by_group.sortWithinPartitions(*names).mapInArrow(entries, f"{fields}_chunk long, _free long")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    entered = entered.toDF(*[f"_k{i}" for i in range(len(names))], "_free")
    known = cut.join(entered, same).select(*names, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), "_free", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    return known.repartition(*names).sortWithinPartitions(*names, "_s", "_e").mapInArrow(choose, candidates.schema)
