"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.stored import checkpoint, shared_dir

__all__ = ["Shared", "checkpoint", "give_back", "join_counted", "shared_dir", "slices", "stored", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table; smaller than a checkpoint, and columns can be left unread."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def join_counted(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, hot_groups: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to one row for each key, when a key may hold a third of all rows.

    ``groups`` has the number of rows of each key in ``size``.  Fewer than ``hot_groups`` keys can
    have more than ``n_rows / hot_groups`` rows, so those are broadcast (that bound holds for any
    data); the rows of all other keys meet in a shuffle join, where no key is large.
    """
    limit = max(256, -(-n_rows // hot_groups))
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    is_hot = hot.select(key, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(is_hot), key, "left")
    return (
        marked.where("_hot is null").drop("_hot").join(cold, key)
        .unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(hot), key))
    )


def without(rows: DataFrame, gone: DataFrame, key: str, size: str, hot_groups: int = 1000) -> DataFrame:
    """``rows`` whose key is not in ``gone``, when a key may hold a third of all rows.

    ``gone`` has one row for each key and in ``size`` its number of rows.  Fewer than ``hot_groups`` keys can
    have more than that part of all those rows; they are broadcast, and the rest meet in a shuffle join.
    """
    total = gone.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(256, -(-total // hot_groups))
    return rows.join(F.broadcast(gone.where(hot).select(key)), key, "left_anti").join(gone.where(~hot).select(key), key, "left_anti")


def give_back() -> None:
    """Freed memory goes back to the system: workers are used again by other stages, which shouldn't find it held."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``max_bytes``, one row at least; freed memory goes back at the end."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    give_back()


class Shared:
    """A broadcast value, and what Python workers build from it: once for each worker, not for each task."""

    built: dict[str, dict[str, Any]] = {}

    def __init__(self, spark: SparkSession, value: Any):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def get(self, build: Callable[[Any], Any], name: str = "", keep: int = 2) -> Any:
        """``build(value)``; of each name the worker keeps the last ``keep``."""
        held = Shared.built.setdefault(name, {})
        if self.key not in held:
            while len(held) >= keep:
                del held[next(iter(held))]
            held[self.key] = build(self.sent.value)
        return held[self.key]
