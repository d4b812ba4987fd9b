"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Each text gives its set of five-word shingles, a 128-bit name for the set, and a signature of one
   byte per hash function.  Texts with the same set form a class and are handled once.
2. Classes meet in buckets: one bucket for each band of five signature bytes.
3. Within a bucket, signatures are compared batch by batch.  After each batch the posterior of the
   similarity (uniform prior, matches by chance allowed for) is asked whether it can still reach the
   threshold; a pair is pruned once that probability is below ``miss``.
4. Surviving pairs are verified exactly on the full sets, and verified links join components.

No bucket emits its pairs.  A first round compares each member with the least of its bucket only;
that joins most copies.  The second looks at all pairs of a bucket whose components still differ,
verifies survivors within the task and gives out only links that join components.  Members of large
buckets are dealt to a grid of blocks, so no task holds a whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from barloom.llm.common import checkpoint, join_counted, slices
from barloom.llm.exact_dedup import split_by

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: A match of two bytes by chance.
CHANCE = 1 / 256


class _WordHashes(dict):
    """Hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _WordHashes()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * _WORD_BASE + ids[i : i + n]
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return np.unique(h ^ (h >> np.uint64(33)))


def set_name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@lru_cache(4)
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_250_101).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, n: int) -> bytes:
    """For each of ``n`` hash functions, one byte of the least value over the set."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _multipliers(n)[None, :]).min(axis=0), out=least)
    return (((least ^ (least >> np.uint64(29))) * _MIX1) >> np.uint64(56)).astype(np.uint8).tobytes()


@lru_cache(8)
def needed_matches(batches: tuple[int, ...], threshold: float, miss: float) -> list[int]:
    """After so many compared bytes, the fewest matches at which the similarity can still reach the threshold.

    The posterior is integrated over the probability p of a match, s + (1 - s) / 256 at similarity s.
    """
    p = np.linspace(CHANCE, 1, 40_001)[1:-1]
    over = p >= threshold + (1 - threshold) * CHANCE
    found = []
    for n in batches:
        for m in range(n + 1):
            weight = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(weight - weight.max())
            if weight[over].sum() / weight.sum() >= miss:
                break
        found.append(m)
    return found


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(_id, n_shingles, cls, sig) for each document; no class and signature without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": batch.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "cls": pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([signature(s, bands * rows) if len(s) else None for s in sets], pa.binary()),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"_id {kind}, n_shingles long, cls binary, sig binary")


def bucket_members(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, cls, sig, n): the members of each bucket with two or more; key is the band and its bytes."""
    key = F.expr(f"transform(sequence(0, {bands - 1}), i -> concat(unhex(lpad(hex(i), 4, '0')), substring(sig, i * {rows} + 1, {rows})))")
    keys = classes.select("cls", F.explode(key).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(shared, "key").join(classes.select("cls", "sig"), "cls").select("key", "cls", "sig", "n")


def _groups(batches: Iterator[pa.RecordBatch], target: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups (equal key and cell) from rows sorted by group."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size < target:
            continue
        table = pa.concat_tables(held).combine_chunks()
        last = table.slice(table.num_rows - 1)
        k, c = last["key"][0].as_py(), last["cell"][0].as_py()
        keys, cells = table["key"].to_pylist(), table["cell"].to_pylist()
        at = table.num_rows - 1
        while at > 0 and keys[at - 1] == k and cells[at - 1] == c:
            at -= 1
        if at:
            yield table.slice(0, at)
        held = [table.slice(at)]
        size = held[0].nbytes
        target = max(target, 2 * size)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


class Comparer:
    """Sequential comparison of signatures."""

    def __init__(self, bands: int, rows: int, threshold: float, miss: float, batch: int = 32):
        self.bands, self.rows, self.n = bands, rows, bands * rows
        self.ends = tuple(sorted({*range(batch, self.n, batch), self.n}))
        self.need = needed_matches(self.ends, threshold, miss)

    def survivors(self, sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that no batch prunes, and their matches over the whole signature."""
        matches = np.zeros(len(a), np.int32)
        start = 0
        for end, need in zip(self.ends, self.need):
            matches += (sig[a, start:end] == sig[b, start:end]).sum(axis=1, dtype=np.int32)
            keep = matches >= need
            a, b, matches, start = a[keep], b[keep], matches[keep], end
            if not len(a):
                break
        return a, b, matches

    def first_shared(self, sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first band in which both are in one bucket."""
        return (sig[a] == sig[b]).reshape(-1, self.bands, self.rows).all(axis=2).argmax(axis=1)


PAIR = pa.schema([("x", pa.binary()), ("y", pa.binary())])


def _emit(table: pa.Table, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = table["cls"].to_pylist()
    pairs = sorted({(min(names[i], names[j]), max(names[i], names[j])) for i, j in zip(a.tolist(), b.tolist())})
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], schema=PAIR)


def star_candidates(members: DataFrame, comparer: Comparer, n_members: int) -> DataFrame:
    """(x, y): each bucket's least member with each other one that survives.

    The least member comes from an aggregate and meets the others by a join that sends the buckets of
    many members to all tasks, so no bucket is one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sigs, hubs, hub_sigs = (batch.column(k).to_pylist() for k in range(4))
            sig = np.frombuffer(b"".join(sigs) + b"".join(hub_sigs), np.uint8).reshape(-1, comparer.n)
            a = np.arange(len(names))
            a, _, _ = comparer.survivors(sig, a, a + len(names))
            found = sorted({(hubs[i], names[i]) for i in a.tolist()})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], schema=PAIR)

    hubs = members.groupBy("key").agg(F.min(F.struct("cls", "sig")).alias("_hub"), F.count(F.lit(1)).alias("_n"))
    hubs = hubs.select("key", "_n", F.col("_hub.cls").alias("x"), F.col("_hub.sig").alias("x_sig"))
    pairs = join_counted(members.select("key", "cls", "sig"), hubs, "key", "_n", n_members).where("cls != x")
    return pairs.select("cls", "sig", "x", "x_sig").mapInArrow(run, "x binary, y binary").distinct()


def class_sets(texts: DataFrame, width: int) -> DataFrame:
    """(cls, set): the sorted shingle hashes of each class; texts whose set has another name are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(c, shingle_hashes(t, width)) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = [(c, s.tobytes()) for c, s in found if set_name(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["cls", "set"])

    return texts.select("cls", "_t").mapInArrow(run, "cls binary, set binary").dropDuplicates(["cls"])


class _Union:
    """Components by union of numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def cross_links(members: DataFrame, comparer: Comparer, percent: int, block: int) -> DataFrame:
    """(x, y): links between different components, enough of them to join all that are linked.

    ``members``: key, cls, sig, set, n, comp (the component so far).  Every pair of one bucket with
    different components is compared by signature in the first bucket that it shares, and on its full
    sets if it survives, unless links found before it in the task join its components already.  Only
    links are given out, fewer than there are members.  A bucket with more than ``block`` members is
    dealt to a grid of block pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            comp = np.unique(np.array(table["comp"].to_pylist(), "S33"), return_inverse=True)[1]
            keys, cells = table["key"].to_pylist(), table["cell"].to_pylist()
            group = np.cumsum([0] + [keys[i] != keys[i - 1] or cells[i] != cells[i - 1] for i in range(1, len(keys))])
            mixed = np.bincount(group, comp != comp[np.searchsorted(group, group)]) > 0
            rows = np.flatnonzero(mixed[group])
            if not len(rows):
                continue
            table, comp, group = table.take(pa.array(rows)), comp[rows], group[rows]
            cell, part = np.array(table["cell"].to_pylist()), np.array(table["part"].to_pylist())
            band = np.array([int.from_bytes(k[:2], "big") for k in table["key"].to_pylist()])
            sig = _matrix(table["sig"], comparer.n)
            sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            joined = _Union(int(comp.max()) + 1)
            links: list[tuple[int, int]] = []
            pending: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0

            def compare() -> None:
                nonlocal waiting
                a, b = (np.concatenate(x) for x in zip(*pending))
                pending.clear()
                waiting = 0
                small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                fits = 100 * small >= percent * large
                a, b = a[fits], b[fits]
                for at in range(0, len(a), 1 << 17):
                    x, y, m = comparer.survivors(sig, a[at : at + (1 << 17)], b[at : at + (1 << 17)])
                    if not len(x):
                        continue
                    own = np.flatnonzero(comparer.first_shared(sig, x, y) == band[x])
                    for k in own[np.argsort(-m[own], kind="stable")].tolist():
                        i, j = int(x[k]), int(y[k])
                        u, v = joined.find(int(comp[i])), joined.find(int(comp[j]))
                        if u == v:
                            continue
                        s, t = sets[i], sets[j]
                        place = np.minimum(np.searchsorted(t, s), len(t) - 1)
                        both = int((t[place] == s).sum())
                        if 100 * both >= percent * (len(s) + len(t) - both):
                            joined.parent[max(u, v)] = min(u, v)
                            links.append((i, j))

            size = np.bincount(group)
            place = np.arange(len(group)) - np.searchsorted(group, group)
            active = np.arange(len(group))
            for d in range(1, int(size.max())):
                active = active[place[active] + d < size[group[active]]]
                other = active + d
                cross = (comp[active] != comp[other]) & ((cell[active] < 0) | (part[active] != part[other]))
                if cross.any():
                    pending.append((active[cross], other[cross]))
                    waiting += int(cross.sum())
                if waiting > 1 << 17:
                    compare()
            if pending:
                compare()
            if links:
                yield from _emit(table, *(np.array(x) for x in zip(*links)))

    blocks = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int")
    # a block is paired with each other one; pairs within a block are compared in a cell of their own, numbered -1 - block
    cells = F.expr("case when _blocks = 1 then array(-1) else concat(array(-1 - part), transform(filter(sequence(0, _blocks - 1), o -> o != part), o -> least(part, o) * _blocks + greatest(part, o))) end")
    dealt = members.withColumn("_blocks", blocks).withColumn("part", part).withColumn("cell", F.explode(cells))
    dealt = dealt.select("key", "cell", "part", "cls", "sig", "set", "comp").repartition("key", "cell").sortWithinPartitions("key", "cell", "cls")
    return dealt.mapInArrow(run, "x binary, y binary").distinct()


def member_texts(members: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, _t): a text of each class that shares a bucket.  A Bloom filter of ids keeps all other texts from being shuffled."""
    wanted = checkpoint(members.select("cls").distinct().join(classes.select("cls", "rep"), "cls"))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    source = split_by(source, "_id", wanted.select("rep"))[1]
    return wanted.join(source, F.col("rep").eqNullSafe(F.col("_id"))).select("cls", "_t")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(x, y, linked): the pairs compared exactly; linked where 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in slices(batches):
            out = []
            for x, y, s, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a = last[1] if last[0] == x else shingle_hashes(s, width)
                b = shingle_hashes(t, width)
                if (last[0] != x and set_name(a) != x) or set_name(b) != y:
                    continue  # another text with the same id
                last = (x, a)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append((x, y, 100 * both >= percent * (len(a) + len(b) - both)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.bool_())], ["x", "y", "linked"]
            )

    nodes = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    texts = split_by(texts, "cls", nodes)[1]
    one, two = texts.select(F.col("cls").alias("x"), F.col("_t").alias("s")), texts.select(F.col("cls").alias("y"), F.col("_t").alias("t"))
    both = pairs.join(one, "x").join(two, "y").select("x", "y", "s", "t")
    return both.mapInArrow(run, "x binary, y binary, linked boolean").distinct()


def components(links: DataFrame, low: str = "x", high: str = "y") -> DataFrame:
    """(node, comp): the least node reachable, for every node of ``links`` that is not itself the least.

    Alternating large-star and small-star steps, one shuffle each and one that drops repeated edges; a
    node's neighbours are only ever reduced to their minimum, never collected, and each round is
    written to the shared folder.
    """
    edges = links.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).where("u != v").distinct()
    edges, seen = checkpoint(edges), None
    least = F.min("v").over(Window.partitionBy("u"))
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.*").where("u != v").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = 32, rows: int = 5, miss: float = 1e-6, block: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    shingles (words between ASCII white space, A-Z lower-cased; a shorter text is one shingle).
    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the own one.  Null
    texts and texts without words have no shingles, link with nothing and are kept.  Repeated rows
    share a decision.  A null id counts only where no other id is in its component.  Other columns
    are ignored; an empty table gives an empty result.

    A link at similarity s is missed in candidate search with probability
    (1 - s ** ``rows``) ** ``bands`` (7e-9 at 0.85), in pruning with about ``miss``.
    """
    found = _grouped(docs.select(id_col, text_col), id_col, text_col, percent, width, bands, rows, miss, block)
    return found.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, bands: int, rows: int, miss: float, block: int) -> DataFrame:
    """(_id, n_shingles, cls, component_id), one row per row of ``docs``."""
    comparer = Comparer(bands, rows, percent / 100, miss)
    sketch = checkpoint(sketches(docs, id_col, text_col, width, bands, rows))
    classes = checkpoint(
        sketch.where("cls is not null").groupBy("cls").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig"))
    )
    members = checkpoint(bucket_members(classes, bands, rows))

    texts = checkpoint(member_texts(members, classes, docs, id_col, text_col))
    compared = checkpoint(verified(checkpoint(star_candidates(members, comparer, members.count())), texts, width, percent))
    links = compared.where("linked").select("x", "y")
    comp = components(links)
    # only buckets whose members are not all in one component yet are looked at again, with full sets
    state = members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.hex(F.coalesce("comp", "cls")))
    state = checkpoint(state)
    undecided = state.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a != _b").select("key")
    state = state.join(undecided, "key").join(class_sets(texts, width), "cls")
    more = checkpoint(cross_links(state, comparer, percent, block))
    if more.limit(1).count():
        comp = components(links.unionByName(more))

    named = classes.join(comp, classes["cls"] == comp["node"], "left").select(classes["cls"], "rep", "size", F.coalesce("comp", classes["cls"]).alias("comp"))
    named = checkpoint(named)
    least = named.where("cls != comp").groupBy("comp").agg(F.min("rep").alias("least"))
    whole = named.join(least, "comp", "left").select("cls", "size", F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least"), "comp", "rep")
    roots = named.where("cls = comp").select("comp", F.col("rep").alias("root"))
    whole = checkpoint(whole.join(roots, "comp").select("cls", "size", F.least("least", "root").alias("component_id")))
    alone = sketch.where("cls is null").select("_id", "n_shingles", "cls", F.col("_id").alias("component_id"))
    rest = join_counted(sketch.where("cls is not null").select("_id", "n_shingles", "cls"), whole, "cls", "size", sketch.count())
    return alone.unionByName(rest.select("_id", "n_shingles", "cls", "component_id"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = 32, rows: int = 5, miss: float = 1e-6, block: int = 2048
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies, the document with the smallest id.

    Rules as for :func:`near_groups`; columns stay as they are; repeated rows of a kept id all stay, as
    do rows without an id where no other id is in their component.  Only rows that a Bloom filter of
    dropped ids lets through are shuffled.
    """
    packed = docs.select(F.col(id_col).alias("_id0"), F.col(text_col).cast("string").alias("_t0"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = _grouped(packed.select("_id0", "_t0"), "_id0", "_t0", percent, width, bands, rows, miss, block)
    gone = checkpoint(found.where(~F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("_gone"), F.col("cls").alias("_cls")).distinct())
    safe, maybe = split_by(packed, "_id0", gone.select("_gone"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_name(s) if len(s) else b"" for s in sets], pa.binary()), batch.column(2)], ["_id0", "_name", "_row"])

    # an id may have several texts, so the text's set is asked as well
    kinds = {f.name: f.dataType for f in packed.schema.fields}
    schema = StructType([StructField("_id0", kinds["_id0"]), StructField("_name", BinaryType()), StructField("_row", kinds["_row"])])
    maybe = maybe.select("_id0", "_t0", "_row").mapInArrow(named, schema)
    maybe = maybe.join(gone, F.col("_id0").eqNullSafe(F.col("_gone")) & (F.col("_name") == F.col("_cls")), "left_anti")
    return safe.select("_row.*").unionByName(maybe.select("_row.*"))
