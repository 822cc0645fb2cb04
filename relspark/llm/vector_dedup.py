"""Embedding near-dedup by sorted projection passes.

A pass hashes every vector by random hyperplanes, concatenates the bits, orders the vectors
lexicographically by them and compares each with its next neighbours in that order. Close vectors
share long runs of bits, so they stand near each other in some pass; pairs are verified by their cosine in
double precision and united across passes into components. Equal vectors are merged first, so copies
cannot fill a window; how many passes there are follows the number of vectors.

A window bounds what a pass compares, not what is linked: links are counted afterwards within each component,
all of it against all of it, so a group of any size has whole counts. A large component is compared block
by block, each by itself in a task, and what lies within half the angle of a common pivot is linked without
a comparison. Counts travel, links do not: there are no more rows than members and blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relspark.llm.components import components
from relspark.scratch import materialise

SEED = 811


def _planes(turn: int, bits: int, size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, turn, size])).standard_normal((size, bits))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keys(vectors: DataFrame, passes: int, bits: int) -> DataFrame:
    """(turn, size, key, rep): a row for every vector and pass; key orders the pass, vectors of one size apart."""

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            lengths = np.array([len(x) for x in b.column(1)])
            for size in np.unique(lengths):
                rows = pa.array(np.flatnonzero(lengths == size))
                ids, vectors = b.column(0).take(rows), b.column(1).take(rows)
                x = _matrix(vectors)
                for turn in range(passes):
                    key = ((x @ _planes(turn, bits, int(size))) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array([turn] * len(rows), pa.int32()), pa.array([int(size)] * len(rows), pa.int32()), pa.array(key, pa.int64()), ids], names=["turn", "size", "key", "rep"])

    return vectors.mapInArrow(project, "turn int, size int, key bigint, rep bigint")


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column at length 1."""
    x = _matrix(column)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _near(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows reach ``cosine``; what a product of matrices leaves in doubt is summed by itself."""
    c = x @ y.T
    near = c >= cosine
    i, j = np.nonzero(np.abs(c - cosine) < 1e-9)
    if len(i):
        near[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return near


def _united(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the edges."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _neighbours(ordered: DataFrame, window: int, cosine: float) -> DataFrame:
    """(a, b) that unite all rows within ``window`` rows of each other in a part of the order that reach ``cosine``:
    of every stretch the links of a forest, at most as many as rows."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, unit, mine = (None, None), np.zeros(0, np.int64), None, np.zeros(0, bool)
        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in ("block", "turn", "size")])
            edges = np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1
            rep, own = b.column("rep").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
            vectors = b.column("vector")
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                if s == e:
                    continue
                if tuple(where[:, s]) != place:
                    place, ids, unit, mine = tuple(where[:, s]), np.zeros(0, np.int64), None, np.zeros(0, bool)
                for lo in range(s, e, window):
                    hi = min(e, lo + window)
                    x = _unit(vectors.slice(lo, hi - lo))
                    all_ids = np.concatenate((ids, rep[lo:hi]))
                    all_mine = np.concatenate((mine, own[lo:hi]))
                    all_x = x if unit is None else np.concatenate((unit, x))
                    k = len(ids)
                    i, j = np.nonzero(_near(x, all_x, cosine))
                    # a row looks back; the later row of the pair must be of the block itself
                    keep = (j < i + k) & (i + k - j <= window) & all_mine[i + k]
                    label = _united(len(all_ids), i[keep] + k, j[keep])
                    at = np.flatnonzero(label != np.arange(len(label)))
                    x, y = all_ids[label[at]], all_ids[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                    ids, mine, unit = all_ids[-window:], all_mine[-window:], all_x[-window:]

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def passes_for(n: int, window: int, cosine: float, miss: float) -> int:
    """Passes that miss a pair at ``cosine`` with probability ``miss`` at most: it meets where the bits agree that part
    the order into stretches of a quarter of a window."""
    if n <= window:
        return 1
    met = (1 - math.acos(cosine) / math.pi) ** math.log2(4 * n / window)
    return math.ceil(math.log(miss) / math.log(1 - met))


def _pivots(members: DataFrame, n: int) -> DataFrame:
    """(component, pivot): a direction amid the rows given of each component, of which there are a bounded number."""

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            if not len(b):
                continue
            component = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(component) != 0) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                if component[s] != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["component", "pivot"])
                    now, total = int(component[s]), 0.0
                total = total + _unit(b.column(1).slice(s, e - s)).sum(axis=0)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["component", "pivot"])

    return members.select("component", "vector").repartition(n, "component").sortWithinPartitions("component").mapInArrow(mean, "component bigint, pivot array<double>")


def _with_core(members: DataFrame, cosine: float) -> DataFrame:
    """Adds ``core``: within half the angle of ``cosine`` from the pivot, so that any two such rows are linked."""
    kept = [c for c in members.columns if c not in ("pivot",)]
    half = math.cos(math.acos(cosine) / 2) + 1e-9

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = np.zeros(len(b), bool)
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                lengths = np.diff(part.column("vector").offsets.to_numpy())
                for size in np.unique(lengths):
                    rows = np.flatnonzero(lengths == size)
                    p = _matrix(part.column("pivot").take(pa.array(rows)))
                    along = np.einsum("ij,ij->i", _unit(part.column("vector").take(pa.array(rows))), p)
                    core[lo + rows] = along >= half * np.sqrt((p * p).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(core)], names=[*kept, "core"])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    return members.select(*kept, "pivot").mapInArrow(mark, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", core boolean")


#: What a row is in a task: compared with all that follow, only counted by those, or both at once (a whole small component).
RIM, ALL, WHOLE = 0, 1, 2


def _counts(tasks: DataFrame, cosine: float) -> DataFrame:
    """(rep, n): rows linked, copies and the row itself included. Tasks (component, i, j) come in order, with RIM rows first.

    The RIM rows of a task are a block of bounded size; ALL rows are streamed past them, and those of the
    core count the RIM rows in turn.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def block() -> list:
            return [np.concatenate([h[k] for h in held]) for k in range(3)] + [held[0][3]]

        def table(rep: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some].astype(np.int64))], names=["rep", "n"])

        def done() -> Iterator[pa.RecordBatch]:
            """Ends a task: a whole component is compared with itself."""
            if held:
                rep, copies, x, n = block()
                if now[3] == WHOLE:
                    n = np.concatenate([_near(x[lo : lo + 1024], x, cosine) @ copies for lo in range(0, len(x), 1024)])
                yield table(rep, n)

        for b in batches:
            if not len(b):
                continue
            where = np.stack([b.column(c).to_numpy() for c in ("component", "i", "j", "role")])
            rep, copies, core = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "core"))
            edges = np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                at = tuple(where[:, s].tolist())
                if now is None or at[:3] != now[:3]:
                    yield from done()
                    held = []
                    now = at
                if at[3] != ALL:
                    held.append([rep[s:e], copies[s:e], _unit(b.column("vector").slice(s, e - s)), None])
                    continue
                if not held:
                    continue
                if len(held) > 1 or held[0][3] is None:
                    r, c, x, n = block()
                    held = [[r, c, x, np.zeros(len(r), np.int64) if n is None else n]]
                r, c, x, n = held[0]
                for lo in range(s, e, 1024):
                    hi = min(e, lo + 1024)
                    near = _near(x, _unit(b.column("vector").slice(lo, hi - lo)), cosine)
                    n += near @ copies[lo:hi]
                    yield table(rep[lo:hi][core[lo:hi]], (c @ near)[core[lo:hi]])
        yield from done()

    return tasks.mapInArrow(count, "rep bigint, n bigint")


def _linked(members: DataFrame, n: int, cosine: float, block_members: int) -> DataFrame:
    """(rep, n): how many rows of its component each of ``members`` (component, rep, copies, vector) is linked with, itself included."""
    sizes = members.groupBy("component").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / block_members).cast("int"))
    placed = members.join(sizes.select("component", "blocks"), "component")
    whole = placed.where("blocks = 1").select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(WHOLE).alias("role"), "rep", "copies", F.lit(False).alias("core"), "vector")
    in_block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    large = materialise(placed.where("blocks > 1").withColumn("own", in_block), "large")
    pivots = _pivots(large.where("own = 0"), n)
    cored = materialise(_with_core(large.join(pivots, "component"), cosine), "cored")
    spread = cored.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("in_core"), F.ceil(F.sum(F.when(F.col("core"), 0).otherwise(1)) / block_members).cast("int").alias("rims"))
    cored = cored.join(spread, "component")
    task = lambda rows, i, j, role: rows.select("component", i.alias("i"), j.alias("j"), F.lit(role).alias("role"), "rep", "copies", "core", "vector")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rim = task(cored.where("NOT core"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rims")).cast("int"), every("blocks"), RIM)
    others = task(cored.where("rims > 0"), every("rims"), F.col("own"), ALL)
    tasks = whole.union(rim).union(others).repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "role")
    return _counts(tasks, cosine).union(cored.where("core").select("rep", F.col("in_core").cast("bigint").alias("n"))).groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, miss: float = 1e-4, passes: int | None = None, window: int = 512, bits: int = 40, block_rows: int = 8192, block_members: int = 2048) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id, kept.

    Vectors that are null, empty, zero, or hold nulls or numbers that are not finite link with nothing; vectors of
    different sizes do not link. Equal vectors (by 128 bits of their numbers) are one class, all linked with each other.
    Rows without an id link with nothing. Repeated ids stand for rows of their own in n_links. Empty tables give an
    empty result; other columns are not read. A pair of 0 < ``cosine`` < 1 that no pass of a window brings together is
    missed with probability ``miss`` (for directions without order), unless other links unite it; n_links is
    exact within a component of any size.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must be between 0 and 1")
    spark = vectors.sparkSession
    # floats stay floats while they travel; cosines are in double precision
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    source = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast(kind).alias("vector"))
    fine = F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind)  # one zero only
    hashes = [F.xxhash64(F.lit(k), "vector").alias(f"hash_{k}") for k in (1, 2)]
    valid = materialise(source.where(fine).select("vec_id", plain.alias("vector")).select("vec_id", "vector", *hashes), "vectors")
    classes = materialise(valid.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "vector", *hashes), "classes")
    passes = passes or passes_for(classes.count(), window, cosine, miss)
    keyed = _keys(classes.select("rep", "vector"), passes, bits)
    # positions in each pass's order, without one task that sees it all: ranges of the order, numbered within
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "size", "key", "rep"]
    ranged = materialise(keyed.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono")), "order")
    at = F.col("mono") - F.col("part").cast("bigint") * F.lit(1 << 33)
    counts = ranged.groupBy("part").agg((F.max(at) + 1).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.join(F.broadcast(before), "part").select("turn", "size", "rep", (F.col("before") + at).alias("row"))  # one row a partition
    block = F.floor(F.col("row") / block_rows).cast("bigint")
    # every block also gets the last window of the block before
    in_blocks = placed.select("turn", "size", "rep", "row", F.explode(F.when(F.col("row") % block_rows >= block_rows - window, F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))).alias("to"))
    with_vectors = in_blocks.join(classes.select("rep", "vector"), "rep").select("to.block", "to.own", "turn", "size", "row", "rep", "vector")
    ordered = with_vectors.repartition(n, "block").sortWithinPartitions("block", "turn", "size", "row")
    links = materialise(_neighbours(ordered, window, cosine).distinct(), "links")
    reached = materialise(components(links, "a", "b").select(F.col("node").alias("rep"), "component"), "reached")
    members = classes.join(reached, "rep").select("component", "rep", "copies", "vector")
    counted = _linked(members, n, cosine, block_members)
    of_class = classes.select("rep", "copies", "hash_1", "hash_2").join(reached, "rep", "left").join(counted, "rep", "left").select("hash_1", "hash_2", (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = valid.select("vec_id", "hash_1", "hash_2").join(of_class, ["hash_1", "hash_2"]).select("vec_id", "n_links", "component_id")
    alone = source.where(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
