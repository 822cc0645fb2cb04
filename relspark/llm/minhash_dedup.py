"""MinHash near-dedup with circulant permutations.

A first permutation spreads the shingles over a circle of ``CIRCLE`` places; the second one is a
fixed arrangement of that circle, and coordinate k of a signature is the least value that the
arrangement, turned by k places, gives to the document's places. All coordinates of a place are
consecutive entries of one table, so a signature is a minimum over rows of contiguous memory.

Documents with the same shingle set are first merged, then bands of coordinates make buckets. A
bucket's pairs are never listed: its members are verified against its smallest member, those left outside the
bucket's largest component against its most central one (with fewest shingles that nobody else has),
and only what lies apart even then is compared with all others, by bounds that lose nothing first. One
bound: shingles that no other document has cannot be shared, so a copy with too many changes of its own
can have no partner. Links are confirmed by exact Jaccard on the full shingle sets.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from relspark.llm.columns import fresh, id_and_text
from relspark.llm.components import components, merge
from relspark.llm.textvec import Words, blocks, gram_hashes, mix
from relspark.scratch import materialise

CIRCLE = 1 << 20
SEED = 20240607
SHINGLE = 5


@cache
def _turned(length: int) -> np.ndarray:
    """Row p: what place p gets under the arrangement turned by 0, 1, ... places."""
    values = np.random.Generator(np.random.PCG64(SEED)).permutation(CIRCLE).astype(np.uint32)
    return sliding_window_view(np.concatenate((values, values[: length - 1])), length)


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """The circulant MinHash signature of distinct shingle hashes."""
    places = (mix(shingles ^ np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)
    table = _turned(length)
    out = np.full(length, CIRCLE, np.uint32)
    for lo in range(0, len(places), 1024):
        np.minimum(out, table[places[lo : lo + 1024]].min(axis=0), out=out)
    return out


def shingle_sets(words: Words, rows: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: five words, or all of fewer words; none without words."""
    grams = words.grams(SHINGLE)
    out = []
    for a, b in zip(words.bounds[:rows].tolist(), words.bounds[1 : rows + 1].tolist(), strict=True):
        out.append(np.unique(grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else gram_hashes(words.hashes[a:b], b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in blocks(texts):
        yield from shingle_sets(Words(data, offsets), hi - lo)


def _set_hashes(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    k = np.arange(1, len(own) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return tuple(int(mix(np.array([(mix(own + np.uint64(seed)) * (2 * k + np.uint64(1))).sum() + np.uint64(len(own))], np.uint64))[0].view(np.int64)) for seed in (1, 2))


def band_shape(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` coordinates that miss a pair at the threshold with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys): two hashes of the whole set, and one of every band of its signature."""
    length = bands * rows

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for lo, hi, data, offsets in blocks(b.column(1)):
                sets = shingle_sets(Words(data, offsets), hi - lo)
                made = np.stack([signature(s, length) if len(s) else np.zeros(length, np.uint32) for s in sets])
                parts = made.reshape(len(sets), bands, rows).astype(np.uint64)
                keys = np.broadcast_to(band, (len(sets), bands)).copy()
                for r in range(rows):
                    keys = mix(keys * np.uint64(31) + parts[:, :, r])
                pairs = [_set_hashes(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in pairs], pa.int64()),
                        pa.array([p[1] for p in pairs], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return docs.mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full shingle sets reach the threshold. ``texts``: doc_id, text, one row each."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()  # sets of the last documents that many pairs share
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                a_ids, b_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                first: dict[int, int] = {}
                for i, a in enumerate(a_ids):
                    if a not in kept and a not in first:
                        first[a] = i
                kept.update(zip(first, _sets_of(part.column(2).take(pa.array(list(first.values()), pa.int64()))), strict=True))
                hit = []
                for i, y in enumerate(_sets_of(part.column(3))):
                    x = kept[a_ids[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                while len(kept) > 256:
                    kept.popitem(last=False)
                keep = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in keep], pa.int64()), pa.array([b_ids[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(verify, "a bigint, b bigint")


def _mixed(members: DataFrame, labels: DataFrame, outsiders_a_task: int) -> DataFrame:
    """(key, doc_id, comp, main, salts) of buckets whose members are not all in one component; main is the largest."""
    placed = materialise(members.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp")), "placed")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most AND all > 2")
    mixed = mixed.select("key", "main", F.ceil((F.col("all") - F.col("most")) / outsiders_a_task).cast("int").alias("salts"))
    return materialise(placed.join(mixed, "key"), "mixed")


def _single(texts: DataFrame) -> DataFrame:
    """(doc_id, single): how many shingles of a document no other one of these has. Partners can share the rest at most."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, offsets in blocks(b.column(1)):
                sets = shingle_sets(Words(data, offsets), hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "shingle"])

    shingles = texts.select("doc_id", "text").mapInArrow(explode, "doc_id bigint, shingle bigint")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("single"))


def _fingerprints(texts: DataFrame) -> DataFrame:
    """(doc_id, prints): 16 bits of every shingle of a document's set."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in blocks(b.column(1)):
                sets = shingle_sets(Words(data, offsets), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([(x >> np.uint64(48)).astype(np.uint16).tobytes() for x in sets], pa.binary())], names=["doc_id", "prints"])

    return texts.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, prints binary")


def _alike(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) of outsiders and members of one bucket part, of different components, that may reach the threshold.

    Rows come sorted by (key, salt, role): the part's outsiders (role 0, of bounded number), then all its
    members (role 1), which are streamed past them. Equal fingerprints are at least as many as equal shingles,
    and shingles that nobody else has are never equal, so no link is lost; nearly all that is left is one.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, raw, block = None, [], [], None
        present = np.zeros(1 << 16, np.uint8)
        for b in batches:
            key, salt, role = (b.column(c).to_numpy() for c in ("key", "salt", "role"))
            facts = np.stack([b.column(c).to_numpy() for c in ("doc_id", "comp", "n_shingles", "shared")], axis=1)
            prints = b.column("prints").to_pylist()
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0) | (np.diff(role) != 0)) + 1
            out: set[tuple[int, int]] = set()
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                if e == s:
                    continue
                if (key[s], salt[s]) != now:
                    now, held, raw, block = (key[s], salt[s]), [], [], None
                if role[s] == 0:
                    held.append(facts[s:e])
                    raw += prints[s:e]
                    block = None
                    continue
                if not held:
                    continue
                if block is None:
                    block = np.concatenate(held), np.frombuffer(b"".join(raw), np.uint16), np.concatenate(([0], np.cumsum([len(x) // 2 for x in raw])[:-1]))
                (doc, comp, size, shared), theirs, start = block[0].T, block[1], block[2]
                for i in range(s, e):
                    y, c, n, m = facts[i].tolist()
                    most = np.minimum(shared, m)
                    near = (comp != c) & (100 * most >= percent * (size + n - most))
                    if not near.any():
                        continue
                    mine = np.frombuffer(prints[i], np.uint16)
                    present[mine] = 1
                    equal = np.minimum(np.add.reduceat(present[theirs], start, dtype=np.int64), n)
                    present[mine] = 0
                    for j in np.flatnonzero(near & (100 * equal >= percent * (size + n - equal))):
                        x = int(doc[j])
                        out.add((min(x, y), max(x, y)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return groups.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, rows: int = 4, miss: float = 1e-8, outsiders_a_task: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Ids are integers; rows of the same id count as one document and share its smallest component, a row
    without an id is linked with nothing (component null, kept). Null and empty texts have no shingles and
    are linked with nothing. An empty table gives an empty result; other columns are not read.
    """
    threshold = percent / 100
    bands = band_shape(threshold, rows, miss)
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spark = docs.sparkSession
    signed = materialise(signatures(docs, bands, rows), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = materialise(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")
    # of documents of the same set the smallest one stands for all
    reps = full.join(sets.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
    buckets = materialise(reps.select("doc_id", F.explode("keys").alias("key")), "buckets")
    shared = materialise(buckets.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center < last").select("key", "center"), "shared")
    members = materialise(buckets.join(shared, "key").select("key", "doc_id", "center"), "members")
    stars = members.where("doc_id > center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    wanted = members.select("doc_id").distinct()
    texts = materialise(docs.join(wanted, "doc_id", "left_semi"), "texts")
    labels = components(_verified(stars, texts, percent), "a", "b")

    # Members that their bucket's center leaves out, with the shingles that no other such document has.
    mixed = _mixed(members.select("key", "doc_id"), labels, outsiders_a_task)
    single = _single(texts.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi"))
    facts = signed.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles").join(single, "doc_id", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("single", F.lit(0))).drop("single")
    facts = materialise(facts.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi"), "facts")
    # a second center: the member that has least of its own, as the original of altered copies does
    central = mixed.join(facts.select("doc_id", "n_shingles", "shared"), "doc_id").groupBy("key").agg(F.min(F.struct((F.col("n_shingles") - F.col("shared")).alias("own"), "doc_id", "comp", "n_shingles", "shared")).alias("c"))
    second = mixed.join(facts.select("doc_id", "n_shingles", "shared"), "doc_id").join(central, "key").where("comp <> c.comp")
    most = F.least("shared", F.col("c.shared"))
    second = second.where(100 * most >= percent * (F.col("n_shingles") + F.col("c.n_shingles") - most))
    pairs = second.select(F.least("doc_id", F.col("c.doc_id")).alias("a"), F.greatest("doc_id", F.col("c.doc_id")).alias("b")).distinct()
    labels = merge(labels, _verified(pairs, texts, percent), "a", "b")

    # What still lies apart is compared with all other members, unless its own shingles rule that out: whoever
    # has so many that its best partner could not reach the threshold takes no part, and its bucket may fall away.
    mixed = _mixed(mixed.select("key", "doc_id"), labels, outsiders_a_task)
    open_ = mixed.join(facts.select("doc_id", "n_shingles", "shared"), "doc_id").where(100 * F.col("shared") >= percent * F.col("n_shingles"))
    open_ = materialise(open_.select("key", "salts", "main", "doc_id", "comp", "n_shingles", "shared"), "open")
    apart = open_.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    inside = open_.join(apart, "key", "left_semi")
    prints = materialise(_fingerprints(texts.join(inside.select("doc_id").distinct(), "doc_id", "left_semi")), "fingerprints")
    inside = inside.join(prints, "doc_id")
    part = lambda rows, role, salt: rows.select("key", salt.alias("salt"), F.lit(role).alias("role"), "doc_id", "comp", "n_shingles", "shared", "prints")
    outsiders = part(inside.where("comp <> main"), 0, F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    everyone = part(inside, 1, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = outsiders.union(everyone).repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "role")
    others = _alike(groups, percent).distinct()
    reached = merge(labels, _verified(others, texts, percent), "a", "b").withColumnsRenamed({"node": "rep", "component": "found"})
    of_set = sets.join(reached, "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("found", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their group, or linked with nothing; all columns as they are."""
    gone = near_duplicates(docs, id_col=id_col, **how).where("NOT kept").select(F.col("doc_id").alias(name := fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
