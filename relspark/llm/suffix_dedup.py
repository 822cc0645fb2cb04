"""Exact substring dedup: bytes of strings of ``least`` bytes that stand earlier in the corpus go.

Every window of ``least`` bytes is owned by its least k-mer (by hash, leftmost), which only the
window's bytes decide; equal windows have equal owners at equal distances. So windows
are compared within the group of their owner's k-mer only:

1. a scan finds owners and the context of each (all bytes of the windows it owns); equal contexts of
   one scan batch are settled there, the rest is shuffled by k-mer as hashes, without text;
2. an owner whose context stood earlier is settled; one whose k-mer has one context has no earlier
   window; only owners with different contexts around one k-mer need their bytes;
3. their contexts meet by k-mer, and a Burrows-Wheeler transform over many groups at once is
   searched breadth first: intervals of strings of length 0, 1, 2, ... are extended backwards, each new
   right border gets the length as its common prefix, and the search stops at ``least``. Rows
   without a border between them begin with the same ``least`` bytes;
4. k-mers with more contexts than a task should hold (a common line in ever new surroundings) go
   by 128 bits of each window, which any number of tasks can share; a scan batch settles its own first.

Texts of any length are read in parts of a quarter of a megabyte, which overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from relspark.llm.columns import id_and_text
from relspark.llm.textvec import BLOCK_BYTES, Hasher, flat, mix, parts
from relspark.scratch import materialise

KMER = 32
UNSET = 255


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x[: len(x) - rest if rest else None]


def owners(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, owner, first window, last window, k-mer hash, context hash) of a block; positions in the block."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < least:
        return none
    at = np.arange(n - KMER + 1)
    hashes = Hasher(data)(at, at + KMER)
    low = np.uint64((1 << n.bit_length()) - 1)
    owner = (sliding_min((hashes & ~low) | at.view(np.uint64), least - KMER + 1) & low).astype(np.int64)
    del at
    # windows that end within their text
    inside = np.ones(len(owner), bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - least + 1) : end] = False
    window = np.flatnonzero(inside)
    if not len(window):
        return none
    owner = owner[window]
    edge = np.flatnonzero(np.diff(owner) != 0) + 1
    first, last = window[np.concatenate(([0], edge))], window[np.concatenate((edge - 1, [len(window) - 1]))]
    owner = owner[np.concatenate(([0], edge))]
    kmer = hashes[owner]
    del hashes, window, inside
    context = Hasher(data, seed=1)(first, last + least) ^ mix((owner - first).astype(np.uint64))
    return np.searchsorted(offsets, owner, side="right") - 1, owner, first, last, kmer, context


def _ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols or more, by prefix doubling."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(8, symbols.dtype)))
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key |= padded[j : j + n]
    have = 7
    while True:
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        rank = np.zeros(n + have, np.int32)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])), dtype=np.int32)
        key = rank[:n] * np.int64(n + 1) + rank[have:]
        have *= 2


def prefix_classes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): suffixes in order, and equal classes where the first ``least`` symbols are equal.

    ``symbols``: 0 separates, others are 1 to 256. Common prefixes are found by increasing length: the queue holds
    the intervals of strings of one length; extended backwards by each symbol before them they give the
    intervals of the next length, of which only those with a new right border go on.
    """
    n = len(symbols)
    whole = np.int32 if 258 * (n + 2) < 2**31 else np.int64
    order = _ranks(symbols, least).astype(whole)
    before = symbols[order - 1]
    before[order == 0] = 0
    by_symbol = np.argsort(before, kind="stable").astype(whole)
    onto = np.empty(n, whole)  # where the suffix one symbol longer stands
    onto[by_symbol] = np.arange(n, dtype=whole)
    sorted_before = before[by_symbol]
    sorted_keys = sorted_before * whole(n + 1) + by_symbol
    later = np.full(n, n, whole)  # next row with the same symbol before it
    same = sorted_before[:-1] == sorted_before[1:]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    del sorted_before, by_symbol, same

    common = np.full(n + 1, UNSET, np.uint8)
    common[n] = common[0] = 0
    # strings of one symbol
    sizes = np.bincount(symbols, minlength=257).astype(whole)
    right = np.cumsum(sizes, dtype=whole) - whole(1)
    left = right - sizes + 1
    left, right = left[sizes > 0], right[sizes > 0]
    common[right + 1] = 0
    for length in range(1, least):
        one = left == right
        last, start = left[one], left[one]  # rows before which a symbol stands, and their interval's left end
        if not one.all():
            a, b = left[~one], right[~one]
            size = b - a + 1
            rows = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum(), dtype=a.dtype)
            keep = later[rows] > np.repeat(b, size)  # the last row of its symbol in the interval
            last, start = np.concatenate((last, rows[keep])), np.concatenate((start, np.repeat(a, size)[keep]))
        to = onto[last]
        new = (before[last] > 0) & (common[to + 1] == UNSET)
        last, start, right = last[new], start[new], to[new]
        if not len(right):
            break
        common[right + 1] = length
        left = right.copy()
        wide = last != start
        symbol = before[last[wide]]
        left[wide] = np.searchsorted(sorted_keys, symbol * whole(n + 1) + start[wide])
    return order, np.cumsum(common[:n] != UNSET, dtype=whole)


def _earlier(ids: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a member of the same class has a smaller (id, start)."""
    order = np.lexsort((starts, ids, classes))
    c, i, s = classes[order], ids[order], starts[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(c) != 0)))
    head = np.repeat(first, np.diff(np.concatenate((first, [len(c)]))))
    out = np.zeros(len(c), bool)
    out[order] = (i != i[head]) | (s != s[head])
    return out


def _runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first, last) of consecutive starts, from rows in order of id and start."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    edge = np.flatnonzero((np.diff(ids) != 0) | (np.diff(starts) > 1)) + 1
    a, b = np.concatenate(([0], edge)).astype(np.int64), np.concatenate((edge - 1, [len(ids) - 1])).astype(np.int64)
    return (ids[a], starts[a], starts[b]) if len(ids) else (ids, starts, starts)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of pieces, end to end."""
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


#: kind: 0 an owner still open, 1 windows that stand earlier (first to last), 2 an owner whose bytes are needed, 3 the same of a hot k-mer.
OWNER = "kind tinyint, kmer bigint, context bigint, doc_id bigint, owner int, first int, last int"


def _find_owners(docs: DataFrame, least: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            found = []
            for lo, _, data, offsets, base in parts(b.column(1), least - 1):
                text, owner, first, last, kmer, context = owners(data, offsets, least)
                begin = offsets[text] - base
                found.append((ids[lo + text], owner - begin, first - begin, last - begin, kmer, context))
            if not found:
                continue
            doc, owner, first, last, kmer, context = (np.concatenate(c) for c in zip(*found, strict=True))
            known = _earlier(doc, owner, mix(kmer) ^ context)
            d, f, e = (doc[known], first[known], last[known])
            # consecutive settled owners become one range; ranges travel under a key of their own
            order = np.lexsort((f, d))
            d, f, e = d[order], f[order], e[order]
            cut = np.flatnonzero((np.diff(d) != 0) | (f[1:] > e[:-1] + 1)) + 1
            a, z = (np.concatenate(([0], cut)).astype(np.int64), np.concatenate((cut - 1, [len(d) - 1])).astype(np.int64)) if len(d) else (cut, cut)
            rows = [(0, kmer[~known], context[~known], doc[~known], owner[~known], first[~known], last[~known])]
            rows.append((1, mix(d[a].astype(np.uint64) * np.uint64(31) + f[a].astype(np.uint64)), np.zeros(len(a), np.uint64), d[a], f[a], f[a], e[z]))
            for kind, k, c, d, o, f, e in rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(o.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(e.astype(np.int32))], names=OWNER_NAMES)

    return docs.mapInArrow(find, OWNER)


OWNER_NAMES = ["kind", "kmer", "context", "doc_id", "owner", "first", "last"]


def _decide(owners_: DataFrame, hot: int) -> DataFrame:
    """Settles owners by their contexts. Rows come in order of (kmer, context, doc_id, owner)."""

    def table(kind: int, rows: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int8)), *[pa.array(rows[c][keep]) for c in OWNER_NAMES[1:]]], names=OWNER_NAMES)

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # first owners of the last k-mer's contexts, while they may be the only ones
        tail = None  # (kmer, context, doc_id, owner) of the context that is running
        hot_kmer = None
        for b in batches:
            if not len(b):
                continue
            rows = {c: b.column(c).to_numpy() for c in OWNER_NAMES}
            through = rows["kind"] == 1
            if through.any():
                yield table(1, rows, through)
                rows = {c: v[~through] for c, v in rows.items()}
                if not len(rows["kind"]):
                    continue
            n = len(rows["kind"])
            fresh = np.ones(n, bool)
            fresh[1:] = (np.diff(rows["kmer"]) != 0) | (np.diff(rows["context"]) != 0)
            if tail is not None:
                fresh[0] = (rows["kmer"][0], rows["context"][0]) != tail[:2]
            head = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            doc0 = np.where(head >= 0, rows["doc_id"][head], tail[2] if tail else 0)
            own0 = np.where(head >= 0, rows["owner"][head], tail[3] if tail else 0)
            tail = (rows["kmer"][-1], rows["context"][-1], doc0[-1], own0[-1])
            again = ~fresh & ((rows["doc_id"] != doc0) | (rows["owner"] != own0))
            if again.any():
                yield table(1, rows, again)
            # what is left: the first owner of each context
            rows = {c: v[fresh] for c, v in rows.items()}
            if held is not None:
                rows = {c: np.concatenate((held[c], v)) for c, v in rows.items()}
            if not len(rows["kmer"]):
                continue
            edge = np.flatnonzero(np.diff(rows["kmer"]) != 0) + 1
            start = np.concatenate(([0], edge))
            size = np.diff(np.concatenate((start, [len(rows["kmer"])])))
            of = np.repeat(size, size)
            done = np.arange(len(of)) < start[-1]
            is_hot = (of > hot) | (rows["kmer"] == hot_kmer if hot_kmer is not None else False)
            if size[-1] > hot or hot_kmer is not None and rows["kmer"][-1] == hot_kmer:
                hot_kmer = rows["kmer"][-1]
                done[:] = True
            for kind, keep in ((2, done & (of > 1) & ~is_hot), (3, done & is_hot)):
                if keep.any():
                    yield table(kind, rows, keep)
            held = {c: v[~done] for c, v in rows.items()}
        if held is not None and len(held["kmer"]) > 1:
            yield table(2, held, np.ones(len(held["kmer"]), bool))

    return owners_.mapInArrow(decide, OWNER)


def _cut(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The bytes of contexts (kind 2), or the hashes of the windows of hot ones (kind 3: kmer and more stand for the window).

    Of equal windows of hot contexts in one batch only the earliest goes on, the others are ranges (kind 1).
    """
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "kmer", "first", "last")).alias("asked"))
    schema = "kind tinyint, kmer bigint, more bigint, doc_id bigint, first int, windows int, bytes binary"
    names = ["kind", "kmer", "more", "doc_id", "first", "windows", "bytes"]

    def table(kind: int, kmer: np.ndarray, more: np.ndarray, doc: np.ndarray, first: np.ndarray, windows: np.ndarray, pieces: pa.Array | None = None) -> pa.RecordBatch:
        n = len(kmer)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(kmer), pa.array(more), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.nulls(n, pa.binary()) if pieces is None else pieces], names=names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column(1))
            of = b.column(2)
            row = np.repeat(np.arange(len(b)), np.diff(of.offsets.to_numpy()))
            kind, kmer, first, last = (of.flatten().field(i).to_numpy() for i in range(4))
            doc, first, windows = b.column(0).to_numpy()[row], first.astype(np.int64), (last - first + 1).astype(np.int64)
            start, size = offsets[row] + first, windows + least - 1
            for wanted_kind in (2, 3):
                mine = np.flatnonzero(kind == wanted_kind)
                while len(mine):  # so many at a time that their bytes are a block
                    n = max(1, int(np.searchsorted(np.cumsum(size[mine]), BLOCK_BYTES, side="right")))
                    now, mine = mine[:n], mine[n:]
                    data = _gather(raw, start[now], size[now])
                    if wanted_kind == 2:
                        ends = np.concatenate(([0], np.cumsum(size[now]))).astype(np.int32)
                        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(now), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                        yield table(2, kmer[now], np.zeros(len(now), np.int64), doc[now], first[now], windows[now], pieces)
                        continue
                    shift = np.arange(int(windows[now].sum())) - np.repeat(np.cumsum(windows[now]) - windows[now], windows[now])
                    at = np.repeat(np.cumsum(size[now]) - size[now], windows[now]) + shift
                    hashes = [Hasher(data, seed=seed)(at, at + least) for seed in (2, 3)]
                    ids, starts = np.repeat(doc[now], windows[now]), np.repeat(first[now], windows[now]) + shift
                    known = _earlier(ids, starts, hashes[0] ^ mix(hashes[1]))
                    d, f, e = _runs(ids[known], starts[known])
                    none = np.zeros(len(d), np.int64)
                    yield table(1, none, none, d, f, e - f + 1)
                    once = ~known
                    yield table(3, hashes[0][once].view(np.int64), hashes[1][once].view(np.int64), ids[once], starts[once], np.ones(int(once.sum()), np.int32))

    return docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, schema)


def _joined_runs(windows: DataFrame, n: int) -> DataFrame:
    """(doc_id, first, last) of consecutive windows (doc_id, first), so that a long repeat is a row and not one for each byte."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                found = _runs(b.column(0).to_numpy(), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["doc_id", "first", "last"])

    return windows.repartition(n, "doc_id").sortWithinPartitions("doc_id", "first").mapInArrow(join, "doc_id bigint, first int, last int")


def repeated_windows(contexts: list[bytes], windows: np.ndarray, doc: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last) of windows of the contexts that stand earlier in one of them."""
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
    lengths = np.array([len(c) for c in contexts])
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    symbols[start + lengths] = 0
    order, classes = prefix_classes(symbols, least)
    of = np.empty(len(symbols), np.int64)
    of[order] = classes
    context = np.repeat(np.arange(len(contexts)), windows)
    shift = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
    ids, starts = doc[context], first[context] + shift
    known = _earlier(ids, starts, of[start[context] + shift])
    return _runs(ids[known], starts[known])


def _search(contexts: DataFrame, least: int, chunk: int) -> DataFrame:
    """(doc_id, first, last) of repeated windows; rows come in order of kmer, and a group is never parted."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(rows: pa.Table) -> pa.RecordBatch:
            found = repeated_windows(rows.column("bytes").to_pylist(), rows.column("windows").to_numpy().astype(np.int64), rows.column("doc_id").to_numpy(), rows.column("first").to_numpy().astype(np.int64), least)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(found, (np.int64, np.int32, np.int32), strict=True)], names=["doc_id", "first", "last"])

        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                held.append(part)
                size += int(pc.sum(pc.binary_length(part.column("bytes"))).as_py())
                if size >= chunk:
                    rows = pa.Table.from_batches(held)
                    kmer = rows.column("kmer").to_numpy()
                    end = int(np.searchsorted(kmer, kmer[-1], side="left"))
                    if end:
                        yield run(rows.slice(0, end))
                        held, size = rows.slice(end).to_batches(), 0
                        size = sum(int(pc.sum(pc.binary_length(h.column("bytes"))).as_py()) for h in held)
        if held:
            rows = pa.Table.from_batches(held)
            if len(rows):
                yield run(rows)

    return contexts.mapInArrow(search, "doc_id bigint, first int, last int")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with an id for each text, and (doc_id, text_hash, place) where one id has several texts; else None.

    Such rows are documents of their own, in the order of a hash of their text. The places of all
    (id, text) follow the ids, so that "earlier" stays what it was.
    """
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    spread = tagged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    if not spread.where("a < b").limit(1).count():
        return docs, None
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_hash"]
    ranged = materialise(tagged.where("doc_id IS NOT NULL").select(*order).distinct().repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "places")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    places = ranged.join(F.broadcast(before), "part").select(*order, (F.col("before") + F.col("at")).alias("place"))
    return tagged.join(places, order, "left"), places


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100, hot: int = 2000, chunk: int = 1 << 18, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (bytes) if asked for.

    A byte goes if a string of ``least`` bytes covers it that also starts earlier (smaller id, or the same document
    further left). Ids are integers; a row without an id takes no part and keeps everything. Rows of one id and one text
    are one document, whose strings at the same place are no repeats of each other; rows of one id with different
    texts are documents of their own, in the order of a hash of their text. Null and empty texts have no bytes. An
    empty table gives an empty result; other columns are not read. ``hot``: contexts of a k-mer that one task compares.
    """
    if not KMER < least < UNSET:
        raise ValueError(f"least must be between {KMER + 1} and {UNSET - 1}")
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole, places = _numbered(docs)
    if places is not None:
        whole = materialise(whole.select(F.col("place").alias("doc_id"), "text", F.col("doc_id").alias("own_id")), "numbered")
        docs = whole.select("doc_id", "text")
    known = docs.where("doc_id IS NOT NULL")
    found = _find_owners(known, least)
    decided = materialise(_decide(found.repartition(n, "kmer").sortWithinPartitions("kmer", "context", "doc_id", "owner"), hot), "decided")
    cut = materialise(_cut(known, decided.where("kind >= 2"), least), "contexts")
    searched = _search(cut.where("kind = 2").select("kmer", "doc_id", "first", "windows", "bytes").repartition(n, "kmer").sortWithinPartitions("kmer"), least, chunk)
    windows = cut.where("kind = 3").select("kmer", "more", "doc_id", "first")
    earliest = windows.groupBy("kmer", "more").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    later = windows.join(earliest, ["kmer", "more"]).where("struct(doc_id, first) > least").select("doc_id", "first")
    settled = cut.where("kind = 1").select("doc_id", "first", (F.col("first") + F.col("windows") - 1).alias("last"))
    ranges = decided.where("kind = 1").select("doc_id", "first", "last").union(searched).union(settled).union(_joined_runs(later, n))
    gathered = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    most = 4 << 20  # bytes of kept texts in a batch of the result

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)

        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc, text, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = memoryview(text.as_buffer())
                left, gone, spans, reached = hashlib.sha256(), 0, 0, 0
                kept = []
                a = z = ()
                if ranges.is_valid:
                    f, e = (ranges.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                    order = np.argsort(f, kind="stable")
                    f, e = f[order], np.maximum.accumulate(e[order] + least)
                    new = np.concatenate(([True], f[1:] > e[:-1]))
                    a, z = f[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))]
                    spans, gone = len(a), int((z - a).sum())
                    a, z = a.tolist(), z.tolist()
                for s, t in zip([*a, len(raw)], [*z, len(raw)], strict=True):
                    left.update(raw[reached:s])
                    if with_text:
                        kept.append(bytes(raw[reached:s]))
                    reached = t
                if with_text:
                    kept = [b"".join(kept)]
                    held += len(kept[0])
                for column, value in zip(out, (doc, len(raw), gone, spans, left.hexdigest(), *kept), strict=True):
                    column.append(value)
                if held > most:
                    yield batch(out)
                    out, held = [[] for _ in names], 0
            yield batch(out)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    if places is None:
        return docs.join(gathered, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(remove, schema)
    return whole.join(gathered, "doc_id", "left").select("own_id", "text", "ranges").mapInArrow(remove, schema)
