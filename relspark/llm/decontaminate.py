"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are short and documents long, so resemblance says nothing; containment does. Items are
partitioned by size (powers of two of their number of shingles), and each partition has its own
signature length: a MinHash coordinate of an item is the shingle with the least value under one
permutation, and a document that contains the share t of an item contains that shingle with
probability t. The coordinates are distinct shingles drawn without replacement (bottom-k), so an
item of n shingles of which more than n - k are in a document is always hit, and else it is missed
with a probability below (1 - t) ** k; small partitions keep all their shingles and miss nothing. Documents
of any length are probed in one pass, and every candidate is verified by the exact containment of
its word shingles.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from relspark.llm.columns import id_and_text
from relspark.llm.textvec import ALPHANUMERIC, LOWER, Words, blocks, gram_hashes, mix

SHINGLE = 5


def lowered_words(text: bytes) -> list[bytes]:
    """Words as ``Words`` takes them: runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased."""
    return text.translate(_SPACED).split()


_SPACED = bytes(int(LOWER[i]) if ALPHANUMERIC[i] else 32 for i in range(256))


@dataclass
class _Items:
    """One block of items, ready to be probed."""

    ids: list
    shingles: list[frozenset]  # of word tuples
    widths: list[int]
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by shingle width: sorted hashes, first and end entries
    owners: dict[int, np.ndarray] = field(default_factory=dict)
    filters: dict[int, np.ndarray] = field(default_factory=dict)


def _signature_length(size_class: int, threshold: float, miss: float) -> int:
    """Coordinates of a size partition, so that a document at the threshold is missed with probability ``miss`` at most."""
    return min(size_class, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - threshold)))) if threshold < 1 else 1


def _index(rows: list[tuple[object, str]], threshold: float, miss: float) -> _Items:
    out = _Items([], [], [])
    entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, text in rows:
        words = lowered_words(text.encode())
        if not words:
            continue
        width = min(SHINGLE, len(words))
        data = np.frombuffer(b" ".join(words), np.uint8)
        hashes = np.unique(gram_hashes(Words(data, np.array([0, len(data)]), ALPHANUMERIC).hashes, width))
        size_class = 1 << (len(hashes) - 1).bit_length()
        k = _signature_length(size_class, threshold, miss)
        least = hashes[np.argsort(mix(hashes + np.uint64(size_class)))[:k]]  # a permutation for each partition
        entries[width] += [(int(h), len(out.ids)) for h in least]
        out.ids.append(item)
        out.shingles.append(frozenset(zip(*[words[i:] for i in range(width)])))
        out.widths.append(width)
    for width, pairs in entries.items():
        pairs.sort()
        keys, first = np.unique(np.array([h for h, _ in pairs], np.uint64), return_index=True)
        out.table[width] = (keys, first, np.append(first[1:], len(pairs)))
        out.owners[width] = np.array([o for _, o in pairs])
        seen = np.zeros(1 << 20, bool)
        seen[(keys >> np.uint64(44)).astype(np.int64)] = True
        out.filters[width] = seen
    return out


def _candidates(items: _Items, words: Words) -> set[tuple[int, int]]:
    """(text, item) of the block that share a coordinate."""
    found: set[tuple[int, int]] = set()
    for width, (keys, first, end) in items.table.items():
        grams = words.grams(width)
        at = np.flatnonzero(items.filters[width][(grams >> np.uint64(44)).astype(np.int64)])
        text = np.searchsorted(words.bounds, at, side="right") - 1
        inside = at + width <= words.bounds[text + 1]
        at, text = at[inside], text[inside]
        k = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
        hit = keys[k] == grams[at]
        for t, j in set(zip(text[hit].tolist(), k[hit].tolist(), strict=True)):
            found.update((t, int(o)) for o in items.owners[width][first[j] : end[j]])
    return found


def _verified(items: _Items, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) for every item that a text contains to the threshold."""
    for lo, _, data, offsets in blocks(texts):
        found: dict[int, list[int]] = defaultdict(list)
        for t, o in _candidates(items, Words(data, offsets, ALPHANUMERIC)):
            found[t].append(o)
        for t, owners in sorted(found.items()):
            words = lowered_words(data[offsets[t] : offsets[t + 1]].tobytes())
            sets: dict[int, set] = {}
            for o in sorted(owners):
                w = items.widths[o]
                if w not in sets:
                    sets[w] = set(zip(*[words[i:] for i in range(w)]))
                both = len(items.shingles[o] & sets[w])
                if both >= threshold * len(items.shingles[o]):
                    yield lo + t, o, both


def _query_blocks(items: DataFrame, id_col: str, text_col: str, most_items: int, most_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The stated query set, in blocks of bounded size."""
    rows: list[tuple[object, str]] = []
    size = 0
    for r in items.select(items[id_col], F.coalesce(items[text_col].cast("string"), F.lit(""))).toLocalIterator():
        if rows and (len(rows) >= most_items or size + len(r[1]) * 4 > most_bytes):
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1]) * 4
    if rows:
        yield rows


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.75, miss: float = 1e-9, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per (document, item) of which the document contains ``threshold`` or more of the item's distinct five-word
    shingles: doc_id, item_id, n_item, n_shared, containment.

    An item of fewer words is one shingle; items and documents without words match nothing; nulls count as
    empty. Repeated documents and items give rows of their own; empty tables give an empty result; other
    columns are not read. Items are the stated query set: they are read in blocks of at most ``block_items``
    rows and ``block_bytes`` bytes, each of which every document is scanned against, so no broadcast outgrows its bound.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType, items.schema[item_id_col].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, n_item bigint, n_shared bigint, containment double"
    out = spark.createDataFrame([], schema)

    def scan(rows: list[tuple[object, str]]) -> DataFrame:
        block = spark.sparkContext.broadcast(rows)

        def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _index(block.value, threshold, miss)
            for b in batches:
                found = list(_verified(items, b.column(1), threshold))
                if found:
                    row, item, shared = zip(*found, strict=True)
                    n = [len(items.shingles[o]) for o in item]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([items.ids[o] for o in item], to_arrow_type(kinds[1])), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / m for s, m in zip(shared, n, strict=True)], pa.float64())], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        return docs.mapInArrow(probe, schema)

    for rows in _query_blocks(items, item_id_col, item_text_col, block_items, block_bytes):
        out = out.union(scan(rows))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.75, miss: float = 1e-9, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns as they are. Rows are judged by their text, in the scan itself."""
    spark, at, schema = docs.sparkSession, docs.columns.index(text_col), docs.schema

    def without(docs: DataFrame, rows: list[tuple[object, str]]) -> DataFrame:
        block = spark.sparkContext.broadcast(rows)

        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _index(block.value, threshold, miss)
            for b in batches:
                clean = np.ones(len(b), bool)
                clean[[row for row, *_ in _verified(items, b.column(at), threshold)]] = False
                yield b.filter(pa.array(clean))

        return docs.mapInArrow(keep, schema)

    for rows in _query_blocks(items, item_id_col, item_text_col, block_items, block_bytes):
        docs = without(docs, rows)
    return docs
