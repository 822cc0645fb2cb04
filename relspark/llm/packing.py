"""Best-fit packing of tokenised documents by bin completion.

How many pieces there are of each length decides the packing, and there are only ``capacity``
lengths, so that histogram is all the driver sees, whatever the corpus holds. Branch and bound over
it yields patterns (the lengths of one sequence) with multiplicities; pieces are numbered among
those of their length by the scan itself, and a number's place in the patterns is arithmetic.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from relspark.llm.columns import id_and_text
from relspark.scratch import materialise

_WORKER: dict = {}

#: Fixed value: bytes of texts that are split at once. More of them repeat more words, and take more memory.
SLICE = 4 << 20

#: Words of these characters need no normalisation but lower case, and fall into the tokenizer's own pre-tokens by PRETOKEN.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Most of those that are no letters alone are ASCII letters and then marks, two pre-tokens; an apostrophe may begin others.
MARKED = re.compile(rb"([A-Za-z]+)([!-&(-/:-@[-`{-~]+)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes as: printable ones themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


#: What a tokenizer file must say for its words to be encoded one by one, as PLAIN and PRETOKEN have it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_white_space(config: dict) -> bool:
    """Whether a tokenizer's file normalises and splits texts as PLAIN and PRETOKEN do; of others, texts are encoded whole."""
    before, split = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [])
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        before.get("type") == split.get("type") == "Sequence"
        and before.get("normalizers") == NORMALIZERS
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        and byte_level.items() <= steps[1].items()
        and config.get("post_processor") is None
        and config["model"]["type"] == "BPE"
        and not config["model"].get("dropout")
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config.get("added_tokens", []))
    )


class _Kept:
    """A bounded cache of two generations: when the young one is full it becomes the old one, so what is used stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = max(1, most // 2), {}, {}

    def room(self, n: int) -> None:
        if len(self.young) + n > self.most:
            self.young, self.old = {}, self.young


class _Tokens:
    """Ids of texts, as little-endian 32-bit integers.

    White space parts a text, so its words are encoded one by one and kept. A plain word that is not kept is
    looked up by its pre-tokens, and only new pre-tokens reach the model; other words go through the whole tokenizer.
    """

    def __init__(self, path: str, cache_size: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_white_space(json.load(f))
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words = _Kept(cache_size)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def _packed(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: bytes) -> bytes:
        """The ids of a lower-case pre-token, which is a word of its own as well."""
        ids = self.words.young.get(part) or self.words.old.get(part)
        if ids is None:
            text = part.decode()
            ids = self.words.young[part] = array("I", [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.letters))]).tobytes()
        return ids

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters are one pre-token
            return self._part(word.lower())
        ends = MARKED.fullmatch(word)
        if ends:
            return self._part(ends[1].lower()) + self._part(ends[2])
        text = word.decode()
        if not PLAIN.fullmatch(text):
            return self._packed(text)
        return b"".join([self._part(p.encode()) for p in PRETOKEN.findall(text.lower())])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Arrow splits and joins; Python sees each distinct word of ``texts`` once."""
        whole = np.full(len(texts), not self.by_word)
        for s in self.special:  # special strings may hold or touch white space
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        packed = {int(i): self._packed(texts[int(i)].as_py()) for i in np.flatnonzero(whole)}
        if packed:
            texts = pc.if_else(pa.array(whole), "", texts)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._distinct(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, starts, data = ids.buffers()
        at = np.frombuffer(starts, np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [packed[i] if i in packed else bytes(data[lo:hi]) for i, (lo, hi) in enumerate(pairwise(at))]

    def _distinct(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.words.young.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if len(self.words.young) + len(missing) > self.words.most:
            self.words.room(len(missing))
            missing = range(len(words))
        young, old, word = self.words.young, self.words.old.get, self._word
        for k in missing:
            w = words[k]
            found[k] = young[w] = old(w) or word(w)
        return found


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of ``texts`` of at most ``most`` bytes, or of one text that is longer."""
    ends, lo = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi - lo
        lo = hi


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int, cache_size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number): number counts the pieces of that length in the scan's part."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, cache_size)
        if key not in _WORKER:
            _WORKER[key] = _Tokens(*key)
        tokens, part, seen = _WORKER[key], TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([separator], "<u4").tobytes()
        for b in batches:
            for lo, n_rows in slices(b.column(1), SLICE):
                row, piece, start, length, crc, number = [], [], [], [], [], []
                for i, ids in enumerate(tokens.encode(b.column(1).slice(lo, n_rows))):
                    ids += end
                    for k, s in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * s : 4 * (s + capacity)]
                        n = len(own) // 4
                        row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own)), number.append(seen[n])
                        seen[n] += 1
                ids_ = b.column(0).slice(lo, n_rows).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids_, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(number, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
                )

    return docs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint")


Pattern = tuple[tuple[tuple[int, int], ...], int]


def fillings(room: int, lengths: list[int], counts: _Less, most_waste: int, breadth: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` with a waste of at most ``most_waste``, as they are asked for: some without waste
    that are cheap to find, then for every sum of lengths, fullest first, one filling of it.

    ``steps`` holds how many items the search may still try in all; the rows of ``lengths``, which ascend, and
    ``counts`` are as they were whenever the next filling is asked for.

    A filling that one larger item could replace is dominated, so an item that fits exactly is the only
    answer, and a filling of several items must exceed the largest single one.
    """
    n = bisect_right(lengths, room)
    if not n:
        return iter([()] if room <= most_waste else [])
    if lengths[n - 1] == room:  # no generator: a search may be as deep as there are bins
        return iter([(room,)])
    return _several(room, lengths, counts, most_waste, breadth, steps)


def _several(room: int, lengths: list[int], counts: _Less, most_waste: int, breadth: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Those where some item fits and none exactly. What is held between two of them is small."""
    fit = lengths[: bisect_right(lengths, room)]
    cheap = _exact(room, fit, counts, breadth, steps)
    if not cheap and len(fit) > 128:  # so many lengths that a few of them fill the room
        found = _fullest(room, sorted({*fit[-48:], *fit[:: len(fit) // 48]}), counts, 0, room, steps)
        cheap = [found] if found else []
    seen = {tuple(sorted(f)) for f in cheap}
    del fit
    yield from cheap
    below = room
    while steps[0] > 0:
        fit = lengths[: bisect_right(lengths, room)]
        found = _fullest(room, fit, counts, most_waste, below, steps)
        if found is None:
            return
        below, last = sum(found) - 1, sum(found) <= fit[-1]
        del fit
        if tuple(sorted(found)) not in seen:
            yield found
        if last:  # any other filling is dominated by the largest item that fits
            return


def _fullest(room: int, fit: list[int], counts: _Less, most_waste: int, most: int, steps: list[int]) -> tuple[int, ...] | None:
    """The fullest filling of ``most`` at most, by subset sums; of those of one sum the one with the largest items."""
    # sums that the first 0, 1, ... lengths reach, as bits of an integer; each as often as there are items
    reached, mask = [1], (2 << room) - 1
    for x in fit:
        bits, n, step = reached[-1], min(counts[x], room // x), 1
        while n > 0:
            step = min(step, n)
            bits |= bits << x * step & mask
            n -= step
            step *= 2
        reached.append(bits)
    steps[0] -= len(fit)
    total = (reached[-1] & (2 << max(0, most)) - 1).bit_length() - 1
    if most < 0 or total < max(0, room - most_waste):
        return None
    left, chosen = total, []
    for k in range(len(fit), 0, -1):
        n = min(counts[fit[k - 1]], left // fit[k - 1])
        while n and not reached[k - 1] >> left - n * fit[k - 1] & 1:
            n -= 1
        chosen += [fit[k - 1]] * n
        left -= n * fit[k - 1]
    return tuple(chosen)


def _exact(room: int, fit: list[int], counts: _Less, breadth: int, steps: list[int]) -> list[tuple[int, ...]]:
    """Fillings of two items, or else of three, without waste; large items first."""

    def pairs(left: int, below: int, head: tuple[int, ...], most: int) -> list[tuple[int, ...]]:
        found = []
        for at in range(bisect_right(fit, min(below, left - 1)) - 1, -1, -1):
            a = fit[at]
            b = left - a
            if 2 * a < left or len(found) >= most:
                break
            steps[0] -= 1
            if counts[a] > head.count(a) and counts[b] > head.count(b) + (a == b):
                found.append((*head, a, b))
        return found

    out = pairs(room, room, (), breadth)
    end = max(0, steps[0] - 1000)
    for at in range(len(fit) - 1, -1, -1) if not out else ():
        a = fit[at]
        if 3 * a < room or len(out) >= breadth or steps[0] <= end:
            break
        if counts[a] > 0:
            out += pairs(room - a, a, (a,), 1)
    return out


def _applied(counts: dict[int, int], largest: int, filling: tuple[int, ...]) -> tuple[tuple[tuple[int, int], ...], int]:
    need: dict[int, int] = {largest: 1}
    for x in filling:
        need[x] = need.get(x, 0) + 1
    return tuple(sorted(need.items(), reverse=True)), min(counts[x] // n for x, n in need.items())


def _best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], int]:
    """Always the item that leaves least room, for the largest item left."""
    left, out, bins = dict(counts), [], 0
    lengths = sorted(left)
    while lengths:
        largest, room, filling = lengths[-1], capacity - lengths[-1], []
        used = {largest: 1}
        while True:
            at = bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
                at -= 1
            if at < 0:
                break
            x = lengths[at]
            filling.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
        need, times = _applied(left, largest, tuple(filling))
        for x, n in need:
            left[x] -= n * times
            if not left[x]:
                lengths.remove(x)
        out.append((need, times))
        bins += times
    return out, bins


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for every a, items above capacity - a are alone, those above half are apart,
    and items of a or more fill what those leave."""
    most = 0
    for a in [0, *(x for x in counts if 2 * x <= capacity)]:
        alone = sum(n for x, n in counts.items() if x > capacity - a)
        apart = [(x, n) for x, n in counts.items() if 2 * x > capacity and x <= capacity - a]
        rest = sum(x * n for x, n in counts.items() if a <= x and 2 * x <= capacity)
        bins = sum(n for _, n in apart)
        most = max(most, alone + bins + max(0, -(-(rest - bins * capacity + sum(x * n for x, n in apart)) // capacity)))
    return most


def complete_bins(counts: dict[int, int], capacity: int, *, tries: int = 250_000, breadth: int = 4) -> list[Pattern]:
    """Patterns with multiplicities that use up ``counts``, in as few bins as the search finds.

    Depth first: the largest item is placed with each undominated filling around it, as often as the
    counts allow. A branch ends when its waste exceeds what one bin fewer than the incumbent would
    leave. The incumbent starts from best fit; the search ends at the lower bound or after ``tries`` items tried, so it
    proves the least number of bins only if it ends before. ``breadth``: cheap fillings without waste tried first.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    total = sum(x * n for x, n in counts.items())
    bound = lower_bound(counts, capacity)
    best, bins = _best_fit(counts, capacity)
    left, lengths = dict(counts), sorted(counts)
    path: list[Pattern] = []
    wasted, steps = 0, [tries]
    stack: list[list] = []  # per level: fillings still to try; the step taken

    def options() -> Iterator[tuple[int, ...]]:
        allowed = (bins - 1) * capacity - total - wasted
        return fillings(capacity - lengths[-1], lengths, _Less(left, lengths[-1]), allowed, breadth, steps) if allowed >= 0 else iter(())

    stack.append([options(), None])
    while stack and bins > bound and steps[0] > 0:
        todo, step = stack[-1]
        if step is not None:  # undo
            need, times, waste = step
            for x, n in need:
                if not left[x]:
                    lengths.insert(bisect_right(lengths, x), x)
                left[x] += n * times
            wasted -= waste
            path.pop()
            stack[-1][1] = None
        filling = next(todo, None)
        if filling is None:
            stack.pop()
            continue
        steps[0] -= 1
        largest = lengths[-1]
        need, times = _applied(left, largest, filling)
        waste = times * (capacity - largest - sum(filling))
        if wasted + waste > (bins - 1) * capacity - total:
            times_ok = ((bins - 1) * capacity - total - wasted) // max(1, capacity - largest - sum(filling))
            if times_ok < 1:
                continue
            times = min(times, times_ok)
            waste = times * (capacity - largest - sum(filling))
        for x, n in need:
            left[x] -= n * times
            if not left[x]:
                lengths.remove(x)
        wasted += waste
        path.append((need, times))
        stack[-1][1] = (need, times, waste)
        if not lengths:
            best, bins = list(path), sum(t for _, t in path)
            continue
        stack.append([options(), None])
    return best


class _Less:
    """Counts without the one item that is placed already."""

    def __init__(self, counts: dict[int, int], placed: int):
        self.counts, self.placed = counts, placed

    def __getitem__(self, x: int) -> int:
        return self.counts.get(x, 0) - (x == self.placed)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 800_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``separator``; only longer ones than ``capacity`` are cut. Null and empty
    texts are a piece of one id. Repeated rows are packed each; an empty table gives an empty result;
    other columns are not read. The driver gets one count per length. ``cache_size`` bounds a worker's
    cache of encoded words and pre-tokens, ``complete_bins`` says what bounds the search.
    """
    own = materialise(pieces(id_and_text(docs, id_col, text_col), tokenizer_path, capacity, separator, cache_size), "pieces")
    by_part = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    lengths, firsts, sequences, multiples, offsets = [], [], [], [], []
    taken: dict[int, int] = {}
    sequence = 0
    for need, times in complete_bins(counts, capacity):
        at = 0
        for x, n in need:
            lengths.append(x), firsts.append(taken.get(x, 0)), sequences.append(sequence), multiples.append(n), offsets.append(at)
            taken[x] = taken.get(x, 0) + n * times
            at += x * n
        sequence += times
    key = np.array(lengths, np.int64) << 44 | np.array(firsts, np.int64)
    order = np.argsort(key)
    table = [np.array(c, np.int64)[order] for c in (key, firsts, sequences, multiples, offsets)]

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = own.join(by_part.select("length", "part", before.alias("before")), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, base, multiple, offset = table
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth, slot = np.divmod(rank - first[k], multiple[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(base[k] + nth), pa.array(offset[k] + slot * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
