"""License scans with a generalised suffix automaton of license templates.

The automaton is built over the words of all templates and phrases. A file is streamed through
it, which gives its matching statistics: at every word the length of the longest run of words
ending there that some template holds. Where that is long enough, an automaton of each template gives
the maximal matches in that template and all their places there, for templates share words and repeat some;
the chains that cover most of the template make spans, and a span whose words are a part of another span's is left out. Words that no template has reset the automaton, so only runs of known words
are streamed; finding those runs is vectorised over whole batches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relspark.llm.columns import id_and_text
from relspark.llm.license_texts import TEXTS
from relspark.llm.textvec import ALPHANUMERIC, LOWER, Words, blocks, word_hash

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: A phrase and the label of each place where it stands.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short forms of public license notices, by label.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "licensed under the apache license version 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "licensed under the bsd license",
        "licensed under the bsd 3 clause license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
    ],
    "lgpl": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc 4 0"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0"],
    "all-rights-reserved": ["all rights reserved no part of this publication may be reproduced"],
}
#: Notices and whole texts.
ALL_TEMPLATES = {label: TEMPLATES.get(label, []) + TEXTS.get(label, []) for label in [*TEMPLATES, *(x for x in TEXTS if x not in TEMPLATES)]}


class Automaton:
    """A generalised suffix automaton over word ids. Every state has its ends, the templates and words where it ends, the
    one that came first apart."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [(-1, -1)]
        at: list[tuple[int, tuple[int, int]]] = []  # a prefix's state and its end
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, (k, i))
                at.append((last, (k, i)))
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for state, end in at:
            self.ends[state].add(end)
        for state in sorted(range(1, len(self.next)), key=lambda x: -self.length[x]):
            if self.link[state]:  # the root's are never asked for
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, edges: dict[int, int], end: tuple[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.end[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int, end: tuple[int, int]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, 0, {}, end)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def maximal_matches(self, words: list[int], least: int, *, every: bool = False) -> list[tuple[int, int, int, int]]:
        """(start, length, template, start there) of matches of ``least`` words or more that cannot grow to the right, in the
        place that came first, or in ``every`` one."""
        out, state, n = [], 0, 0

        def add(end: int) -> None:
            out.extend((end - n, n, k, e - n + 1) for k, e in (sorted(self.ends[state]) if every else (self.end[state],)))

        for i, w in enumerate(words):
            went = self.next[state].get(w)
            if went is None and n >= least:
                add(i)
            while went is None and state:
                state = self.link[state]
                n = self.length[state]
                went = self.next[state].get(w)
            if went is None:
                n = 0
            else:
                state, n = went, n + 1
        if n >= least:
            add(len(words))
        return out


def best_chains(matches: list[tuple[int, int, int]], most_gap: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(words covered, matches in order) of chains of (start, length, start in the template), the one that covers most first.

    In a chain starts and ends grow on both sides, with at most ``most_gap`` words of the text between matches. Each match is in
    one chain. Matches are maximal, so their ends come in the order of their starts and only the last few can be gone on from.
    """
    ms = sorted(matches)
    covered, back = [], []
    first = 0
    for i, (s, n, t) in enumerate(ms):
        while ms[first][0] + ms[first][1] < s - most_gap:
            first += 1
        best, of = n, -1
        for j in range(i - 1, first - 1, -1):
            x, m, y = ms[j]
            more = n - max(0, x + m - s, y + m - t)
            if x < s and y < t and more > 0 and covered[j] + more > best:
                best, of = covered[j] + more, j
        covered.append(best)
        back.append(of)
    out, used = [], [False] * len(ms)
    for i in sorted(range(len(ms)), key=lambda i: (-covered[i], i)):
        if used[i]:
            continue
        path, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = back[at]
        out.append((covered[i] - (covered[path[-1]] - ms[path[-1]][1]), [ms[x] for x in reversed(path)]))
    return out


class Scanner:
    """Templates and phrases, ready to scan blocks of texts. Built once in every worker from plain words."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], least_run: int, least_words: int, least_share: float, max_gap: int):
        self.least_run, self.least_words, self.least_share, self.max_gap = least_run, least_words, least_share, max_gap
        split = lambda t: WORD.findall(t.encode().translate(bytes(LOWER)))
        self.templates = [(label, split(t)) for label, ts in templates.items() for t in ts]
        self.phrases = [(label, split(p)) for p, label in phrases.items()]
        vocabulary = sorted({w for _, ws in self.templates + self.phrases for w in ws})
        hashes = np.array([word_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        index = {w: i for i, w in enumerate(vocabulary)}
        self.lengths = [len(ws) for _, ws in self.templates]
        self.automaton = Automaton([[index[w] for w in ws] for _, ws in self.templates])
        self.single = [Automaton([[index[w] for w in ws]]) for _, ws in self.templates]
        self.by_first: dict[int, list[tuple[list[int], str]]] = defaultdict(list)
        for label, ws in self.phrases:
            self.by_first[index[ws[0]]].append(([index[w] for w in ws], label))
        self.shortest = min([least_run, *(len(ws) for _, ws in self.phrases)])

    def known(self, words: Words, data: np.ndarray) -> np.ndarray:
        """The word's id, or -1 for words that no template has."""
        if not len(words.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, self.ids[at], -1)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of known words, long enough for a phrase or a match."""
        k = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edge = np.diff(k)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = b - a >= self.shortest
        return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))

    def scan(self, ids: np.ndarray) -> dict:
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int, int]] = []
        for a, b in self.runs(ids):
            run = ids[a:b].tolist()
            for i, w in enumerate(run):
                for words, label in self.by_first.get(w, ()):
                    if run[i : i + len(words)] == words:
                        base.append((a + i, label))
            if self.automaton.maximal_matches(run, self.least_run):
                matches += [(a + s, n, k, t) for k, own in enumerate(self.single) for s, n, _, t in own.maximal_matches(run, self.least_run, every=True)]
        spans = self.chain(matches)
        labels = sorted({x for _, x in base})
        found = sorted({self.templates[k][0] for k, *_ in spans} | set(labels))
        score = max([1.0 if base else 0.0, *(s for *_, s in spans)])
        starts = [s for s, _ in base]
        return {"n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(labels), "labels": ",".join(found), "score": score, "spans": [{"label": self.templates[k][0], "start": s, "end": e, "covered": c} for k, s, e, c, _ in spans]}

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, float]]:
        """(template, first word, end word, words covered, share covered) of chains that cover enough of a template.

        A chain whose words in the text are some of another such chain's, and fewer, is left out.
        """
        out, words = [], []
        by: dict[int, list] = defaultdict(list)
        for s, n, k, t in matches:
            by[k].append((s, n, t))
        for k, ms in by.items():
            for covered, path in best_chains(ms, self.max_gap):
                share = covered / self.lengths[k]
                if covered >= self.least_words and share >= self.least_share or share == 1.0:
                    out.append((k, path[0][0], path[-1][0] + path[-1][1], covered, share))
                    words.append({x for s, n, _ in path for x in range(s, s + n)})
        # only spans that begin no later can hold one; those that ended before are passed by
        kept, near = [], []
        for i in sorted(range(len(out)), key=lambda i: (out[i][1], -out[i][2], out[i][0])):
            near = [j for j in near if out[j][2] > out[i][1]]
            if not any(words[i] < words[j] for j in near):
                kept.append(out[i])
                near.append(i)
        return sorted(kept, key=lambda x: (x[1], x[0]))


_SCANNERS: dict = {}

SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,covered:bigint>>"


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least_run: int = 4, least_words: int = 6, least_share: float = 0.6, max_gap: int = 8) -> DataFrame:
    """One row per row of ``docs``: its words, places of the phrases, labels, a score and the covered template spans.

    A match has ``least_run`` words or more; a chain (gaps of ``max_gap`` words at most) counts if it covers
    ``least_words`` words and ``least_share`` of its template. score: the largest share covered, 1 where a
    phrase stands. Null and empty texts have no words and score 0; repeated rows are scanned each; an empty
    table gives an empty result; other columns are not read. One pass, no shuffle; the templates are constants.
    """
    docs = id_and_text(docs, id_col, text_col)
    phrases, templates = phrases or BASE_PHRASES, templates or ALL_TEMPLATES
    key = (tuple(phrases.items()), tuple((k, tuple(v)) for k, v in templates.items()), least_run, least_words, least_share, max_gap)
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(dict(key[0]), {k: list(v) for k, v in key[1]}, *key[2:])
        scanner = _SCANNERS[key]
        for b in batches:
            for lo, hi, data, offsets in blocks(b.column(1)):
                words = Words(data, offsets, ALPHANUMERIC)
                ids = scanner.known(words, data)
                rows = [scanner.scan(ids[words.bounds[i] : words.bounds[i + 1]]) for i in range(hi - lo)]
                column = lambda name, kind: pa.array([r[name] for r in rows], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(words.bounds), pa.int64()), column("n_base", pa.int64()), column("first_word", pa.int64()), column("last_word", pa.int64()), column("base_labels", pa.string()), column("labels", pa.string()), column("score", pa.float64()), column("spans", spans)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
