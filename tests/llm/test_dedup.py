"""Operators that compare documents, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from relspark.llm import components, minhash_dedup, passage_dedup, suffix_dedup, vector_dedup


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []
    frame = lambda x: spark.createDataFrame(x, "a bigint, b bigint")
    half = components.components(frame(pairs[:250]), "a", "b")
    assert {x.node: x.component for x in components.merge(half, frame(pairs[250:]), "a", "b").collect()} == got
    assert components.merge(half, frame(pairs[:9]), "a", "b").count() == half.count()


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("outsiders", [1024, 3])
def test_near_duplicates(docs_of, awkward, prose, outsiders):
    r = random.Random(2)
    rows = list(awkward)
    for i in range(25):  # families of copies with one to many edits, some far from one another
        base = prose(i, r.randint(6, 300)).split()
        for j in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(99)}"
            rows.append((100 + 10 * i + j, " ".join(copy).title() if j % 2 else " ".join(copy)))
    got = minhash_dedup.near_duplicates(docs_of(rows), outsiders_a_task=outsiders).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), root[x.doc_id], root[x.doc_id] == x.doc_id)
    docs = docs_of(rows)
    kept = minhash_dedup.keep_first(docs)
    assert sorted(x.doc_id or 0 for x in kept.collect()) == sorted(i or 0 for i, _ in rows if i is None or root[i] == i) and kept.columns == docs.columns


def test_no_documents(docs_of):
    for f in (minhash_dedup.near_duplicates, passage_dedup.shared_passages, suffix_dedup.remove_repeats):
        assert f(docs_of([])).collect() == []


def test_signature_estimates_resemblance():
    r = np.random.default_rng(3)
    a = r.integers(1, 2**63, 400).astype(np.uint64)
    for share in (0, 200, 390):
        b = np.concatenate((a[:share], r.integers(1, 2**63, 400 - share).astype(np.uint64)))
        equal = (minhash_dedup.signature(a, 512) == minhash_dedup.signature(b, 512)).mean()
        assert abs(equal - share / (800 - share)) < 0.08


def removed(rows, least):
    """Per document what goes, by a dictionary of all strings."""
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - least + 1):
            first.setdefault(texts[i][s : s + least], (i, s))
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < (i, s):
                gone[s : s + least] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "chunk"), [(2000, 1 << 20), (4, 20_000)])
def test_suffix_dedup(docs_of, awkward, prose, hot, chunk):
    r = random.Random(4)
    rows = list(awkward) + [(11, "ab" * 300), (12, "\x00" * 150 + "é" * 90)]
    bases = [prose(i, 150) for i in range(12)]
    for i in range(60):
        t = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abß\n")
        rows.append((100 + i, "".join(t[r.randrange(300) :]) + r.choice(bases)[: r.randint(0, 400)]))
    line = "A line of words that a great many documents share, of about seventy bytes "
    rows += [(500 + i, prose(900 + i, 15) + line * r.randint(1, 3) + prose(990 + i, 15)) for i in range(30)]
    got = suffix_dedup.remove_repeats(docs_of(rows, 5), hot=hot, chunk=chunk).collect()
    want = removed(rows, 100)
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.n_removed == 0
        else:
            assert tuple(x)[1:] == want[x.doc_id], x.doc_id
    kept = suffix_dedup.remove_repeats(docs_of([(1, "x" * 10)]), with_text=True).first()
    assert bytes(kept.kept) == b"x" * 10


def test_suffix_dedup_of_a_very_long_text(docs_of):
    letters = np.random.default_rng(12).integers(97, 123, 20 << 20).astype(np.uint8).tobytes().decode()
    edge = 1 << 18  # a part's end
    again = letters[edge - 3000 : edge + 2000]
    rows = [(1, letters), (2, "#" * 50 + again + "#" * 50), (3, letters[5_000_000:5_700_000] + "!")]
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs_of(rows)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (0, 0)
    assert (got[2].n_bytes, got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (5100, 5000, 1, hashlib.sha256(b"#" * 100).hexdigest())
    assert (got[3].n_removed, got[3].kept_sha256) == (700_000, hashlib.sha256(b"!").hexdigest())


def test_suffix_dedup_of_rows_with_one_id(docs_of, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (2, prose(3, 60)), (2, f"{prose(4, 30)} {a}"), (2, f"{prose(4, 30)} {a}"), (3, b), (3, b), (4, f"{prose(5, 20)} {b}")]
    got = suffix_dedup.remove_repeats(docs_of(rows)).collect()
    size = {i: len(t) for i, t in rows[:1] + rows[4:5]}
    assert sorted((x.doc_id, x.n_removed >= size[1] if x.doc_id == 2 else x.n_removed >= size[3] if x.doc_id == 4 else x.n_removed > 0) for x in got) == sorted([(1, False), (2, False), (2, True), (2, True), (3, False), (3, False), (4, True)])
    for x in got:  # a row's own bytes are hashed, and no others
        whole = {hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i == x.doc_id}
        assert (x.kept_sha256 in whole) == (x.n_removed == 0)


def test_hashes_do_not_depend_on_place():
    from relspark.llm.textvec import TILE, Hasher

    r = np.random.default_rng(9)
    word = r.integers(0, 256, 2 * TILE + 77).astype(np.uint8)
    for n in (1, 5, 300, TILE, len(word)):
        own = Hasher(word[:n])(np.array([0]), np.array([n]))
        for before in (0, 3, TILE - 2, TILE, 3 * TILE - n % TILE):
            data = np.concatenate((r.integers(0, 256, before).astype(np.uint8), word[:n], r.integers(0, 256, 9).astype(np.uint8)))
            assert Hasher(data)(np.array([before]), np.array([before + n])) == own


def test_prefix_classes_are_equal_prefixes():
    r = random.Random(5)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(20)]
    text = "\0".join(parts) + "\0"
    symbols = np.frombuffer(text.encode(), np.uint8).astype(np.int16)
    order, classes = suffix_dedup.prefix_classes(symbols, 8)
    by = {}
    for at, c in zip(order.tolist(), classes.tolist(), strict=True):
        if "\0" not in text[at : at + 8] and len(text[at : at + 8]) == 8:
            by.setdefault(c, set()).add(text[at : at + 8])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_passages(docs_of, awkward, prose):
    r = random.Random(6)
    texts = {100 + i: prose(i, r.randint(60, 400)).split() for i in range(120)}
    holds = {}
    free = sorted(texts)  # a document holds one passage, so that none parts another
    r.shuffle(free)
    for j in range(12):
        passage = prose(5000 + j, 60).split()
        for k in range(r.randint(2, 5)):
            i = free.pop()
            copy = list(passage)
            if k % 2:
                copy[20] = "altered"
                del copy[45]
            at = r.randrange(len(texts[i]))
            texts[i][at:at] = copy
            holds.setdefault(j, set()).add(i)
    shared = prose(77, 25)  # too short to matter
    rows = list(awkward) + [(i, " ".join(w) + (" " + shared if i % 3 == 0 else "")) for i, w in texts.items()]
    got = passage_dedup.shared_passages(docs_of(rows)).collect()
    found = {x.doc_id for x in got} | {x.ref_id for x in got}
    assert found == set().union(*holds.values())
    for x in got:
        assert x.ref_id < x.doc_id and x.identity >= 0.8 and x.end - x.start >= 50
        assert any({x.doc_id, x.ref_id} <= h for h in holds.values())


@pytest.mark.parametrize("pieces", [[(0, 30), (30, 60)], [(0, 45)], [(15, 60), (0, 20)]])
def test_passages_whose_parts_stand_in_earlier_documents(docs_of, prose, pieces):
    texts, wanted = {}, []
    for j in range(8):
        passage = prose(9000 + j, 60).split()
        put = lambda part: texts.__setitem__(len(texts), f"{prose(20_000 + len(texts), 40)} {' '.join(part)} {prose(30_000 + len(texts), 40)}")  # noqa: B023, E731
        for a, b in pieces:
            put(passage[a:b])
        first = len(texts)
        put(passage)
        for a, b in pieces:  # once more, so that the nearest earlier document does not hold the passage either
            put(passage[a:b])
        wanted.append((len(texts), first))
        put(passage)
    got = passage_dedup.shared_passages(docs_of(list(texts.items()))).collect()
    assert {(x.doc_id, x.ref_id) for x in got} == set(wanted)
    assert all(x.start <= 40 and x.end >= 100 for x in got)


def changed(words, places):
    return [f"changed{i}" if i in places else w for i, w in enumerate(words)]


@pytest.mark.parametrize(("n", "share"), [(60, 0.1), (60, 0.2), (100, 0.2), (200, 0.2)])
def test_changed_passages_whose_parts_stand_in_earlier_documents(docs_of, prose, n, share):
    r = random.Random(n)
    texts, wanted = [], set()
    put = lambda words: texts.append(f"{prose(40_000 + len(texts), 40)} {' '.join(words)} {prose(50_000 + len(texts), 40)}")
    for j in range(15):
        passage = prose(9500 + 100 * n + j, n).split()
        put(passage[:25])
        put(passage[25:50])
        put(passage)
        # every so many words, or anywhere but at the ends
        put(changed(passage, set(range(4, n - 2, round(1 / share))) if j % 3 == 0 else set(r.sample(range(2, n - 2), int(n * share)))))
        wanted.add((len(texts) - 1, len(texts) - 2))
    got = passage_dedup.shared_passages(docs_of(list(enumerate(texts)))).collect()
    assert {(x.doc_id, x.ref_id) for x in got} == wanted
    for x in got:
        a, b = texts[x.doc_id].split()[x.start : x.end], texts[x.ref_id].split()[x.ref_start : x.ref_end]
        assert min(len(a), len(b)) >= 50 and x.identity >= 0.8 and passage_dedup.common_words(a, b) >= x.n_equal == round(x.identity * max(len(a), len(b)))


def test_changed_copies_of_a_passage_meet_each_other(docs_of, prose):
    r = random.Random(3)
    passage = prose(77_000, 80).split()
    copies = [changed(passage, set(r.sample(range(2, 78), 8 + i % 7))) for i in range(20)]
    rows = [(i, f"{prose(60_000 + i, 30)} {' '.join(c)} {prose(70_000 + i, 30)}") for i, c in enumerate(copies)]
    got = {(x.doc_id, x.ref_id) for x in passage_dedup.shared_passages(docs_of(rows)).collect()}
    same = {(i, j): sum(a == b for a, b in zip(copies[i], copies[j], strict=True)) for i in range(20) for j in range(i)}
    assert {p for p, n in same.items() if n >= 64} <= got and len(got) > 20


def test_a_passage_of_hot_words_is_joined_with_its_first_document(docs_of, prose):
    """Its parts stand in many documents each, so no place of it is paired with all others."""
    passage = prose(81_000, 60).split()
    rows = [(i, f"{prose(82_000 + i, 20)} {' '.join(passage[:35] if i % 2 else passage[25:])} {prose(83_000 + i, 20)}") for i in range(90)]
    rows += [(i, f"{prose(82_000 + i, 20)} {' '.join(passage)} {prose(83_000 + i, 20)}") for i in (100, 101, 102)]
    got = {(x.doc_id, x.ref_id) for x in passage_dedup.shared_passages(docs_of(rows)).collect()}
    assert {(101, 100), (102, 100)} <= got


@pytest.mark.parametrize(("earlier", "later"), [(8, 8), (8, 20), (20, 8)])
def test_a_line_repeated_in_two_documents(docs_of, prose, earlier, later):
    line = prose(71, 10)
    rows = [(1, f"{prose(72, 30)} {' '.join([line] * earlier)}"), (2, f"{prose(73, 25)} {' '.join([line] * later)} {prose(74, 30)}")]
    got = passage_dedup.shared_passages(docs_of(rows)).collect()
    assert all((x.doc_id, x.ref_id, x.identity) == (2, 1, 1.0) for x in got)
    assert {w for x in got for w in range(x.start, x.end)} == set(range(25, 25 + 10 * later))
    assert max(x.end - x.start for x in got) == 10 * min(earlier, later)


def best_chain(found, gap_cost, most_gap):
    """The highest score of any chain, by trying all: an anchor may follow each earlier one that ends near and before it."""
    rows = [tuple(x) for x in found.tolist()]
    best = [0.0] * len(rows)
    for i, (s, r, n) in enumerate(rows):
        before = [best[j] - gap_cost * (s - js - jn + r - jr - jn) for j, (js, jr, jn) in enumerate(rows[:i]) if -6 <= s - js - jn <= most_gap and -6 <= r - jr - jn <= most_gap]
        best[i] = n + max([0.0, *before])
    return max(best)


def chain_score(found, chain, gap_cost, most_gap):
    s, e, r, t = chain
    inside = found[(found[:, 0] >= s) & (found[:, 0] + found[:, 2] <= e) & (found[:, 1] >= r) & (found[:, 1] + found[:, 2] <= t)]
    return best_chain(inside, gap_cost, most_gap) if len(inside) else 0.0


def test_chains_against_enumeration():
    r = random.Random(7)
    for _ in range(300):
        found = np.array(sorted((r.randrange(200), r.randrange(200), r.randint(6, 30)) for _ in range(r.randint(2, 9))))
        got = passage_dedup.chains(found, 0.05, 40)
        assert max(chain_score(found, c, 0.05, 40) for c in got) >= best_chain(found, 0.05, 40) - 1e-9
    assert (360, 420, 360, 420) in passage_dedup.chains(np.array([(0, 0, 300), (360, 360, 20), (390, 390, 30)]), 0.05, 40)
    a, b = list("abcabba"), list("cbabac")
    assert passage_dedup.common_words(a, b) == 4
    assert passage_dedup.common_words([], b) == 0 == passage_dedup.common_words(a, [])


def test_exact_passages_against_brute_force(docs_of):
    """Every run of 50 equal words that stands in an earlier document lies in a reported passage, and nothing else is reported."""
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 160))]
        for _ in range(r.randint(0, 2) if i else 0):  # pieces of earlier documents, so that passages are parted in many ways
            source = texts[r.randrange(i)]
            n = r.randint(20, 120)
            at = r.randrange(max(1, len(source) - n))
            words[(k := r.randrange(len(words))) : k] = source[at : at + n]
        texts.append(words)
    first = {}
    for i, w in enumerate(texts):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = {(i, s) for i, w in enumerate(texts) for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i}
    got = passage_dedup.shared_passages(docs_of([(i, " ".join(w)) for i, w in enumerate(texts)])).collect()
    covered = {(x.doc_id, s) for x in got for s in range(x.start, x.end - 49)}
    assert want <= covered and len(want) > 300
    for x in got:
        a, b = texts[x.doc_id][x.start : x.end], texts[x.ref_id][x.ref_start : x.ref_end]
        assert x.ref_id < x.doc_id and min(len(a), len(b)) >= 50 and x.n_equal == passage_dedup.common_words(a, b) and x.identity >= 0.8


def test_vectors(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 16))
    rows = []
    for i in range(400):
        x = base[r.integers(60)] + r.normal(size=16) * r.choice([0.0, 0.05, 0.15, 0.3])
        rows.append((i * 3, x.tolist()))
    rows += [(9000, rows[0][1]), (9001, [v * 3 for v in rows[1][1]]), (9002, rows[2][1]), (9002, rows[2][1])]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [float("inf")] * 16), (5006, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, label int, component_id string")
    got = vector_dedup.near_vectors(df, window=64, block_rows=128, block_members=16).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [i for i, _ in rows]
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = sorted((ids[a], int(near[a].sum()) - 1, root[ids[a]], root[ids[a]] == ids[a]) for a in range(len(ids)))
    linked = {i for i, _ in rows}
    assert sorted(tuple(g) for g in got if g.vec_id in linked) == want
    assert all(g.n_links == 0 and g.kept for g in got if g.vec_id not in linked)
    assert vector_dedup.near_vectors(df.limit(0)).collect() == []


def brute_links(x, copies=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [np.flatnonzero(x[lo : lo + 1000] @ x.T >= 0.95) for lo in range(0, len(x), 1000)]
    return np.concatenate([np.bincount(f // len(x), minlength=min(1000, len(x) - 1000 * k)) for k, f in enumerate(near)]) - 1


@pytest.mark.parametrize("spread", [0.05, 0.19])  # all within half the angle of a pivot; and hardly any
def test_links_of_a_group_far_beyond_the_window(spark, spread):
    r = np.random.default_rng(10)
    noise = r.normal(size=(12_000, 64)) / 8
    x = np.concatenate((r.normal(size=64) + noise * 8 * spread, r.normal(size=(1000, 64)), np.repeat(r.normal(size=(1, 64)), 30, axis=0))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(g) for g in vector_dedup.near_vectors(df).collect())
    want = brute_links(x.astype(np.float64))
    assert [g[1] for g in got] == want.tolist()
    assert want[0] > 8000  # far more than a window holds
    assert {g[2] for g in got[:12_000]} == {0} and {g[2] for g in got[13_000:]} == {13_000}


def test_ties_in_the_order(spark):
    """Vectors of equal bits in every pass, more than a window of them, with a key of one bit."""
    r = np.random.default_rng(11)
    x = np.concatenate([np.outer(np.ones(200), r.normal(size=8)) + 0.01 * r.normal(size=(200, 8)) for _ in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(g) for g in vector_dedup.near_vectors(df, window=16, bits=1, block_rows=64, block_members=32, passes=3).collect())
    assert [g[1] for g in got] == brute_links(x).tolist()
