"""Toxicity by a linear-chain conditional random field.

Labels are of documents, tokens have none of their own: a clean document says that each of its
tokens is clean, a toxic one that some token is toxic, without saying which. So the field's tags are
hidden, and what is maximised is the likelihood of the documents' labels: the probability that all tags
are clean, or that not all are. Emissions come from the word, its beginnings and its neighbours; every
weight (features, neighbours, transitions, start) follows the exact gradient, from the forward-backward
marginals of single tags and of pairs, under a Gaussian prior around the log odds that the features begin with.

Scoring runs forward-backward over every whole text: the marginals give the offending
offsets, and a logistic fit on training documents turns them into the document's score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relspark.llm.columns import fresh, id_and_text
from relspark.llm.textvec import ALPHANUMERIC, Words, blocks, mix

#: Bytes of the beginnings of words that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)


def _feature_hashes(words: Words) -> list[np.ndarray]:
    """For every token its whole word and its beginnings; a word shorter than a beginning has none (0)."""
    out = [words.hashes ^ np.uint64(0x5BD1E995)]
    for n in BEGINNINGS:
        long = words.ends - words.starts >= n
        h = np.zeros(len(words.hashes), np.uint64)
        h[long] = words.hasher(words.starts[long], words.starts[long] + n)
        out.append(h ^ np.uint64(n))
    return out


@dataclass
class Model:
    """keys and weights: features sorted by hash; the rest are the field's and the document fit's parameters."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    near: float  # weight of a neighbour's features
    stay: tuple[float, float]  # transitions to the same tag, clean and toxic
    first: float  # toxic at the start of a text
    fit: tuple[float, float, float]

    def evidence(self, words: Words) -> np.ndarray:
        """Each token's own evidence: the sum of its features' weights."""
        token, feature = self.hits(words)
        return np.bincount(token, self.weights[feature], len(words.hashes))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature) of every feature that a token has."""
        tokens, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        maybe = np.zeros(1 << 18, bool)
        maybe[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        for h in _feature_hashes(words) if len(self.keys) else ():
            at = np.flatnonzero(maybe[(h >> np.uint64(46)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[k] == h[at]
            tokens.append(at[hit])
            features.append(k[hit])
        return np.concatenate(tokens), np.concatenate(features)

    def judge(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Every token's marginal, and every text's score."""
        p = marginals(_emissions(self.evidence(words), words.bounds, self.bias, self.near), words.bounds, self.stay, self.first)
        return p, _score(self.fit, *_summaries(p, words.bounds))


def _emissions(own: np.ndarray, bounds: np.ndarray, bias: float, near: float) -> np.ndarray:
    """Log odds of toxic from a token and its neighbours within the text."""
    out = own + bias
    if len(own) > 1:
        same = np.ones(len(own), bool)
        same[bounds[(bounds > 0) & (bounds < len(own))]] = False
        out[1:] += near * own[:-1] * same[1:]
        out[:-1] += near * own[1:] * same[1:]
    return out


def _onward(x: np.ndarray, stay: tuple[float, float]) -> np.ndarray:
    """Log odds of the next tag, from the log odds of this one and the transitions."""
    return np.logaddexp(0, x + stay[1]) - np.logaddexp(stay[0], x)


def _messages(emission: np.ndarray, bounds: np.ndarray, stay: tuple[float, float], first: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages (the token's emission included) and backward ones of all texts of a block at once, as log odds of toxic.

    A step is one expression over all texts that are that long. Texts come in order of length, so those
    still running are a prefix.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, length = bounds[:-1][order], n[order]
    forward = np.empty(len(emission))
    backward = np.empty(len(emission))
    longest = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(longest), side="left")  # texts longer than t
    x = np.empty(0)
    for t in range(longest):
        at = start[: running[t]] + t
        x = emission[at] + (first if t == 0 else _onward(x[: len(at)], stay))
        forward[at] = x
    last = start + length - 1
    y = np.zeros(len(start))
    for t in range(longest):
        at = last[: running[t]] - t
        y = _onward(y[: len(at)] + emission[at + 1], stay) if t else y[: len(at)]
        backward[at] = y
    return forward, backward


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def marginals(emission: np.ndarray, bounds: np.ndarray, stay: tuple[float, float], first: float) -> np.ndarray:
    """Probability of toxic for every token, by forward-backward."""
    forward, backward = _messages(emission, bounds, stay, first)
    return _probability(forward + backward)


@dataclass
class Sample:
    """Training documents: bounds of their tokens, their labels, and which tokens have which features."""

    bounds: np.ndarray
    labels: np.ndarray
    token: np.ndarray
    feature: np.ndarray
    n_features: int


def log_likelihood(theta: np.ndarray, sample: Sample) -> tuple[float, np.ndarray]:
    """Log likelihood of the documents' labels and its gradient. theta: features' weights, then bias, weight of
    neighbours, transitions clean to clean and toxic to toxic, start.

    With P the probability that all tags are clean, a label's gradient is the expectation of each
    count over all tags, less the count when all are clean, times -1 for a clean document and P / (1 - P) for a toxic one.
    """
    weights, (bias, near, stay0, stay1, first) = theta[: sample.n_features], theta[sample.n_features :]
    bounds, n = sample.bounds, int(sample.bounds[-1])
    own = np.bincount(sample.token, weights[sample.feature], n)
    inner = np.ones(max(0, n - 1), bool)  # token and the next one are of one text
    edges = bounds[1:-1]
    inner[edges[(edges > 0) & (edges < n)] - 1] = False
    around = np.zeros(n)
    around[1:] += own[:-1] * inner
    around[:-1] += own[1:] * inner
    emission = own + bias + near * around
    x, y = _messages(emission, bounds, (stay0, stay1), first)
    full = np.flatnonzero(np.diff(bounds) > 0)
    starts, ends = bounds[full], bounds[full + 1]
    # log P: what the clean path weighs, less the sum over all paths
    steps = stay0 - np.logaddexp(stay0, x)
    steps[ends - 1] = -np.logaddexp(0, x[ends - 1])
    log_p = np.add.reduceat(steps, starts) if len(full) else np.zeros(0)
    log_p = np.minimum(log_p, -1e-12)
    label = sample.labels[full].astype(bool)
    value = float(log_p[~label].sum() + np.log(-np.expm1(log_p[label])).sum())
    times = np.where(label, np.exp(log_p) / -np.expm1(log_p), -1.0)
    of = np.repeat(times, ends - starts)
    p = _probability(x + y) * of
    ahead = emission[1:] + y[1:]
    top = np.maximum(np.maximum(stay0, ahead), np.maximum(x[:-1], x[:-1] + stay1 + ahead))
    clean, toxic = np.exp(stay0 - top), np.exp(x[:-1] + stay1 + ahead - top)
    whole = clean + toxic + np.exp(ahead - top) + np.exp(x[:-1] - top)
    p_near = np.zeros(n)
    p_near[1:] += p[:-1] * inner
    p_near[:-1] += p[1:] * inner
    gradient = np.bincount(sample.feature, (p + near * p_near)[sample.token], sample.n_features)
    both = of[:-1] * inner
    return value, np.concatenate((gradient, [p.sum(), p @ around, ((clean / whole - 1) * both).sum(), (toxic / whole * both).sum(), p[starts].sum()]))


def _fitted(samples: list[Sample], begin: np.ndarray, prior: float, rounds: int) -> np.ndarray:
    """theta that ascends the likelihood under a Gaussian prior around ``begin``, by Adam steps over all samples."""
    theta, mean, square = begin.copy(), np.zeros(len(begin)), np.zeros(len(begin))
    best, found = -np.inf, begin
    for r in range(1, rounds + 1):
        value, g = -prior / 2 * float(((theta - begin) ** 2).sum()), -prior * (theta - begin)
        for sample in samples:
            own, slope = log_likelihood(theta, sample)
            value, g = value + own, g + slope
        if value > best:
            best, found = value, theta.copy()
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + 0.15 * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
    return found


def _summaries(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the highest marginal and the expected number of toxic tokens."""
    high, total = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        high[full] = np.maximum.reduceat(p, bounds[full])
        total[full] = np.add.reduceat(p, bounds[full])
    return high, total


def _score(fit: tuple[float, float, float], high: np.ndarray, total: np.ndarray) -> np.ndarray:
    return _probability(fit[0] + fit[1] * high + fit[2] * np.log1p(total))


def _ascend(columns: np.ndarray, labels: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge."""
    w = np.zeros(columns.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
        gradient = columns.T @ (labels - p) - ridge * len(labels) * w
        curve = (columns * (p * (1 - p))[:, None]).T @ columns + ridge * len(labels) * np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return w


def train(texts: list[str], labels: np.ndarray, *, least_places: int = 5, least_odds: float = 3.0, most_features: int = 20_000, prior: float = 1.0, rounds: int = 25) -> Model:
    """Fits the field to documents and their labels (0 or 1). Features are words and beginnings of words that stand between
    ``least_places`` different neighbours in toxic documents and there with log odds of ``least_odds``: the
    ``most_features`` that stand most often."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, 0.0, (0.0, 0.0), 0.0, (-4.0 if not labels.any() else 0.0, 0.0, 0.0))
    if not len(texts) or not labels.any() or labels.all():
        return empty
    # texts of about one length together, for a block takes as many steps as its longest has tokens
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    texts, labels = [texts[i] for i in order], labels[order]
    parts = [Words(data, offsets, ALPHANUMERIC) for _, _, data, offsets in blocks(pa.array(texts, pa.large_string()), 2 << 20)]
    # between how many different neighbours each feature stands in toxic and in other documents: copies add nothing
    of_text = np.split(labels, np.cumsum([len(w.bounds) - 1 for w in parts])[:-1])
    keys, in_toxic, in_other = [], [], []
    for kind in range(1 + len(BEGINNINGS)):  # one kind of feature at a time, to hold a fifth of them at once
        feature, between = [], []
        for words, mine in zip(parts, of_text, strict=True):
            h = np.concatenate(([0], words.hashes, [0])).astype(np.uint64)
            feature.append(_feature_hashes(words)[kind])
            between.append(mix(h[:-2] * np.uint64(31) + h[2:]) << np.uint64(1) | np.repeat(mine, np.diff(words.bounds)).astype(np.uint64))
        feature, between = np.concatenate(feature), np.concatenate(between)
        order = np.lexsort((between, feature))
        feature, between = feature[order], between[order]
        new = np.concatenate(([True], (np.diff(feature) != 0) | (np.diff(between) != 0))) if len(feature) else np.zeros(0, bool)
        feature, toxic = feature[new], (between[new] & np.uint64(1)).astype(np.int64)
        own, inverse = np.unique(feature, return_inverse=True)
        keys.append(own)
        in_toxic.append(np.bincount(inverse, toxic, len(own)))
        in_other.append(np.bincount(inverse, 1 - toxic, len(own)))
    keys, in_toxic, in_other = np.concatenate(keys), np.concatenate(in_toxic), np.concatenate(in_other)
    by_key = np.argsort(keys)
    keys, in_toxic, in_other = keys[by_key], in_toxic[by_key], in_other[by_key]
    odds = np.log((in_toxic + 0.5) / (in_toxic.sum() + 1)) - np.log((in_other + 0.5) / (in_other.sum() + 1))
    chosen = np.flatnonzero((in_toxic >= least_places) & (odds >= least_odds))
    chosen = chosen[np.argsort(-in_toxic[chosen], kind="stable")[:most_features]]
    chosen.sort()
    if not len(chosen):
        return empty
    model = Model(keys[chosen], odds[chosen], -6.0, 0.0, (1.0, 0.0), -1.0, (0.0, 0.0, 0.0))
    samples = [Sample(w.bounds, mine, *model.hits(w), len(chosen)) for w, mine in zip(parts, of_text, strict=True)]
    del parts, keys, in_toxic, in_other
    theta = _fitted(samples, np.concatenate((odds[chosen], [-6.0, 0.05, 1.0, 0.0, -1.0])), prior, rounds)
    model.weights = theta[: len(chosen)]
    model.bias, model.near, model.first, model.stay = float(theta[-5]), float(theta[-4]), float(theta[-1]), (float(theta[-3]), float(theta[-2]))
    own = [np.bincount(x.token, model.weights[x.feature], int(x.bounds[-1])) for x in samples]
    high, total = (np.concatenate(c) for c in zip(*[_summaries(marginals(_emissions(o, x.bounds, model.bias, model.near), x.bounds, model.stay, model.first), x.bounds) for o, x in zip(own, samples, strict=True)], strict=True))
    model.fit = tuple(float(x) for x in _ascend(np.stack([np.ones(len(high)), high, np.log1p(total)], axis=1), labels.astype(float)))
    return model


def is_held_out(id_column, folds: int = 5):
    """Whether crc32 of the id as text leaves no remainder; null ids are not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_on_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, sample_bytes: int = 16 << 20, sample_text_bytes: int = 1 << 16) -> Model:
    """Trains on at most ``sample_rows`` labelled documents outside the held-out fold, half of them toxic where there
    are as many, of ``sample_bytes`` in all and ``sample_text_bytes`` each. They are the first ones in the order of a hash of
    their id, among the first ``2 * sample_rows`` labels; longer ones are passed over. Null labels are left out; of
    several rows of one id the shortest text is taken."""
    mine = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~is_held_out(F.col("doc_id")))
    picked: dict[object, int] = {}
    for side in (0, 1):
        for r in mine.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect():  # bounded by sample_rows
            picked[r.doc_id] = int(r.toxic)
    if not picked:
        return train([], np.zeros(0, np.int64))
    spark, kind = docs.sparkSession, mine.schema["doc_id"].dataType.simpleString()
    rows = id_and_text(docs, id_col, text_col)
    asked = spark.createDataFrame([(k,) for k in sorted(picked)], f"doc_id {kind}")
    sized = rows.join(F.broadcast(asked), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_hash"))).alias("x"))
    left, chosen, quota = sample_bytes, [], {0: sample_rows // 2, 1: sample_rows // 2}
    for r in sorted(sized.select("doc_id", "x.*").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):  # a row for each label asked for at most
        if r.size <= min(left, sample_text_bytes) and quota[picked[r.doc_id]]:
            chosen.append((r.doc_id, r.text_hash))
            left -= r.size
            quota[picked[r.doc_id]] -= 1
    if not chosen:
        return train([], np.zeros(0, np.int64))
    wanted = spark.createDataFrame(chosen, f"doc_id {kind}, text_hash bigint")
    texts = rows.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text").toArrow()  # bounded by sample_bytes
    texts = sorted(zip(texts.column(0).to_pylist(), texts.column(1).to_pylist(), strict=True))
    return train([t for _, t in texts], np.array([picked[i] for i, _ in texts], np.int64))


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", span_odds: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted, spans (byte offsets of tokens tagged toxic, end exclusive).

    The score depends on the text alone. Null and empty texts get the score of a text without toxic tokens;
    repeated rows are scored each; an empty table gives an empty result; other columns are not read. One pass.
    """
    docs = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo, hi, data, offsets in blocks(b.column(1), 4 << 20):
                words = Words(data, offsets, ALPHANUMERIC)
                p, scores = model.judge(words)
                tagged = np.flatnonzero(p >= span_odds)
                text = np.searchsorted(words.bounds, tagged, side="right") - 1
                spans: list[list] = [[] for _ in range(hi - lo)]
                for t, s, e in zip(text.tolist(), (words.starts[tagged] - offsets[text]).tolist(), (words.ends[tagged] - offsets[text]).tolist(), strict=True):
                    spans[t].append({"start": s, "end": e})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scores), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(score, f"doc_id {kind}, score double, spans array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they are. Null and empty texts score as
    texts without toxic tokens, repeated rows are judged each, an empty table stays empty."""
    name = fresh(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        model, out = shared.value, []
        for _, _, data, offsets in blocks(pa.array(texts.fillna(""), pa.large_string()), 4 << 20):
            out.append(model.judge(Words(data, offsets, ALPHANUMERIC))[1])
        import pandas as pd

        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, scored(docs[text_col].cast("string"))).where(F.col(name) < threshold).drop(name)
