"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens get log-odds with a Dirichlet prior from a bounded sample of labelled
documents; a word takes the best of its own and those of its beginnings, so
that inflected forms count. Every maximal scoring segment is found in linear time; the E-value
of a segment follows from the Gumbel law of the best segment of clean text. A
small logistic fit turns a document's E-values into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_column, sent, small_batches

WORDS = re.compile(r"[^\W_]+")
#: Lengths of the beginnings of words that get scores, the longest first.
STEMS = (6, 5, 4)
#: Words whose scores a task keeps at hand.
MEMO = 300_000
#: The least score that a token may have of its own; weaker evidence is noise of the sample.
LEAST = 0.8


@dataclass
class Model:
    """Token scores, the score of any other token, Gumbel parameters, and the logistic fit over (bias, -log E, segments)."""

    scores: dict[str, float]
    other: float
    decay: float
    size: float
    fit: tuple[float, float, float]


def tokens(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def segments(places: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens, of which places have their own scores and the rest ``other`` < 0.

    Linear in the number of places: runs of other tokens are one negative step, and a segment begins and ends at a place.
    """
    stack: list[list[float]] = []  # start, end, left sum, right sum, and the stack index of the nearest lower left sum
    total, at = 0.0, 0
    for i, score in places:
        total += other * (i - at)
        at = i + 1
        if score <= 0:
            total += score
            continue
        now = [i, i + 1, total, total + score, -1]
        total += score
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= now[2]:
                k = int(stack[k][4])
            if k < 0 or stack[k][3] >= now[3]:
                now[4] = k
                stack.append(now)
                break
            now = [stack[k][0], now[1], stack[k][2], now[3], -1]
            del stack[k:]
            k -= 1
    return [(int(s[0]), int(s[1]), s[3] - s[2]) for s in stack]


class Scores(dict):
    """Scores of words, looked up once each; None for words without any."""

    def __init__(self, scores: dict[str, float]):
        self.known = scores

    def __missing__(self, word: str) -> float | None:
        keys = [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]
        score = max((s for k in keys if (s := self.known.get(k)) is not None), default=None)
        if len(self) >= MEMO:
            self.clear()
        self[word] = score
        return score


def passages(text: str | None, scores: Scores, other: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and segments. Every occurrence of a word scores, whatever stands before it."""
    words = tokens(text)
    places = [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s is not None]
    return len(words), segments(places, len(words), other)


def log_e(score: float, n: int, model: Model) -> float:
    """log of the expected number of segments as good as this one in n tokens of clean text."""
    return math.log(model.size * max(n, 1)) - model.decay * score


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float]:
    """-log E of the best segment (at least -5), and log1p of the number of segments with E below 0.1."""
    if not found:
        return -5.0, 0.0
    best = max(-log_e(found_[2], n, model) for found_ in found)
    return max(-5.0, min(60.0, best)), math.log1p(sum(log_e(s[2], n, model) < -2.3 for s in found))


def probability(features: tuple[float, float], model: Model) -> float:
    z = model.fit[0] + model.fit[1] * features[0] + model.fit[2] * features[1]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts with labels that may be learned: at most ``rows``, the first by a hash of doc_id. A document with several labels counts by the largest; unlabelled or null ones do not count. Copies of a text count once."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out_column(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("text").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, vocabulary: int = 20_000, least_docs: int = 3, prior: float = 100.0, z: float = 2.0) -> Model | None:
    """Learns from at most ``rows`` labelled documents (a bounded sample, broadcast by id); None where a label is missing.

    Counts are of documents that hold a token. A token's score is its log-odds less ``z`` standard errors; only tokens of
    ``least_docs`` documents that keep a positive score count, at most ``vocabulary`` of them; the model is broadcast and has
    that bound. Calibration is cross-fitted: a document's evidence comes from scores of the other half of the sample.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush():
            kept = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([c[i] for c in held.values()], pa.int64()) for i in range(4))], ["token", *COUNTS])
            held.clear()
            return kept

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(tokens(text))
                at = 2 * half(text) + (1 if y else 0)
                for w in words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k} | {""}:
                    held.setdefault(w, [0, 0, 0, 0])[at] += 1
            if len(held) > 200_000:
                yield flush()
        yield flush()

    counted = sample.mapInArrow(count, "token string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])
    seen = counted.where((F.col("bad0") + F.col("bad1") >= least_docs) | (F.col("token") == ""))
    rank = (F.col("bad0") + F.col("bad1")) / F.sqrt(F.col("clean0") + F.col("clean1") + 1.0)
    few = seen.orderBy(F.col("token") != "", F.desc(rank), "token").limit(4 * vocabulary).toPandas()
    whole = few[few.token == ""]
    if whole.empty or not (whole.clean0 + whole.clean1).iloc[0] or not (whole.bad0 + whole.bad1).iloc[0]:
        return None
    total, few = whole.iloc[0], few[few.token != ""]
    both = (few.clean0 + few.clean1, few.bad0 + few.bad1, total.clean0 + total.clean1, total.bad0 + total.bad1)
    best = lambda found: dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:vocabulary])
    scores = best(_scores(few.token, *both, prior, z))
    crossed = [best(_scores(few.token, few[f"clean{i}"], few[f"bad{i}"], total[f"clean{i}"], total[f"bad{i}"], prior, z)) for i in (1, 0)]
    other = -0.1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Scores(x) for x in crossed]
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = passages(text, memos[half(text)], other)
                out.append((y, n, sorted((s[2] for s in found), reverse=True)))
            columns = list(zip(*out, strict=True)) or [[] for _ in SCAN]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCAN, strict=True)], schema=SCAN)

    seen = sample.mapInArrow(scan, "label int, n long, found array<double>").toPandas().sort_values(["label", "n"])
    clean = seen[(seen.label == 0) & (seen.n > 0)]
    top = np.array([max(f, default=0.0) for f in clean.found])
    # The Gumbel law by two quantiles, which a few mislabelled texts don't move: q(p) = (log(size n) - log(-log p)) / decay.
    mid, high = np.quantile(top, [0.5, 0.97]) if len(top) else (0.0, 0.0)
    decay = float(np.clip((math.log(-math.log(0.5)) - math.log(-math.log(0.97))) / max(high - mid, 1e-9), 0.5, 3.0))
    size = float(np.exp(decay * mid + math.log(math.log(2)) - np.log(np.median(clean.n)))) if len(top) else 0.1
    model = Model(scores, other, decay, max(size, 1e-9), (0.0, 0.0, 0.0))
    x = np.array([evidence(n, [(0, 0, s) for s in found], model) for n, found in zip(seen.n, seen.found, strict=True)]).reshape(-1, 2)
    model.fit = _logistic(x, seen.label.to_numpy(float))
    return model


COUNTS = ("clean0", "bad0", "clean1", "bad1")


def half(text: str | None) -> int:
    """The half of the sample that a text belongs to; copies of a text share it."""
    return zlib.crc32((text or "").encode()) & 1


def _scores(token, clean, bad, n0: int, n1: int, prior: float, z: float) -> dict[str, float]:
    share = (clean + bad) / max(1, n0 + n1)
    a = np.maximum(share * prior, 0.01)
    odds = np.log((bad + a) / (n1 + prior - bad - a).clip(lower=0.01)) - np.log((clean + a) / (n0 + prior - clean - a).clip(lower=0.01))
    score = (odds - z * np.sqrt(1 / (bad + a) + 1 / (clean + a))).clip(upper=6.0)
    return {t: float(s) for t, s in zip(token, score, strict=True) if s >= LEAST}


SCAN = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.float64()))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float, float]:
    """Newton's method; the weights of evidence stay at 0 or above."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (y - p) - ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1])), float(max(0.0, w[2]))


SCHEMA = "doc_id long, score double, passages array<struct<start_word:bigint,end_word:bigint,e_value:double>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("e_value", pa.float64())])))])


def toxicity(docs: DataFrame, model: Model | None, significant: float = 0.01) -> DataFrame:
    """doc_id, score (0 to 1) and every significant passage of each row of docs (doc_id, text).

    Null and empty texts have no passage and the score of no evidence; with no model all scores are 0. Rows are
    scored one by one, so repeated rows repeat; other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = sent(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        memo = Scores(m.scores) if m else Scores({})
        for batch in batches:
            ids, scores, spans = batch.column(0).to_pylist(), [], []
            for text in batch.column(1).to_pylist():
                n, found = passages(text, memo, m.other) if m else (0, [])
                scores.append(probability(evidence(n, found, m), m) if m else 0.0)
                spans.append([{"start_word": a, "end_word": b, "e_value": math.exp(min(50.0, e))} for a, b, s in found if (e := log_e(s, n, m)) <= math.log(significant)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, ARROW.field(2).type)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCHEMA)
