"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a shallow tree over
its bins to that feature's lookup table; then the pairs that explain most of
what is left get tables over both features' bins. A score is a sum of table
entries, added for whole batches at once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, small_batches
from .toxicity import labelled_sample

#: What a text is described by. All are shares or logarithms and need no other column.
FEATURES = ("log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "marks", "odd_marks", "marks_at_end", "one_letter", "repeated_lines", "line_words", "packed", "sentence_words", "repeated_pairs", "long_words")
MARK = re.compile(r"[^\w\s]")
ODD = re.compile(r"[#$%&*|!<>{}\[\]\\^~=_+@]")
STOPS = re.compile(r"[.!?]+(?:\s|$)")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; those of null and empty texts are all 0."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    marks = len(MARK.findall(text))
    odd = len(ODD.findall(text))
    raw = text.encode()
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    return [
        math.log1p(n),
        (len(text) - text.count(" ")) / n,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        upper / n,
        sum(text.count(d) for d in "0123456789") / chars,
        marks / chars,
        odd / chars,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(len(w) == 1 for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / len(raw),
        math.log1p(n / (1 + len(STOPS.findall(text)))),
        1 - pairs / max(1, n - 1),
        sum(len(w) > 15 for w in words) / n,
    ]


@dataclass
class Model:
    """Bin edges and table of each feature, tables of pairs, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]) if len(x) else np.zeros((0, len(edges)), int)


def score(bins: np.ndarray, model: Model) -> np.ndarray:
    """Probabilities, by additions of table entries."""
    total = np.full(len(bins), model.base)
    for j, t in enumerate(model.tables):
        total += t[bins[:, j]]
    for a, b, t in model.pairs:
        total += t[bins[:, a], bins[:, b]]
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _tree(slope: np.ndarray, curve: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Best-first splits of the bins into at most ``leaves`` ranges: a value for each bin."""
    parts = [(0, len(slope))]
    a, b = np.concatenate([[0], np.cumsum(slope)]), np.concatenate([[0], np.cumsum(curve)])
    gain = lambda lo, hi: (a[hi] - a[lo]) ** 2 / (b[hi] - b[lo] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            cuts = np.arange(p[0] + 1, p[1])
            if len(cuts):
                g = (a[cuts] - a[p[0]]) ** 2 / (b[cuts] - b[p[0]] + ridge) + (a[p[1]] - a[cuts]) ** 2 / (b[p[1]] - b[cuts] + ridge) - gain(*p)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), p, int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(slope))
    for lo, hi in parts:
        out[lo:hi] = (a[hi] - a[lo]) / (b[hi] - b[lo] + ridge)
    return out


def boosted(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, ridge: float = 5.0) -> Model:
    """The model of features x (rows by FEATURES) and labels y."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = binned(x, edges)
    sizes = [len(e) + 1 for e in edges]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(edges, [np.zeros(s) for s in sizes], [], math.log(share / (1 - share)))
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s), 4, ridge)
            model.tables[j] += step
            total += step[b[:, j]]
    # pairs by what one table over coarse bins would gain on the rest
    coarse = [np.arange(s) * pair_bins // s for s in sizes]
    p = 1 / (1 + np.exp(-total))
    gains = []
    for i in range(len(sizes)):
        for j in range(i):
            cell = coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]
            g, h = np.bincount(cell, y - p, pair_bins**2), np.bincount(cell, p * (1 - p), pair_bins**2)
            gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((i, j, np.zeros((sizes[i], sizes[j]))))
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            p = 1 / (1 + np.exp(-total))
            cell = coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]
            g, h = np.bincount(cell, y - p, pair_bins**2), np.bincount(cell, p * (1 - p), pair_bins**2)
            step = (rate * g / (h + ridge)).reshape(pair_bins, pair_bins)[coarse[i]][:, coarse[j]]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000) -> Model | None:
    """Learns from at most ``rows`` labelled documents (a bounded sample); only their FEATURES come to the driver. None where nothing is labelled."""
    small_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    seen = labelled_sample(docs, labels, label, rows).mapInArrow(describe, "label int, x array<double>").toPandas()
    if seen.empty:
        return None
    order = np.lexsort(tuple(np.stack(seen.x.to_numpy()).T))  # as the rows' order is not given
    return boosted(np.stack(seen.x.to_numpy())[order], seen.label.to_numpy(float)[order])


SCHEMA = "doc_id long, score double"


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text).

    Null and empty texts are scored by features of 0; with no model all scores are 0.5. Rows are scored one by one:
    repeated rows repeat, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = score(binned(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)), m.edges), m) if m else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
