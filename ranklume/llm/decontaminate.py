"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every passage of every document is a query against an inverted index of the
items. Weights are shares of an item's own score, so one threshold means "this
much of the item is here". What lies above it is verified by the overlap of
the item's question and answer with the document.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, small_batches

WORDS = re.compile(r"[^\W_]+")
#: BM25's saturation and length normalisation; the most blocks of items in a shard, and the least items in a block.
K1, B, BLOCKS, LEAST = 1.2, 0.75, 128, 2
#: Half passages whose bounds are held at once.
AT_ONCE = 1024
#: Words of a shingle.
SHINGLE = 5


@dataclass
class Index:
    """Items' ids and parts. What is searched are cuts of items, whole items mostly, and ``owners`` tells whose: for each term
    its postings (cuts, weights), and the largest weight in each block of ``block`` cuts."""

    items: list[int]
    owners: list[int]
    questions: list[frozenset[tuple[str, ...]]]
    answers: list[frozenset[tuple[str, ...]]]
    lengths: list[int]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    block: int
    most: np.ndarray


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingles(found: list[str], width: int = SHINGLE) -> frozenset[tuple[str, ...]]:
    """Runs of ``width`` words; the whole sequence if it is shorter, none if empty."""
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def overlap(part: frozenset[tuple[str, ...]], near: list[str]) -> int:
    """How many of a part's runs stand in the words near a passage; a part under SHINGLE words is one shorter run."""
    return len(part & shingles(near, len(next(iter(part))))) if part else 0


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: what stands after the last question mark, or else the last sentence, answers. An item of one sentence is cut in the middle."""
    cut = text.rfind("?") + 1
    if not cut or not words(text[cut:]):
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
        cut = ends[-1] if ends else 0
    question, answer = words(text[:cut]), words(text[cut:])
    if not question or not answer:
        both = question + answer
        return both[: len(both) // 2], both[len(both) // 2 :]
    return question, answer


def index(items: list[tuple[int, str | None]], longest: int = 80) -> Index:
    """The inverted index. Items without words are never found; items of equal text are all found. An item of over ``longest``
    words is cut evenly, as no passage holds it whole; each cut has weights of its own."""
    known = [(i, t) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0])) if i is not None and words(t)]
    said = [words(t) for _, t in known]
    cuts = []
    for i, w in enumerate(said):
        n = -(-len(w) // longest)
        cuts += [(i, w[len(w) * k // n : len(w) * (k + 1) // n]) for k in range(n)]
    counts = [Counter(w) for _, w in cuts]
    sizes = [sum(c.values()) for c in counts]
    mean = sum(sizes) / max(1, len(sizes))
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log(1 + (len(cuts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    terms = {w: k + 1 for k, w in enumerate(sorted(df))}
    held: list[tuple[list[int], list[float]]] = [([], []) for _ in range(len(terms) + 1)]
    for d, (c, n) in enumerate(zip(counts, sizes, strict=True)):
        weights = {w: idf[w] * k * (K1 + 1) / (k + K1 * (1 - B + B * n / mean)) for w, k in c.items()}
        total = sum(weights.values())
        for w, x in weights.items():
            held[terms[w]][0].append(d)
            held[terms[w]][1].append(x / total)
    block = max(LEAST, -(-len(cuts) // BLOCKS))
    most = np.zeros((len(terms) + 1, -(-len(cuts) // block)), np.float32)
    for k, (ids, ws) in enumerate(held):
        for i, w in zip(ids, ws, strict=True):
            most[k, i // block] = max(most[k, i // block], w)
    split = [parts(t) for _, t in known]
    return Index([i for i, _ in known], [i for i, _ in cuts], [shingles(q) for q, _ in split], [shingles(a) for _, a in split], [len(w) for w in said], terms, held, block, most)


def search(terms: list[int], found: Index, k: int, threshold: float) -> list[tuple[int, float]]:
    """Cuts of items of block k whose score for these distinct terms is at least ``threshold``, by WAND over the block's maxima.

    Cursors stand in order of their next item; the pivot is the first where the maxima so far reach the threshold, so
    no item before it can. Only a pivot that the first cursor has reached too is scored.
    """
    low, high = k * found.block, (k + 1) * found.block
    cursors = []
    for t in terms:
        ids, weights = found.postings[t]
        at, end = bisect_left(ids, low), bisect_left(ids, high)
        if at < end:
            cursors.append([ids[at], at, end, ids, weights, float(found.most[t, k])])
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[5]
            if bound >= threshold - 1e-6:
                pivot = c[0]
                break
        if pivot is None:
            break
        score = 0.0
        scored = cursors[0][0] == pivot
        for c in cursors:
            if c[0] > pivot:
                break
            if scored:
                score += c[4][c[1]]
                c[1] += 1
            else:
                c[1] = bisect_left(c[3], pivot, c[1], c[2])
            c[0] = c[3][c[1]] if c[1] < c[2] else high
        if scored and score >= threshold - 1e-9:
            out.append((pivot, score))
        cursors = [c for c in cursors if c[0] < high]
    return out


def leaks(text: str | None, found: Index, threshold: float, size: int, whole: float, part: float) -> list[tuple[int, float, float, float, int]]:
    """(item, share of BM25 of the item or of a cut of it, question overlap, answer overlap, first word) of the items that the whole text holds.

    Passages of ``size`` words start at every half of that. The maxima of a half's distinct terms are summed for every
    block of items; where two neighbouring halves' sums stay below the threshold, no item of the block can be in their passage.
    Of the passages above the threshold the first by share that is verified counts.
    """
    said = words(text)
    n = len(said)
    if not n or not found.items:
        return []
    get, half = found.terms.get, size // 2
    ids = np.fromiter((get(w, 0) for w in said), np.int64, n)
    last = (n - 1) // half
    places_of: dict[int, dict[int, float]] = {}
    for at in range(0, max(1, last), AT_ONCE):
        low, high = at * half, min(n, (at + AT_ONCE + 1) * half)
        own = ids[low:high]
        key = np.unique((np.arange(len(own)) // half * len(found.most) + own)[own > 0])
        if not len(key):
            continue
        segment, term = np.divmod(key, len(found.most))
        count = (len(own) - 1) // half + 1
        places = np.searchsorted(segment, np.arange(count + 2))
        begun = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        bounds = np.zeros((count, found.most.shape[1]), np.float32)
        bounds[segment[begun]] = np.add.reduceat(found.most[term], begun, axis=0)
        both = bounds[:-1] + bounds[1:] if count > 1 else bounds
        for i, k in zip(*(x.tolist() for x in np.nonzero(both >= threshold - 1e-5)), strict=True):
            near = np.unique(term[places[i] : places[min(i + 2, count)]])
            for cut, score in search(near[found.most[near, k] > 0].tolist(), found, k, threshold):
                held = places_of.setdefault(found.owners[cut], {})
                held[(at + i) * half] = max(score, held.get((at + i) * half, 0.0))
    out = []
    for item, held in sorted(places_of.items()):
        reach = found.lengths[item] + SHINGLE
        q, w = found.questions[item], found.answers[item]
        for a, score in sorted(held.items(), key=lambda x: (-x[1], x[0])):
            near = said[max(0, a - reach) : a + size + reach]
            hit_q, hit_w = overlap(q, near), overlap(w, near)
            if (hit_q + hit_w) >= whole * (len(q) + len(w)) and hit_q >= part * len(q) and hit_w >= part * len(w):
                out.append((item, score, hit_q / max(1, len(q)), hit_w / max(1, len(w)), a))
                break
    return out


SCHEMA = "doc_id long, item_id long, bm25_share double, question_overlap double, answer_overlap double, passage_word long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("bm25_share", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage_word", pa.int64())])


def shards(items: DataFrame, words_each: int = 500_000, longest: int = 80) -> Iterator[Index]:
    """Indexes of parts of the items (item_id, text), each of about ``words_each`` words however many items there are; one at a time is on the driver."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * words_each)))
    for k in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield index([(r["item_id"], r["text"]) for r in some.select("item_id", "text").distinct().collect()], longest)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, size: int = 160, whole: float = 0.8, part: float = 0.5) -> DataFrame:
    """SCHEMA, a row for each document and item that it holds: all above the threshold, verified.

    Items may be of any length. At least ``whole`` of the item's five-word shingles and ``part`` of its question's and its answer's stand near the
    passage. Null and empty texts and items hold nothing; repeated rows repeat; other columns are not read. Each shard of
    items is broadcast and has a bounded size; documents are read once for each shard, and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    out = None
    for found in shards(items, longest=max(1, size // 2)):
        held = sent(docs.sparkSession, found)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held()
            for batch in batches:
                rows = [(d, own.items[i], *rest) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, *rest in leaks(t, own, threshold, size, whole, part)]
                columns = list(zip(*rows, strict=True)) or [[] for _ in _ARROW]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = some if out is None else out.unionByName(some)
    return out
