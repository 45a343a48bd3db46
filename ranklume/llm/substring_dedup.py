"""Substring dedup: spans of words that stand in an earlier document.

``remove_reference_spans`` streams documents through suffix automata of
reference shards, which are broadcast one at a time: the form for references of
a stated size. A corpus against itself has no such bound: every document would
stream through every shard of the corpus, which grows with its square. There
``dedup`` samples each window's minimal word run as an anchor, drops anchors of
one document, and compares windows only where anchors repeat; the result is
that of comparing all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, small_batches, staged

#: Words of an anchor; bits of a position in its sorting key; odd multiplier of the polynomial hash.
ANCHOR, PLACE, ODD = 8, 32, 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; none for null and empty texts."""
    return (text or "").encode().split()


def hashed(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        m = max(1 << 15, 2 * n)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.r_[np.uint64(1), np.full(m, ODD, np.uint64)])
            _POWERS["down"] = np.cumprod(np.r_[np.uint64(1), np.full(m, pow(ODD, -1, 1 << 64), np.uint64)])
    return _POWERS["up"], _POWERS["down"]


class Runs:
    """Hashes of any run of a document's words, from sums of word hashes times powers, modulo 2 to the 64."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[stop] - self.sums[start]) * self.down[start]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])


def anchored(runs: Runs, n: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that share their anchor: first window, number of windows, the anchor's hash, the hash of all their words.

    A window's anchor is its run of ANCHOR words of the least hash, the leftmost of equal ones. It follows from the window's
    words alone, so equal windows have equal anchors at equal places.
    """
    starts = np.arange(n - ANCHOR + 1)
    grams = runs(starts, starts + ANCHOR)
    key = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | starts.astype(np.uint64)
    at = (sliding_min(key, window - ANCHOR + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    place = at[first]
    context = runs(first, first + count + window - 1) ^ ((place - first).astype(np.uint64) * np.uint64(ODD))
    return first, count, grams[place], context


#: Rows of a batch that a task hands back; what it holds at once is a few documents' rows more.
ROWS = 50_000


def _fields(lists: pa.ListArray, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The fields of each row's array of structs, as slices of flat arrays; empty for null rows."""
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))])
    flat = lists.flatten()
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield tuple(f[a:b] for f in fields)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, .. count of each, one after another."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """Columns of arrays, a list of one array for each document."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), kind) for x, kind in columns.values()], list(columns))


def _known(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, the hash that tells the rows of a doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """A row for each run of windows (see anchored) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "first", "count", "anchor", "context")}
            for doc_id, text, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                if doc_id is None or len(words) < window:
                    continue
                first, count, anchor, context = anchored(Runs(hashed(words)), len(words), window)
                for k, v in zip(out, (np.full(len(first), row), np.full(len(first), doc_id), first, count, anchor.view(np.int64), context.view(np.int64)), strict=True):
                    out[k].append(v)
            kinds = dict(zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))
            yield _batch({k: ([x.astype(kinds[k].to_pandas_dtype()) for x in v], kinds[k]) for k, v in out.items()})

    return docs.mapInArrow(run, "row long, doc_id long, first int, count int, anchor long, context long")


def windows(rows: DataFrame, window: int) -> DataFrame:
    """rows (doc_id, text, row, spans of runs): a row for each window of the runs, by the anchor's and the window's hash."""

    names = ("row", "doc_id", "first", "anchor", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            held = 0
            for doc_id, text, row, (start, count, anchor) in zip(*(batch.column(i).to_pylist() for i in range(3)), _fields(batch.column(3), "first", "count", "anchor"), strict=True):
                first = spread(start, count)
                hit = Runs(hashed(words_of(text)))(first, first + window).view(np.int64)
                for k, v in zip(names, (np.full(len(first), row), np.full(len(first), doc_id), first.astype(np.int32), np.repeat(anchor, count), hit), strict=True):
                    out[k].append(v)
                held += len(first)
                if held >= ROWS:
                    yield _batch({k: (v, pa.int32() if k == "first" else pa.int64()) for k, v in out.items()})
                    out, held = {k: [] for k in names}, 0
            yield _batch({k: (v, pa.int32() if k == "first" else pa.int64()) for k, v in out.items()})

    return rows.mapInArrow(run, "row long, doc_id long, first int, anchor long, window long")


def kept_words(words: list[bytes], first: np.ndarray, count: np.ndarray, window: int) -> list[bytes]:
    """Words that no window of the spans (first window, number of windows) covers."""
    if not len(first):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + window - 1, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def dedup(docs: DataFrame, window: int = 50, texts: bool = True) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text): words of windows that also start in a document of a smaller doc_id are removed.

    ``kept`` (null unless ``texts``) has the kept words joined by spaces. Texts under ``window`` words, null and empty ones
    and rows without doc_id keep all. Rows of one doc_id are one document as regards its windows and are cleaned each;
    other columns are not read. Windows repeated within one document only are kept.

    Shuffles hold an anchor in about (window - ANCHOR) / 2 words, then windows near anchors of several documents only.
    Minima are pre-aggregated; joins back to hot anchors read written tables on both sides, so that their partitions split.
    """
    small_batches(docs.sparkSession)
    docs = _known(docs)
    found, _ = staged(anchors(docs, window), "anchors")
    # anchors of several documents; ambiguous if their surroundings differ
    seen = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("context").alias("c0"), F.max("context").alias("c1"))
    shared, _ = staged(seen.where("low < high").select("anchor", (F.col("c0") != F.col("c1")).alias("ambiguous")), "anchors-shared")
    runs, _ = staged(found.join(shared.hint("merge"), "anchor"), "anchors-kept")
    # equal surroundings: all windows of the run also start in the earliest document
    lows, _ = staged(runs.groupBy("anchor", "context").agg(F.min("doc_id").alias("low")), "contexts")
    judged, _ = staged(runs.join(lows.hint("merge"), ["anchor", "context"]), "runs-judged")
    whole = judged.where("doc_id > low").select("doc_id", "row", "first", "count")
    # other runs: the earliest one of each surroundings gives its windows
    part = judged.where("doc_id = low and ambiguous").groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "count", "anchor")).alias("spans"))
    part, _ = staged(part, "runs-open")
    rows = docs.join(part.hint("merge"), ["doc_id", "row"]).select("doc_id", "text", "row", "spans")
    each, _ = staged(windows(rows, window), "windows")
    earliest, _ = staged(each.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "windows-low")
    single = each.join(earliest.hint("merge"), ["anchor", "window"]).where("doc_id > low").select("doc_id", "row", "first", F.lit(1).alias("count"))
    spans, _ = staged(whole.unionByName(single).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "count")).alias("spans")), "spans")
    # a copy's row may repeat, its spans do not: they are one row for each hash
    cleaned = docs.join(spans.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, (first, count) in zip(*(batch.column(i).to_pylist() for i in range(2)), _fields(batch.column(2), "first", "count"), strict=True):
                words = words_of(text)
                kept = kept_words(words, first, count, window)
                line = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode() if texts else None))
            columns = list(zip(*out, strict=True)) or [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return cleaned.mapInArrow(run, SCHEMA)


class Automaton:
    """A suffix automaton over words of several passages: each word extends the last state, passages are kept apart by starting anew."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matching(self, words: list[bytes]) -> list[int]:
        """Matching statistics: the longest run that ends at each word and stands in a passage."""
        state, length, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                length = 0
            out.append(length)
        return out


def remove_reference_spans(docs: DataFrame, references: DataFrame, window: int = 50, shard_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept: docs without spans of at least ``window`` words that stand in a reference text.

    References (text) are read in shards of about ``shard_words`` words, each one automaton of bounded size, broadcast one
    at a time; documents are streamed through it for their matching statistics, and the maximal spans of all shards are
    removed together. Null and empty texts keep all; docs' rows stay as many as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = references.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * shard_words)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text").alias("also"))
    kind = "row long, also long, spans array<struct<first:int,count:int>>"
    found = spark.createDataFrame([], kind)
    for k in range(n):
        automaton = Automaton()
        for r in references.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("text").distinct().collect():
            automaton.add(words_of(r["text"]))
        held = sent(spark, automaton)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held()
            for batch in batches:
                spans = []
                for text in batch.column(2).to_pylist():
                    ends = own.matching(words_of(text))
                    spans.append([{"first": i + 1 - m, "count": m - window + 1} for i, m in enumerate(ends) if m >= window and (i + 1 == len(ends) or ends[i + 1] <= m)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())])))], ["row", "also", "spans"])

        # written, so that the next automaton does not live beside this one
        some, _ = staged(docs.select("row", "also", "text").mapInArrow(run, kind).where(F.size("spans") > 0), "reference-spans")
        found = found.unionByName(some)
    every = found.groupBy("row", "also").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    rows = docs.join(every.hint("merge"), ["row", "also"], "left").select("doc_id", "text", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, (first, count) in zip(*(batch.column(i).to_pylist() for i in range(2)), _fields(batch.column(2), "first", "count"), strict=True):
                words = words_of(text)
                kept = kept_words(words, first, count, window)
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept string")
