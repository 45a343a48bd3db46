"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over 7 bytes ends a piece wherever it meets a trigger; each
piece gives one character of a signature. A fingerprint has signatures for a
block size and its double, so that texts of unlike lengths compare at the
block size that they share, by edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import small_batches

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes of the rolling hash, smallest block size, and the number of pieces to aim at.
WINDOW, SMALLEST, PIECES = 7, 3, 64
_MULTIPLIER = 0x01000193


def rolling(raw: bytes) -> np.ndarray:
    """A hash of the last WINDOW bytes at every byte of a whole text (fewer at the start), mixed so that its remainders are even."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = np.zeros(len(b), np.uint32)
    power = 1
    for k in range(min(WINDOW, len(b))):
        h[k:] += (b[: len(b) - k] + np.uint32(1)) * np.uint32(power & 0xFFFFFFFF)
        power = power * _MULTIPLIER & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _signature(raw: bytes, ends: np.ndarray) -> str:
    start, out = 0, []
    for end in [*ends.tolist(), len(raw)]:
        if end > start:
            out.append(ALPHABET[zlib.crc32(raw[start:end]) & 63])
            start = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """``size:signature:signature of the double size``. Null and empty texts give ``3::``.

    The block size is the smallest of 3 times a power of 2 that makes at most 3/2 PIECES pieces on average, halved while
    the signature has fewer than half of PIECES. No piece is dropped: a signature holds every piece of the whole text.
    """
    raw = (text or "").encode()
    size = SMALLEST
    while size * PIECES < len(raw):
        size *= 2
    h = rolling(raw)
    while True:
        ends = np.flatnonzero(h % np.uint32(size) == size - 1) + 1
        if size == SMALLEST or len(ends) >= PIECES // 2:
            break
        size //= 2
    double = np.flatnonzero(h % np.uint32(2 * size) == 2 * size - 1) + 1
    return f"{size}:{_signature(raw, ends)}:{_signature(raw, double)}"


def distance(a: str, b: str) -> int:
    """Edit distance (insertions, deletions, replacements), a column of the table at a time in the bits of whole numbers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    m = len(b)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(b):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    for c in a:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
    return score


def likeness(a: str, b: str) -> float:
    """0 to 1: the better of 1 - distance / length at the block sizes that both have; 0 where they share none.

    Signatures that share no run of 4 characters count as unlike unless they are equal: short runs meet by chance.
    """
    if a == b:
        return 1.0
    (size, one, two), (other, uno, due) = (x.split(":") for x in (a, b))
    s, o = int(size), int(other)
    pairs = [(one, uno), (two, due)] if s == o else [(two, uno)] if 2 * s == o else [(one, due)] if s == 2 * o else []
    best = 0.0
    for x, y in pairs:
        if x and y and (x == y or {x[i : i + 4] for i in range(len(x) - 3)} & {y[i : i + 4] for i in range(len(y) - 3)} or min(len(x), len(y)) < 8):
            best = max(best, 1 - distance(x, y) / max(len(x), len(y)))
    return best


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs (doc_id, text); rows repeat as in docs, other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last floor(n/4) code points replaced by the first as many (or all) of the next one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def bounds(docs: DataFrame, rows: int) -> list[int]:
    """doc_ids that cut docs into ranges of about ``rows`` rows, by approximate quantiles; their number is rows / ``rows``, at most 20,000."""
    n = docs.count()
    parts = min(20_000, max(1, -(-n // rows)))
    if parts == 1:
        return []
    cuts = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({min(int(c), (1 << 63) - 1) for c in cuts})  # the largest longs round to a double beyond them


def even_keys(n: int) -> np.ndarray:
    """n whole numbers that Spark's hash deals to n different partitions, the first to partition 0, and so on."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    x = np.arange(max(64, int(n * (np.log(n + 1) + 12))), dtype=np.uint32)
    h = turned(np.uint32(42) ^ turned(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(by)) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    at, first = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
    keys = np.arange(len(x), len(x) + n)
    keys[at] = x[first]
    return keys


def against_edited(docs: DataFrame, rows: int = 4096) -> DataFrame:
    """EDITED for each row: its fingerprint against those of its edited text and of the next document by (doc_id, text).

    Rows are dealt into ranges of doc_id, a partition each, and sorted there, one shuffle; the first document of each range goes also to
    the range before, as the last row's next (that of the first range to the last, so the order is a ring). Each task
    holds two texts at a time. Null texts are empty; rows of equal doc_id stand in the order of their texts; a single row
    is its own next. Null doc_ids stand before all others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(docs, rows)
    keys = even_keys(len(cuts) + 1).tolist()
    at = F.lit(keys[0])
    if cuts:
        place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id")))
        at = F.element_at(F.array(*[F.lit(k) for k in keys]), place + 1) if len(cuts) <= 128 else _range_of(cuts, keys)
        at = F.when(F.col("doc_id").isNull(), keys[0]).otherwise(at)
    placed = docs.withColumn("bin", at.cast("int"))
    firsts = placed.groupBy("bin").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("low")).collect()  # a row for each range
    if not firsts:
        return spark.createDataFrame([], EDITED)
    here = {r["bin"] for r in firsts}
    order = [k for k in keys if k in here]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    low = spark.createDataFrame([Row(bin=r["bin"], doc_id=r["low"], to=before[r["bin"]]) for r in firsts], "bin int, doc_id long, to int")
    heads = placed.join(F.broadcast(low), on=(placed["bin"] == low["bin"]) & placed["doc_id"].eqNullSafe(low["doc_id"])).groupBy("to").agg(F.min(F.struct(placed["doc_id"], "text")).alias("h"))
    heads = heads.select(F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"), F.col("to").alias("bin"), F.lit(1).alias("extra"))
    dealt = placed.withColumn("extra", F.lit(0)).unionByName(heads).repartition(len(keys), "bin").sortWithinPartitions("bin", "extra", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held = None  # doc_id, text, fingerprint, bin of the row whose next is not seen yet
        for batch in batches:
            out = []
            for doc_id, text, b, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mine = fingerprint(text)
                if held is not None and held[3] == b:
                    new = edited(held[1], text)
                    other = mine if new == text else held[2] if new == held[1] else fingerprint(new)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), held[2], other, likeness(held[2], other), likeness(held[2], mine)))
                held = None if extra else (doc_id, text, mine, b)
            columns = list(zip(*out, strict=True)) or [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return dealt.select("doc_id", "text", "bin", "extra").mapInArrow(run, EDITED)


def _range_of(cuts: list[int], keys: list[int]):
    """The key of the range that doc_id is in, by a vectorised search: far cheaper than a chain of conditions."""
    edges, of = np.array(cuts, np.int64), np.array(keys, np.int32)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(of[np.searchsorted(edges, ids.to_numpy(), side="right")])

    # a batch with nulls would arrive as doubles, which do not tell large doc_ids apart
    return place(F.coalesce("doc_id", F.lit(0).cast("long")))
