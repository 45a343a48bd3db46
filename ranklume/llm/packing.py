"""Best-fit packing by a configuration linear program over the length histogram.

Multiplicative weights price lengths, a knapsack over token counts finds the
best configurations at those prices, and their mixture is rounded down to
whole sequences; what rounding leaves is solved again, and what is left at
last is packed greedily. Pieces then find their places by rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, staged

#: Times that the linear program is solved, each time for what rounding has left.
TURNS = 4
#: How far below the best a configuration's price may be: while prices form, and at most while the mixture does.
NEAR, SLACK = 0.05, 0.01
#: The part of the pieces that a turn of the mixture has to move to go on at the same slack; weight of the lengths' shares in first prices.
LEAST, TIE = 0.005, 1e-3
#: The part of the pieces from which on a length is hot.
HOT = 0.01
#: Words, and cores of words, whose ids a task keeps at hand: the first it meets, so mostly the frequent ones.
MEMO = 400_000
#: White space that Python or the tokenizer, but not both for sure, splits at.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
PLAIN_SPACE = re.compile("[ \t\n\r\f\v]+")
#: Marks that make one run of their own after a core of letters; letters that normalisation only lower-cases.
MARKS = ".,;:!?$%&*#|)"
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")


#: How a tokenizer has to cut texts for its words to be encoded apart.
NORMAL, CUTS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_spaces(said: dict) -> bool:
    """Whether a tokenizer's description lower-cases, cuts at white space and between letters and marks, and knows no other rule."""
    kinds = lambda part, key: [x["type"] for x in ((said.get(part) or {}).get(key) or [])]
    if kinds("normalizer", "normalizers") != NORMAL or kinds("pre_tokenizer", "pretokenizers") != CUTS:
        return False
    split, model = said["pre_tokenizer"]["pretokenizers"][0], said["model"]
    return split["pattern"] == {"Regex": RUNS} and model["type"] == "BPE" and not model["ignore_merges"] and not model["byte_fallback"] and not said["post_processor"]


class Words(dict):
    """The id bytes of words between white space. A tokenizer that cuts there and between letters and marks joins nothing across,
    so a word of letters and final marks is encoded by the model alone, in two parts; any other by the whole tokenizer.
    Texts of any other tokenizer are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.shown = {b: b if b in plain else next(other) for b in range(256)}  # the characters that stand for bytes
        self.cores: dict[str, bytes] = {}

    def core(self, part: str) -> bytes:
        found = self.cores.get(part)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.shown))]).tobytes()
            if len(self.cores) < MEMO:
                self.cores[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core and (core.isascii() and core.isalpha() or LETTERS.fullmatch(core)):
            found = self.core(core.lower())
            if len(core) < len(word):
                found += self.core(word[len(core) :])
        else:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) < MEMO:
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, PLAIN_SPACE.split(text) if ODD_SPACE.search(text) else text.split()))


_WORDS: dict[str, Words] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, stop: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids and a stop id, those over ``size`` cut. Null texts are empty: the stop id alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _WORDS.get(tokenizer) or _WORDS.setdefault(tokenizer, Words(tokenizer))
        end = np.array([stop], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = words.ids(text or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass
class Plan:
    """Configurations (how many pieces of each length) with the number of sequences of each, the bound that prices prove, and the pieces that the linear program placed."""

    configurations: list[tuple[dict[int, int], int]]
    bound: float
    mixed: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


class Pricing:
    """The knapsack over token counts at the prices of lengths (ascending), no more pieces of a length than ``counts`` has.

    One table serves all columns: ``value[j]`` is the best price of a configuration whose longest piece is j, and
    ``column(j)`` that configuration; of equal ones that of longer pieces, if asked. ``top`` is the best price of all.
    """

    def __init__(self, price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int, longer: bool = False):
        self.lengths, self.size = lengths.tolist(), size
        self.items: list[tuple[int, int]] = []  # 1, 2, 4, .. and the rest of a length's other pieces make every number of them; one piece is last
        self.final, self.value = [], np.zeros(len(lengths))
        most = np.minimum(counts, size // lengths).tolist()
        for j, held in enumerate(most):
            left, step = held - 1, 1
            while left > 0:
                self.items.append((j, min(step, left)))
                left, step = left - step, 2 * step
            self.final.append(len(self.items))
            self.items.append((j, 1))
        best = np.zeros(size + 1)
        self.last = np.full((len(self.items) + 1, size + 1), -1, np.int16)  # by items so far and tokens: the last item that is taken
        for i, (j, k) in enumerate(self.items):
            if i == self.final[j]:
                self.value[j] = price[j] + best[size - self.lengths[j]]
            held = k * self.lengths[j]
            new = best[: size + 1 - held] + k * price[j]
            better = new > best[held:] + (-1e-12 if longer else 1e-12)
            self.last[i + 1] = self.last[i]
            self.last[i + 1, held:][better] = i
            best[held:] = np.where(better, new, best[held:])
        self.top = float(best[size])

    def column(self, j: int, room: int | None = None) -> dict[int, int]:
        """j as the longest piece and the best pieces for what it leaves of the room, a whole sequence by default."""
        found, i, room = {j: 1}, self.final[j], (self.size if room is None else room) - self.lengths[j]
        while (i := int(self.last[i, room])) >= 0:
            k, n = self.items[i]
            found[k] = found.get(k, 0) + n
            room -= n * self.lengths[k]
        return found


def _first_prices(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Prices under which no configuration is worth over 1, and what they prove: a length's share of a sequence, or that share
    stepped at thirds, quarters, .. where this proves more. A little of the share itself settles ties for fuller configurations of fewer pieces."""
    share = lengths / size
    best, bound = share, float(share @ counts)
    for k in range(1, 12):
        stepped = np.where((k + 1) * lengths % size == 0, share, (k + 1) * lengths // size / k)
        if float(stepped @ counts) > bound * (1 + 1e-6):
            best, bound = stepped, float(stepped @ counts)
    return (1 - TIE) * best + TIE * share - 1e-6, bound


def prices(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int, rate: float) -> tuple[np.ndarray, float]:
    """Prices of lengths by multiplicative weights, such that no configuration is worth over 1, and the bound that they prove.

    In each round the configurations that are nearly the best at the present prices are mixed until their lengths' shares
    of the round are used up; then a length's price grows by what the mixture so far lacks of it. The round of the best bound counts.
    """
    start, bound = _first_prices(lengths, counts, size)
    best, weight, load = start, np.ones(len(lengths)), np.zeros(len(lengths))
    for t in range(1, rounds + 1):
        price = start * weight
        table = Pricing(price, lengths, counts, size)
        if table.top <= 0:
            break
        proven = float(price @ counts) / table.top
        if proven > bound:
            bound, best = proven, price / table.top
        room = counts * (t / rounds) - load
        for j in np.flatnonzero(table.value >= (1 - NEAR) * table.top)[::-1].tolist():
            if room[j] > 0:
                found = table.column(j)
                step = min(room[k] / n for k, n in found.items())
                for k, n in found.items():
                    room[k] -= n * step
                    load[k] += n * step
        weight = weight * np.exp(rate * (1 - load / (counts * (t / rounds))))
        weight /= weight.max()
    return best, bound


def _mixed(price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int, longer: bool) -> list[tuple[dict[int, int], int]]:
    """Configurations that are worth all but 1 at the prices, as the program's best mixture has no others, each a whole number of
    times; ``counts`` keeps what rounding leaves. The slack grows as far as SLACK when a turn moves too little."""
    out, slack = [], 1e-5
    while counts.any():
        use = np.flatnonzero(counts)
        own = price[use]
        table = Pricing(own, lengths[use], counts[use], size, longer)
        have, total = counts[use].copy(), counts.sum()

        def take(found: dict[int, int]) -> None:
            n = int(min(have[k] // m for k, m in found.items()))
            if n:
                for k, m in found.items():
                    have[k] -= n * m
                out.append(({table.lengths[k]: m for k, m in found.items()}, n))

        for j in np.flatnonzero(table.value >= 1 - slack)[::-1].tolist():
            if have[j]:
                found = table.column(j)
                take(found)
                if have[j] > HOT * total:  # a length with so many pieces goes on with every length that fits beside it, before shorter ones take those
                    held, had = found[j] * table.lengths[j], have[j]
                    for k in range(j - 1, -1, -1):
                        if have[k] and table.lengths[k] <= size - held:
                            found = {j: found[j]} | table.column(k, size - held)
                            if have[j] >= found[j] and sum(m * own[k] for k, m in found.items()) >= 1 - slack:
                                take(found)
                    if had - have[j] > LEAST * total:
                        break
        moved, before = counts[use].sum() - have.sum(), counts[use].sum()
        counts[use] = have
        if moved < LEAST * before:
            if slack >= SLACK:
                break
            slack = min(SLACK, 4 * slack)
    return out


def packed(histogram: dict[int, int], size: int = 2048, rounds: int = 16, rate: float = 0.5) -> Plan:
    """Sequences of at most ``size`` tokens for ``histogram`` (pieces of each length 1 to ``size``).

    The configuration linear program is solved, its mixture rounded down, and what is left is a smaller program; what the last
    of TURNS programs leaves is packed greedily. Work depends on the number of lengths, not on that of pieces.
    """
    short = {n: c for n, c in histogram.items() if c > 0 and n < size}
    plans = [_programs(short, size, rounds, rate, longer) for longer in (False, True)]
    best = min(plans, key=lambda plan: plan.sequences)
    merged: dict[tuple, int] = {((size, 1),): histogram[size]} if histogram.get(size) else {}
    for found, n in best.configurations:
        key = tuple(sorted(found.items()))
        merged[key] = merged.get(key, 0) + n
    return Plan([(dict(k), n) for k, n in sorted(merged.items())], max(plan.bound for plan in plans) + histogram.get(size, 0), best.mixed)


def _programs(left: dict[int, int], size: int, rounds: int, rate: float, longer: bool) -> Plan:
    """The plan for pieces under ``size``, where equal configurations are settled for fewer or for longer pieces."""
    out = Plan([], 0.0)
    for turn in range(TURNS):
        if not left:
            break
        lengths = np.array(sorted(left), int)
        counts = np.array([left[n] for n in lengths.tolist()], np.int64)
        price, proven = prices(lengths, counts, size, rounds, rate)
        if not turn:
            out.bound = proven
        found = _mixed(price, lengths, counts, size, longer)
        out.configurations += found
        out.mixed += sum(n * sum(c.values()) for c, n in found)
        left = {n: c for n, c in zip(lengths.tolist(), counts.tolist(), strict=True) if c}
        if not found:
            break
    out.configurations += _rest(left, size)
    return out


def _rest(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """What is left, packed as well as the better of two greedy ways does it."""
    ways = [_fullest_first(dict(left), size), _best_fit(left, size)]
    return min(ways, key=lambda way: sum(n for _, n in way))


def _fullest_first(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """The longest piece, then as full as a subset-sum over the lengths left allows; as often as they last."""
    out = []
    while left:
        first = max(left)
        found = {first: 1}
        if size > first:
            spare = dict(left)
            spare[first] -= 1
            for n, k in _subset(spare, size - first).items():
                found[n] = found.get(n, 0) + k
        times = min(left[n] // k for n, k in found.items())
        for n, k in found.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        out.append((found, times))
    return out


def _best_fit(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing, whole groups of like sequences at a time: the histogram's counts don't matter for its steps."""
    room: dict[int, list[tuple[tuple, int]]] = {}  # by what still fits: contents and number of sequences
    order: list[int] = []

    def put(space: int, found: tuple, n: int) -> None:
        if space not in room:
            room[space] = []
            insort(order, space)
        room[space].append((found, n))

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            i = bisect_left(order, n)
            if i == len(order):
                fit = size // n
                if count >= fit:
                    put(size - fit * n, ((n, fit),), count // fit)
                    count %= fit
                else:
                    put(size - count * n, ((n, count),), 1)
                    count = 0
                continue
            space = order[i]
            found, have = room[space].pop()
            if not room[space]:
                del room[space], order[i]
            fit = space // n
            use = min(have, count // fit)
            if use < have:
                put(space, found, have - use - (1 if count % fit and use * fit < count and use < have else 0))
            if use:
                put(space - fit * n, (*found, (n, fit)), use)
                count -= use * fit
            if use < have and count % fit:
                put(space - count % fit * n, (*found, (n, count % fit)), 1)
                count = 0
            elif use < have:
                count = 0
    out = []
    for held in room.values():
        for found, times in held:
            if times:
                both: dict[int, int] = {}
                for n, k in found:
                    both[n] = both.get(n, 0) + k
                out.append((both, times))
    return out


def _subset(spare: dict[int, int], room: int) -> dict[int, int]:
    """Pieces of the lengths in spare, no more than there are, that fill ``room`` as far as possible; few long ones rather than many short ones."""
    how = np.full(room + 1, -1)  # the tokens that first reached a sum, and the length they are pieces of
    of = np.full(room + 1, -1)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for n in sorted((n for n, c in spare.items() if c and n <= room), reverse=True):
        times, step = min(spare[n], room // n), 1
        while times > 0:  # 1, 2, 4, .. and the rest make every number of pieces
            k = min(step, times)
            shifted = np.zeros(room + 1, bool)
            shifted[k * n :] = reached[: room + 1 - k * n]
            new = shifted & ~reached
            how[new], of[new] = k * n, n
            reached |= new
            times, step = times - k, 2 * step
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    found: dict[int, int] = {}
    while at:
        n = int(of[at])
        found[n] = found.get(n, 0) + int(how[at]) // n
        at -= int(how[at])
    return found


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = 2048, bucket: int = 128) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs (doc_id, text).

    The histogram (at most ``size`` rows) is all that reaches the driver; the configurations go back as a table of bounded
    size. A length with many pieces is dealt into buckets of about ``bucket`` pieces (more where that made over 100,000
    buckets), which are ranked apart, so no length is one task. Rows of equal doc_id are packed each; empty docs give no row.
    """
    spark = docs.sparkSession
    cut, _ = staged(pieces(docs, tokenizer, size), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packed(histogram, size)
    # places of a length: ranks from .. to lie in sequences base + (rank - from) / times, at offset + length * ((rank - from) % times)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for found, n in plan.configurations:
        at = 0
        for length, k in sorted(found.items(), reverse=True):
            held = slots.setdefault(length, [])
            begin = held[-1][0] if held else 0
            held.append((begin + n * k, base, at, k))
            at += length * k
        base += n
    shared = spark.sparkContext.broadcast({length: np.array(x, np.int64) for length, x in slots.items()})
    bucket = max(bucket, sum(histogram.values()) // 100_000)
    buckets = {length: -(-n // bucket) for length, n in histogram.items()}
    many = spark.createDataFrame([(length, b) for length, b in buckets.items()] or [(0, 1)], "length long, buckets long")
    dealt, _ = staged(cut.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")), "dealt")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                x = held[int(n)]
                i = np.searchsorted(x[:, 0], rank[own], side="right")
                begin = np.where(i > 0, x[i - 1, 0], 0)
                j = rank[own] - begin
                sequence[own] = x[i, 1] + j // x[i, 3]
                offset[own] = x[i, 2] + n * (j % x[i, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ARROW.names), pa.array(sequence), pa.array(offset)], [*_ARROW.names, "sequence_id", "offset"])

    return ranked.select(*_ARROW.names, (F.col("rank") + F.col("before")).cast("long").alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
