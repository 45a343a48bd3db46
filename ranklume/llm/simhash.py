"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two
fingerprints within the radius share a variant, so one shuffle on variants
brings them together; a variant's fingerprints are linked in a chain, each
link verified, and the links' components are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected_components, maybe_among, salted_lookup, sent, small_batches, staged, unused

SEED = 42


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of ``width`` words of the ASCII-lower-cased text, repeats included; the whole sequence if it is shorter, none if empty."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint, signed: a bit is 1 if set in over half of the shingles' XXH64; 0 for no words."""
    found = shingles(text, width)
    if not found:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(s, seed) for s in found], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # whole texts, in steps of bounded memory
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (long) of each row; null and empty texts have fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t, width) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(distance: int) -> list[int]:
    """All 64-bit masks of at most ``distance`` bits, signed."""
    out = [sum(1 << b for b in bits) for k in range(distance + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links a, b of distinct fingerprints ``fp`` that have the components of all pairs within the radius.

    A variant has at most as many fingerprints as its ball has points. All of them lie within the radius of each other
    if it is even, so a chain in their order loses no component; for an odd radius each is linked to the variant's
    every other fingerprint, which the ball bounds too.
    """
    variants = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in masks((radius + 1) // 2)])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    if radius % 2 == 0:
        chain = variants.withColumn("b", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))).where("b is not null").select(F.col("fp").alias("a"), "b")
    else:
        chain = variants.alias("x").join(variants.alias("y"), "variant").where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return chain.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over fingerprints within the radius) of each row.

    Equal fingerprints, that of texts without words included, are one class before any pair is sought. A null doc_id keeps its
    row and is no component's smallest id unless its class has no other. Repeated rows repeat; other columns are not read.
    """
    prints, _ = staged(fingerprints(docs, width), "simhash")
    classes, _ = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), radius), "simhash-links")
    # only linked classes have a component beside their own
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(salted_lookup(linked, lowest, "root", "fp", "inner").select("fp", "component_id"), "fp", "left")
    named, _ = staged(named.select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-named")
    # a fingerprint of very many documents is a skewed key of two written tables, which adaptive execution splits
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def _jaccard(a: str | None, b: str | None, width: int) -> float:
    x, y = set(shingles(a, width)), set(shingles(b, width))
    return len(x & y) / len(x | y) if x or y else 1.0


#: Minima in a key and keys of a set, at each level: of sets of similarity 0.8, a pair shares a key with a probability of 0.998, 0.97 and 0.94.
LEVELS = ((6, 20), (9, 24), (12, 40))
#: Words whose hashes a task keeps at hand; shingles whose permutations are held at once; bits of a parity map.
MEMO, AT_ONCE, PARITY = 300_000, 4096, 512
#: The most members of a key that are compared all with all; leaders that a set is compared with at each level.
CROWD, LEADERS = 16, 8
#: Slots (a power of 2) in which shingles are counted, in CHUNKS parts; members of a key that one task compares with others at once.
SLOT_BITS, CHUNKS, BLOCK = 21, 64, 4096


class Shingles(dict):
    """Hashes of words; a call gives the sorted distinct hashes of a text's shingles, as shingles() cuts them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found

    def __call__(self, text: str | None, width: int) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)], np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = len(h) - width + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(width):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


class Minima:
    """A level's keys of a set of hashes, each of some minima of permutations. Two sets share one minimum with the probability of their Jaccard similarity."""

    def __init__(self, level: int):
        rng = np.random.default_rng(SEED + level)
        self.rows, self.bands = LEVELS[level]
        self.odd = rng.integers(0, 1 << 31, self.bands * self.rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(0, 1 << 32, self.bands * self.rows, np.uint32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, np.int64)
        x = (h >> np.uint64(32)).astype(np.uint32)[:, None]
        least = np.min([((x[at : at + AT_ONCE] ^ self.flip) * self.odd).min(0) for at in range(0, len(x), AT_ONCE)], axis=0).astype(np.uint32)
        return np.array([xxhash.xxh64_intdigest(least[k * self.rows : (k + 1) * self.rows].tobytes(), k) for k in range(self.bands)], np.uint64).view(np.int64)


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id of every document with a group of others, and ``group``, the smallest doc_id of it.

    Documents of equal sets of ``width``-word shingles, or linked by a chain of texts whose sets have a Jaccard similarity of
    ``similarity`` (above 0) or more, are a group. Candidates share a key of several minima (LEVELS), which two sets of similarity 0.8 do
    with a probability of 0.998 and more alike ones more often; every link is verified on whole texts. Null texts are empty, and empty
    texts are copies of each other. Rows without doc_id are in no group; rows of one doc_id are one document, other columns are not read.

    Members of small keys are all compared, those of crowded ones first with their keys' leaders, the sets that meet most others. Sets that
    then still share a crowded key with sets of other groups get the next level's keys, of more minima, which unlike sets no longer share.
    That joins most groups at little cost and settles none of the crowded keys: whatever sets of a crowded key of the first level are of
    several groups after the last one are all compared, by their first shingles (_rest), which misses no pair.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    words = PARITY // 64
    maps = [f"p{i}" for i in range(words)]
    names = ["doc_id", "hash", "id", "n", "keys", *maps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minima = Shingles(), Minima(0)
        for batch in batches:
            sets = [hashes(t, width) for t in batch.column(2).to_pylist()]
            prints = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in sets], pa.int64())
            odd = np.array([np.packbits((np.bincount((h & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64) for h in sets], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, pa.array([len(h) for h in sets], pa.int64()), pa.array([minima(h) for h in sets], pa.list_(pa.int64())), *(pa.array(odd[:, i]) for i in range(words))], names)

    schema = "doc_id long, hash long, id long, n long, keys array<long>, " + ", ".join(f"{m} long" for m in maps)
    prints, _ = staged(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, schema), "near")
    # a row for each set; what is repeated in full may stay, as a set is never compared with itself
    reps = prints.groupBy("id").agg(F.min(F.struct("doc_id", "hash")).alias("r")).select("id", "r.doc_id", "r.hash")
    sets, _ = staged(prints.join(reps.hint("merge"), ["id", "doc_id", "hash"]), "near-sets")
    # sets of one document are of one group
    several = prints.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("high")).where("b < high").select("doc_id", "b")
    links = prints.join(several, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    roots, _ = staged(connected_components(links, "near-links").select(F.col("node").alias("id"), "root"), "near-roots")
    crowd, first = None, None
    for level in range(len(LEVELS)):
        with Scratch(spark) as own:
            keyed = _keyed(docs, sets, crowd, width, level, own) if level else sets.select("id", F.explode("keys").alias("key"))
            placed = _apart(_shared(keyed, own), roots, own)
            if placed.isEmpty():
                break
            few = placed.where(F.col("n") <= CROWD).select("key", "id", "root")
            small = few.hint("merge").join(few.select("key", F.col("id").alias("b"), F.col("root").alias("of")), "key").where("id < b and root <> of").select("id", "b")
            crowded = placed.where(F.col("n") > CROWD)
            roots = _linked(roots, own(_alike(docs, sets, _leaders(crowded).unionByName(small), maps, width, similarity, own), "near-found"), own)
            if not level:
                first, _ = staged(crowded.select("id", "key", "meets"), "near-first")
            crowd, _ = staged(crowded.select("id").distinct(), "near-crowd")
    if first is not None:
        with Scratch(spark) as own:
            rest = own(_apart(first, roots, own).select("id", "root").distinct(), "near-rest")
            if not rest.isEmpty():
                roots = _linked(roots, own(_alike(docs, sets, _rest(docs, sets, rest, maps, width, similarity, own), maps, width, similarity, own), "near-found"), own)
    members = prints.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")).distinct()
    members, _ = staged(members, "near-members")
    lowest = members.groupBy("root").agg(F.min("doc_id").alias("group"), F.max("doc_id").alias("high")).where("high > group").select("root", "group")
    return members.join(lowest.hint("merge"), "root").select("doc_id", "group").distinct()


def _linked(roots: DataFrame, found: DataFrame, own: Scratch) -> DataFrame:
    """roots (id, root), written anew, after the links a, b of found. Only links of different groups are walked, as links of their roots: what is joined stays joined."""
    if found.isEmpty():
        return roots
    for end in "ab":  # written tables, so that adaptive execution splits the links of a leader and the sets of a large group
        found = found.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root")).hint("merge"), end, "left")
    between = own(found.select(*[F.coalesce(f"{end}_root", end).alias(end) for end in "ab"]).where("a <> b").distinct(), "near-between")
    moved = own(connected_components(between, "near-links").select("node", F.col("root").alias("to")), "near-moved")
    held = roots.join(moved.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots.select(F.col("id").alias("node")).hint("merge"), "node", "left_anti").select(F.col("node").alias("id"), F.col("to").alias("root"))
    return staged(held.unionByName(fresh), "near-roots")[0]


def _shared(keyed: DataFrame, own: Scratch) -> DataFrame:
    """Rows (id, key) of keys with several sets, and ``meets``, how many a set meets. Of keys with the same members one is enough."""
    keyed = own(keyed.distinct(), "near-keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("met"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"), F.bit_xor(F.xxhash64(F.lit(SEED), "id")).alias("also")).where("met > 1")
    sizes = sizes.groupBy("met", "who", "also").agg(F.min("key").alias("key")).select("key", "met")
    # a set has a bounded number of keys, so no window is large
    rows = keyed.join(sizes.hint("merge"), "key").select("id", "key", F.sum("met").over(Window.partitionBy("id")).alias("meets"))
    return own(rows, "near-shared")


def _apart(rows: DataFrame, roots: DataFrame, own: Scratch) -> DataFrame:
    """The rows of keys whose sets are of several groups, with their ``root``, the key's number of sets and its leader (``lead``, ``of``)."""
    placed = own(rows.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id")), "near-placed")
    keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("meets", "id", "root")).alias("best")).where("low <> high")
    keys = keys.select("key", "n", F.col("best.id").alias("lead"), F.col("best.root").alias("of"), F.col("best.meets").alias("led"))
    return own(placed.join(keys.hint("merge"), "key"), "near-open")


def _leaders(crowd: DataFrame) -> DataFrame:
    """Pairs id, b: each set with the LEADERS of other groups that meet most others, of those that lead its keys."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("led", "lead")), asc=False), 1, LEADERS)
    return crowd.where("root <> of").groupBy("id").agg(best.alias("x")).select("id", F.explode("x.lead").alias("b"))


def _texts(docs: DataFrame, sets: DataFrame, ids: DataFrame, own: Scratch) -> DataFrame:
    """id and a text of each set in ids (id)."""
    some = own(sets.select("id", "hash").dropDuplicates(["id"]).join(ids.hint("merge"), "id"), "near-some")
    among = maybe_among(some, "hash")
    texts = docs.withColumn("hash", F.xxhash64("text")).where(among(F.col("hash"))).groupBy("hash").agg(F.min("text").alias("text"))
    return some.join(texts.hint("merge"), "hash").select("id", "text")


def _keyed(docs: DataFrame, sets: DataFrame, crowd: DataFrame, width: int, level: int, own: Scratch) -> DataFrame:
    """Rows (id, key) of a level's keys of the sets in crowd (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minima = Shingles(), Minima(level)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([minima(hashes(t, width)) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "keys"])

    return _texts(docs, sets, crowd, own).mapInArrow(run, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))


def _levels(texts: DataFrame, width: int) -> np.ndarray:
    """How frequent each slot's shingles are, by an eighth of a power of 2: a table of fixed size however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Shingles(), np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (hashes(text, width) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        for k, part in enumerate(np.split(counts, CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.round(8 * np.log2(1 + n)).clip(0, 255).astype(np.uint8).tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    levels = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.uint8)
    for r in texts.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(total, schema).collect():
        levels[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return levels.reshape(-1)


def _prefix(h: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles in one order for all sets, rare ones first: as many as leave too few others for two alike sets to share none of the first."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
    order = levels[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    return (np.partition(order, n - 1)[:n] if 0 < n < len(order) else order).view(np.int64)


def _rest(docs: DataFrame, sets: DataFrame, rest: DataFrame, maps: list[str], width: int, similarity: float, own: Scratch) -> DataFrame:
    """Pairs id, b that hold all alike sets of different groups among rest (id, root).

    Two alike sets share one of their first shingles in any order, so all who share one are compared where they stand, by group, size
    and parity map, which leaves few pairs. A key's sets outside of its largest group meet all, dealt into blocks, so that
    a large group costs no square and a large key is no single task.
    """
    texts = own(_texts(docs, sets, rest.select("id"), own), "near-rest-texts")
    levels = sent(docs.sparkSession, _levels(texts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = Shingles(), levels()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_prefix(hashes(t, width), table, similarity) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "keys"])

    rows = own(texts.mapInArrow(run, "id long, keys array<long>").join(rest.hint("merge"), "id").select("id", "root", F.explode("keys").alias("key")), "near-prefixes")
    keys = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    keys = keys.select("key", F.col("most.root").alias("main"), F.ceil(F.col("m") / BLOCK).alias("blocks"))
    # keys of one group are gone before the rows get wide
    met = own(rows.join(keys.hint("merge"), "key"), "near-met")
    one = sets.select("id", "n", *maps).dropDuplicates(["id"])
    met = own(met.join(one.hint("merge"), "id"), "near-wide")
    few = met.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    all_ = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    left, right = (x.select(*[F.col(c).alias(f"{c}_{end}") for c in ("key", "block", "id", "root", "main", "n", *maps)]).hint("merge") for x, end in ((few, "a"), (all_, "b")))
    on = [F.col("key_a") == F.col("key_b"), F.col("block_a") == F.col("block_b"), F.col("root_a") != F.col("root_b"), (F.col("root_b") == F.col("main_b")) | (F.col("id_a") < F.col("id_b")), _able(maps, similarity)]
    return left.join(right, on).select(F.col("id_a").alias("id"), F.col("id_b").alias("b"))


def _able(maps: list[str], similarity: float) -> F.Column:
    """Whether two sets can be alike, by their sizes (n_a, n_b) and parity maps: |x & y| >= J / (1 + J) (|x| + |y|), so the rest is at most (1 - J) / (1 + J) of both, and no fewer than the odd bits."""
    odd = sum(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in maps)
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (odd <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6)


def _alike(docs: DataFrame, sets: DataFrame, pairs: DataFrame, maps: list[str], width: int, similarity: float, own: Scratch) -> DataFrame:
    """Pairs a, b of the candidates (id, b) whose texts are alike. Sizes and parity maps of the sets drop only pairs that cannot be."""
    # Spark takes exploded rows for few: none of them may be broadcast
    pairs = pairs.where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct().hint("merge")
    one = sets.select("id", "n", "hash", *maps).dropDuplicates(["id"])
    left, right = (one.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "hash", *maps)]) for end in "ab")
    both = pairs.join(left, "a").join(right, "b")
    close = own(both.where(_able(maps, similarity)).select("a", "b", "hash_a", "hash_b"), "near-close")
    wanted = close.select(F.explode(F.array("hash_a", "hash_b")).alias("hash")).distinct()
    among = maybe_among(wanted, "hash")
    texts = docs.withColumn("hash", F.xxhash64("text")).where(among(F.col("hash"))).groupBy("hash").agg(F.min("text").alias("text")).join(wanted, "hash")
    texts = own(texts, "near-texts")
    both = close.join(texts.select(F.col("hash").alias("hash_a"), F.col("text").alias("t")), "hash_a").join(texts.select(F.col("hash").alias("hash_b"), F.col("text").alias("u")), "hash_b").select("a", "b", "t", "u")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([_jaccard(t, u, width) >= similarity for t, u in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(verify, "a long, b long")


def first_of_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs' rows without those of documents whose group (near_groups) has a smaller doc_id. All columns stay."""
    lost, passed = unused(docs, "gone"), unused(docs, "maybe")
    gone, _ = staged(near_groups(docs, width, similarity).where("doc_id <> group").select(F.col("doc_id").alias(lost)), "near-gone")
    maybe = docs.withColumn(passed, F.coalesce(maybe_among(gone, lost)(F.col("doc_id").cast("long")), F.lit(False)))
    kept = maybe.where(F.col(passed)).join(gone.hint("merge"), F.col("doc_id") == F.col(lost), "left_anti")
    return maybe.where(~F.col(passed)).unionByName(kept).drop(passed)
