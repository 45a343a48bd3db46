"""Secret scans by multipart credential linking; DataFrame functions only.

Matches get their places from a text cut at them: the lengths of what stands
between and of the matches themselves add up. Strong matches are reported as
they are. Weak candidates (user names, bare tokens, endpoints) are reported
only where a complementary part stands within the same scope, found by an
interval join that sweeps a document's parts in order, once each way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Strong kinds in the order of their listing; pattern, group to measure, its least length, and what every text with a match contains.
STRONG = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
]
#: Weak kinds, likewise. An opaque token is a whole run of its characters that has a digit, an upper-case and a lower-case letter.
WEAK = [
    ("user", r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", 0, 1, (":", "=")),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+", 0, 1, ()),
    ("endpoint", r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}", 0, 1, ("://",)),
]
#: What completes each weak kind. A strong match is a secret, an access key is an identifier.
COMPLETES = {"user": ("assign", "hex", "opaque"), "opaque": ("user", "access", "endpoint"), "endpoint": ("assign", "access", "opaque")}
ORDER = [k for k, *_ in STRONG + WEAK]
#: Further than any text reaches; items that are folded together; code points of a chunk of a long text.
FAR, BLOCK, CHUNK = 1 << 40, 128, 2048
SPANS = "array<struct<start:bigint,rank:int,stop:bigint>>"
KEPT = "array<struct<from:bigint,to:bigint>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, even where it is used for each item of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` emits for each item: it takes the state so far and an item, and gives the next state and an array (of type ``out``).

    A fold whose result grows copies it at each step. Here items are folded in blocks, so that only a block's result is
    copied at its steps, and only the list of blocks at theirs.
    """
    none = F.array().cast(out)

    def blocks(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(xs, i, F.lit(BLOCK)))

    def each(acc: Column, item: Column) -> Column:
        after, emitted = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], emitted).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        begun = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(some, begun, each, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    begun = F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out"))
    return F.aggregate(bound(items, blocks), begun, block, lambda r: F.flatten(r["out"]))


def matches(text: Column, pattern: str, group: int, least: int, rank: int, marks: tuple[str, ...] = ()) -> Column:
    """SPANS of the leftmost non-overlapping matches whose group has ``least`` characters; code points from 0, stop exclusive.

    Only texts with one of ``marks``, where any are given, are searched, and only those with a match are cut at them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(kept, F.length).alias("core"))
    none = F.array().cast(SPANS)

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        stop = start + F.coalesce(p["size"], F.lit(0))
        return stop, F.when(p["core"] >= least, F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop")))).otherwise(none)

    there = F.lit(not marks)
    for mark in marks:
        there = there | text.contains(mark)
    return F.when(~there | ~text.rlike(pattern), none).otherwise(running(parts, F.lit(0).cast("long"), SPANS, step))


def _sweep(parts: Column, scope: int, back: bool = False) -> Column:
    """Each part, and whether a part that completes it ended at most ``scope`` before its start; parts in order of start.
    ``back``: whether one starts at most ``scope`` after its end; parts in reverse order."""
    last = F.struct(*[F.lit(FAR if back else -1 - scope).cast("long").alias(k) for k in ORDER])

    def step(last: Column, p: Column) -> tuple[Column, Column]:
        linked = F.lit(False)
        for weak, others in COMPLETES.items():
            near = F.lit(False)
            for other in others:
                gap = last[other] - p["stop"] if back else p["start"] - last[other]
                near = near | (gap <= scope)
            linked = F.when(p["rank"] == ORDER.index(weak), near).otherwise(linked)
        row = F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["stop"].alias("stop"), linked.alias("linked"))
        seen = F.struct(*[F.when(p["rank"] == i, p["start"] if back else F.greatest(p["stop"], last[k])).otherwise(last[k]).alias(k) for i, k in enumerate(ORDER)])
        return seen, F.array(row)

    return running(parts, last, "array<struct<start:bigint,rank:int,stop:bigint,linked:boolean>>", step)


def linked_spans(strong: Column, weak: Column, scope: int = 200) -> Column:
    """All strong spans and the weak ones that a complementary part completes with at most ``scope`` code points between the two, by start, then kind."""
    parts = F.array_sort(F.concat(strong, weak))
    both = F.arrays_zip(_sweep(parts, scope).alias("f"), F.reverse(_sweep(F.reverse(parts), scope, back=True)).alias("b"))
    n = len(STRONG)
    kept = F.transform(F.filter(both, lambda x: (x["f"]["rank"] < n) | x["f"]["linked"] | x["b"]["linked"]), lambda x: F.struct(x["f"]["start"].alias("start"), x["f"]["rank"].alias("rank"), x["f"]["stop"].alias("stop")))
    return F.when(F.size(weak) == 0, strong).otherwise(kept)


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """docs with ``strong`` (SPANS by start, then kind) and ``spans`` (with the linked weak ones too), without a shuffle.

    Null and empty texts have none. Rows are scanned one by one: repeated rows repeat. Columns of docs that are named strong or
    spans are replaced, all others stay as they are. Work is in proportion to a text's length.
    """
    text, weak, own = unused(docs, "whole_text"), unused(docs, "weak_spans"), [unused(docs, f"spans_{k}") for k in ORDER]
    out = docs.withColumn(text, F.coalesce("text", F.lit("")))
    out = out.select("*", *[matches(F.col(text), pattern, group, least, rank, marks).alias(name) for name, (rank, (_, pattern, group, least, marks)) in zip(own, enumerate(STRONG + WEAK), strict=True)])
    n = len(STRONG)
    out = out.withColumn("strong", F.array_sort(F.concat(*own[:n]))).withColumn(weak, F.array_sort(F.concat(*own[n:])))
    return out.withColumn("spans", linked_spans(F.col("strong"), F.col(weak), scope)).drop(text, weak, *own)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (by start) replaced; overlapping spans are replaced together."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = F.struct(at.alias("from"), s["start"].alias("to"))
        return F.greatest(at, s["stop"]), F.when(s["start"] >= at, F.array(fresh)).otherwise(F.array().cast(KEPT))

    end = F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["stop"])).alias("from"), F.length(text).cast("long").alias("to")))
    kept = F.concat(running(spans, F.lit(0).cast("long"), KEPT, step), end)
    # a place in a string is found by reading all before it, so long texts are cut into chunks first
    chunks = F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))

    def piece(cut: Column, k: Column) -> Column:
        first, last = (k["from"] / CHUNK).cast("int"), ((k["to"] - 1) / CHUNK).cast("int")
        some = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return F.when(k["to"] <= k["from"], "").otherwise(F.substring(some, (k["from"] % CHUNK + 1).cast("int"), (k["to"] - k["from"]).cast("int")))

    joined = bound(chunks, lambda cut: F.array_join(F.transform(kept, lambda k: piece(cut, k)), mark))
    return F.when(F.size(spans) == 0, text).otherwise(joined)
