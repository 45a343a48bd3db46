"""Queries on what sinks would write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from . import plan

OLD = "(SELECT item_id, rank, score, 2020 AS created FROM ranked_items WHERE item_id % 3 <> 0)"
NEW = "(SELECT item_id, rank + 1 AS rank, score, 2024 AS created FROM ranked_items WHERE item_id % 4 <> 0)"


def _old(c) -> DataFrame:
    return c.ranked_items.where("item_id % 3 <> 0").select("item_id", "rank", "score", F.lit(2020).alias("created"))


def _new(c) -> DataFrame:
    return c.ranked_items.where("item_id % 4 <> 0").select("item_id", (F.col("rank") + 1).alias("rank"), "score", F.lit(2024).alias("created"))


@plan(f"SELECT COALESCE(o.item_id, n.item_id) AS item_id, COALESCE(n.rank, o.rank) AS rank, COALESCE(o.created, n.created) AS created FROM {OLD} o FULL JOIN {NEW} n ON n.item_id = o.item_id")
def upsert_sink(c) -> DataFrame:
    return sinks.upserted(_old(c), _new(c), ["item_id"], ["rank", "score"]).select("item_id", "rank", "created")


@plan(f"SELECT item_id, rank FROM {NEW} n WHERE item_id NOT IN (SELECT item_id FROM {OLD} o)")
def insert_ignore_sink(c) -> DataFrame:
    return sinks.inserted(_old(c), _new(c), ["item_id"]).select("item_id", "rank")


@plan(f"SELECT item_id, rank FROM {OLD} o WHERE item_id NOT IN (SELECT item_id FROM {NEW} n)")
def prune_sink(c) -> DataFrame:
    return sinks.pruned(_old(c), _new(c), ["item_id"]).select("item_id", "rank")


@plan(f"SELECT n.item_id, o.rank AS before, n.rank AS after, o.rank IS NULL OR o.rank <> n.rank AS changed FROM {NEW} n LEFT JOIN {OLD} o ON o.item_id = n.item_id")
def change_report(c) -> DataFrame:
    return sinks.change_report(_old(c), _new(c), "item_id", "rank")


@plan("SELECT r.item_id AS id, r.rank AS ranked_position, r.item_id IN (SELECT listable_id FROM list_items WHERE listable_id IS NOT NULL AND list_id < 2000) AS ranked FROM ranked_items r JOIN books b ON b.id = r.item_id")
def reindex_ranked_fields(c) -> DataFrame:
    return sinks.reindexed_ranks(c.books, c.ranked_items, c.list_items.where("list_id < 2000"))


@plan("SELECT id, CASE WHEN rating > 4 THEN 'rating' ELSE '' END AS errors FROM reviews")
def row_errors(c) -> DataFrame:
    checked = sinks.with_errors(c.reviews, {"rating": F.col("rating").between(1, 4), "user": F.col("user_id").isNotNull()})
    return checked.select("id", F.array_join("errors", ",").alias("errors"))
