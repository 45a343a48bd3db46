"""Users' lists and imported lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: where an item without a position sorts.
NO_POSITION = 2147483647


def renumbered(items: DataFrame) -> DataFrame:
    """Items with positions 1..N within their list, by old position (none last), then id."""
    w = Window.partitionBy("user_list_id").orderBy(F.coalesce("position", F.lit(NO_POSITION)), "id")
    return items.withColumn("position", F.row_number().over(w))


def next_position(items: DataFrame) -> DataFrame:
    return items.groupBy("user_list_id").agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next_position"))


def ordered_items(items: DataFrame, list_id: int, ranked_items: DataFrame | None = None) -> DataFrame:
    """One list's items by position, or by rank where a ranking is given; what has none is last."""
    own = items.where(F.col("user_list_id") == list_id)
    if ranked_items is None:
        return own.orderBy(F.asc_nulls_last("position"), "id")
    return own.join(ranked_items.select(F.col("item_id").alias("listable_id"), "rank"), "listable_id", "left").orderBy(F.asc_nulls_last("rank"), "id")


def reordered(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Lists in new orders (user_list_id, ids): id and position 1..N. An order that is no permutation of its list gives no rows."""
    now = items.groupBy("user_list_id").agg(F.sort_array(F.collect_list("id")).alias("now"))
    good = orders.join(now, "user_list_id").where(F.sort_array("ids") == F.col("now"))
    return good.select("user_list_id", F.posexplode("ids").alias("position", "id")).withColumn("position", F.col("position") + 1)


def invalid_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    return orders.select("user_list_id").exceptAll(reordered(items, orders).select("user_list_id").distinct())


def missing_defaults(users: DataFrame, lists: DataFrame, kinds: list[int]) -> DataFrame:
    """Each user and kind of list that every user should have but this one has not."""
    wanted = users.select("user_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("list_type"))
    return wanted.join(lists.select("user_id", "list_type").distinct(), ["user_id", "list_type"], "left_anti")


def in_given_order(items: DataFrame, ids: list[int], key: str) -> DataFrame:
    """The rows of the ids, in their order; ids without a row drop out."""
    given = items.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, place int")
    return items.join(F.broadcast(given), key).orderBy("place")


def import_positions(extracted: DataFrame, batch: bool = False) -> DataFrame:
    """Positions of extracted items (list_id, batch_no, idx, rank): the rank or, without one, the place; in batch mode 1..N over all batches."""
    if batch:
        return extracted.withColumn("position", F.row_number().over(Window.partitionBy("list_id").orderBy("batch_no", "idx")))
    return extracted.withColumn("position", F.coalesce("rank", F.col("idx") + 1))
