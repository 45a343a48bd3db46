"""Queries on users' lists and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import visible_to
from ..operators import lists
from . import plan


@plan("SELECT id, user_list_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_list_id ORDER BY COALESCE(position, 2147483647), id) AS INT) AS position FROM user_list_items")
def renumber_lists(c) -> DataFrame:
    return lists.renumbered(c.user_list_items).select("id", "user_list_id", "position")


@plan("SELECT user_list_id, COALESCE(MAX(position), 0) + 1 AS next_position FROM user_list_items GROUP BY user_list_id")
def next_position(c) -> DataFrame:
    return lists.next_position(c.user_list_items)


@plan("SELECT u.id, u.listable_id, u.position, r.rank FROM user_list_items u LEFT JOIN ranked_items r ON r.item_id = u.listable_id WHERE u.user_list_id = 17")
def my_list_items(c) -> DataFrame:
    return lists.ordered_items(c.user_list_items, 17, c.ranked_items).select("id", "listable_id", "position", "rank")


ORDERS = "(SELECT user_list_id, id, ROW_NUMBER() OVER (PARTITION BY user_list_id ORDER BY id DESC) AS n FROM user_list_items)"


@plan("SELECT user_list_id, id, CAST(ROW_NUMBER() OVER (PARTITION BY user_list_id ORDER BY id DESC) AS INT) AS position FROM user_list_items WHERE user_list_id % 5 <> 0")
def reorder_list(c) -> DataFrame:
    """New orders that are the old ones backwards; a fifth of them lack an item and are refused."""
    given = c.user_list_items.groupBy("user_list_id").agg(F.reverse(F.sort_array(F.collect_list("id"))).alias("ids"))
    given = given.withColumn("ids", F.when(F.col("user_list_id") % 5 == 0, F.expr("slice(ids, 2, size(ids))")).otherwise(F.col("ids")))
    return lists.reordered(c.user_list_items, given).select("user_list_id", "id", "position")


@plan("SELECT u.user_id, k.list_type FROM (SELECT DISTINCT user_id FROM user_lists) u CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(list_type) WHERE NOT EXISTS (SELECT 1 FROM user_lists l WHERE l.user_id = u.user_id AND l.list_type = k.list_type)")
def missing_default_lists(c) -> DataFrame:
    return lists.missing_defaults(c.user_lists.select("user_id").distinct(), c.user_lists, [0, 1, 2, 3])


GIVEN = [907, 3, 555, 1999, 42, 10_000_000, 8]


@plan("SELECT b.id, b.title, g.place FROM (VALUES (907, 0), (3, 1), (555, 2), (1999, 3), (42, 4), (10000000, 5), (8, 6)) AS g(id, place) JOIN books b ON b.id = g.id")
def order_by_given_ids(c) -> DataFrame:
    return lists.in_given_order(c.books, GIVEN, "id").select("id", "title", "place")


EXTRACTED = "(SELECT id % 20 AS list_id, CAST(id % 100 / 20 AS INT) AS batch_no, CAST(FLOOR(id / 100) AS INT) AS idx, CASE WHEN id % 3 = 0 THEN CAST(id % 50 AS INT) END AS rank, id FROM books)"


@plan("SELECT id, COALESCE(CASE WHEN id % 3 = 0 THEN CAST(id % 50 AS INT) END, CAST(FLOOR(id / 100) AS INT) + 1) AS position FROM books")
def list_import_positions(c) -> DataFrame:
    rows = c.books.selectExpr("id % 20 as list_id", "cast(floor(id % 100 / 20) as int) as batch_no", "cast(floor(id / 100) as int) as idx", "case when id % 3 = 0 then cast(id % 50 as int) end as rank", "id")
    return lists.import_positions(rows).select("id", "position")


@plan("SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY id % 20 ORDER BY FLOOR(id % 100 / 20), FLOOR(id / 100)) AS INT) AS position FROM books")
def list_import_batches(c) -> DataFrame:
    rows = c.books.selectExpr("id % 20 as list_id", "cast(floor(id % 100 / 20) as int) as batch_no", "cast(floor(id / 100) as int) as idx", "cast(null as int) as rank", "id")
    return lists.import_positions(rows, batch=True).select("id", "position")


@plan("SELECT id, user_id FROM user_lists WHERE public OR user_id = 7")
def visible_lists(c) -> DataFrame:
    return c.user_lists.where(visible_to(F.col("public"), F.col("user_id"), 7)).select("id", "user_id")
