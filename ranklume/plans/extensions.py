"""Extensions: what a query engine is expected to have beside the catalog's own queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import plan


@plan("SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def ext_cube(c) -> DataFrame:
    return c.part.cube("p_brand", "p_type").agg(F.count("*").alias("n"))


@plan("SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def ext_rollup(c) -> DataFrame:
    return c.part.rollup("p_brand", "p_type").agg(F.count("*").alias("n"))


@plan("SELECT book_id AS id FROM book_authors INTERSECT SELECT item_id AS id FROM ranked_items")
def ext_intersect(c) -> DataFrame:
    return c.book_authors.select(F.col("book_id").alias("id")).intersect(c.ranked_items.select("item_id"))


@plan("SELECT id FROM books EXCEPT SELECT item_id AS id FROM ranked_items")
def ext_except(c) -> DataFrame:
    return c.books.select("id").exceptAll(c.ranked_items.select("item_id")).distinct()


@plan("SELECT TIME_BUCKET(INTERVAL '1 hour', ts) AS hour, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(c) -> DataFrame:
    return c.events.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"))
