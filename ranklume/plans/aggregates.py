"""Aggregations and set operations that no composite query shows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, ranking
from . import plan


@plan("SELECT status, COUNT(*) AS n FROM lists GROUP BY status")
def grouped_count(c) -> DataFrame:
    return c.lists.groupBy("status").agg(F.count("*").alias("n"))


@plan("SELECT l.id, COUNT(DISTINCT p.penalty_id) AS penalties FROM lists l LEFT JOIN list_penalties p ON p.list_id = l.id GROUP BY l.id")
def distinct_count_left(c) -> DataFrame:
    return c.lists.join(c.list_penalties, F.col("id") == F.col("list_id"), "left").groupBy("id").agg(F.countDistinct("penalty_id").alias("penalties"))


@plan("SELECT MIN(y) AS earliest, MAX(y) AS latest FROM (SELECT first_published_year AS y FROM books UNION ALL SELECT release_year AS y FROM songs) t")
def year_span(c) -> DataFrame:
    both = c.books.select(F.col("first_published_year").alias("y")).unionAll(c.songs.select("release_year"))
    return both.agg(F.min("y").alias("earliest"), F.max("y").alias("latest"))


@plan("SELECT item_id, STRING_AGG(category, ',' ORDER BY category_type, category) AS categories FROM category_items GROUP BY item_id")
def grouped_names(c) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("category_type", "category")))
    return c.category_items.groupBy("item_id").agg(F.array_join(F.transform(rows, lambda r: r["category"]), ",").alias("categories"))


@plan("SELECT book_id, author_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY book_id ORDER BY position, author_id) AS n FROM book_authors) a WHERE n = 1")
def first_per_group(c) -> DataFrame:
    return entities.first_by(c.book_authors, "book_id", "position", "author_id").select("book_id", "author_id")


@plan("SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part")
def sequential_rank(c) -> DataFrame:
    return ranking.ranked(c.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").select("p_partkey", "rank")


@plan("SELECT book_id AS id FROM book_authors UNION SELECT item_id AS id FROM ranked_items")
def union_distinct(c) -> DataFrame:
    return c.book_authors.select(F.col("book_id").alias("id")).unionAll(c.ranked_items.select("item_id")).distinct()


@plan("SELECT DISTINCT category, category_type FROM category_items")
def distinct_rows(c) -> DataFrame:
    return c.category_items.select("category", "category_type").dropDuplicates()
