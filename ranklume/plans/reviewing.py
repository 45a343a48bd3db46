"""Review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reviews
from . import plan

COUNTS = "COUNT(*) AS ratings_count, CAST(SUM(rating) AS BIGINT) AS ratings_sum, COUNT(*) FILTER (WHERE TRIM(COALESCE(body, '')) <> '') AS text_reviews_count, " + ", ".join(f"COUNT(*) FILTER (WHERE rating = {n}) AS rating_{n}_count" for n in range(1, 6))


@plan(f"SELECT reviewable_id, {COUNTS} FROM reviews GROUP BY reviewable_id")
def review_summary(c) -> DataFrame:
    return reviews.summaries(c.reviews)


@plan(f"SELECT reviewable_id, CAST(ROUND(ratings_sum / ratings_count, 1) AS DOUBLE) AS mean, CAST(ROUND(100.0 * rating_5_count / ratings_count, 1) AS DOUBLE) AS five_star_percentage FROM (SELECT reviewable_id, {COUNTS} FROM reviews GROUP BY reviewable_id) s")
def review_averages(c) -> DataFrame:
    return reviews.averages(reviews.summaries(c.reviews)).withColumn("five_star_percentage", F.col("five_star_percentage").cast("double"))


@plan("""
WITH n AS (SELECT s.rating, COUNT(r.id) AS n FROM (VALUES (1), (2), (3), (4), (5)) AS s(rating) LEFT JOIN reviews r ON r.rating = s.rating AND r.user_id = 11 GROUP BY s.rating)
SELECT CAST(rating AS INT) AS rating, n, CAST(ROUND(100.0 * n / (SELECT MAX(n) FROM n)) AS INT) AS bar, ROUND((SELECT SUM(rating * n) / SUM(n) FROM n), 1) AS mean FROM n
""")
def review_stats(c) -> DataFrame:
    return reviews.user_stats(c.reviews, 11)


MINE = "SELECT r.id, r.reviewable_id, r.rating, b.title, k.rank FROM reviews r LEFT JOIN books b ON b.id = r.reviewable_id LEFT JOIN ranked_items k ON k.item_id = r.reviewable_id WHERE r.user_id = 11"


@plan(f"{MINE} AND r.rating >= 3 AND r.rating <= 3 AND (b.title ILIKE '%ring%' OR r.body ILIKE '%ring%')")
def my_reviews(c) -> DataFrame:
    return reviews.user_reviews(c.reviews, c.books, c.ranked_items, 11, rating=3, text="ring", sort="rank").select("id", "reviewable_id", "rating", "title", "rank")


@plan(f"{MINE} AND r.body IS NOT NULL")
def my_written_reviews(c) -> DataFrame:
    return reviews.user_reviews(c.reviews, c.books, c.ranked_items, 11, kind="written").select("id", "reviewable_id", "rating", "title", "rank")


@plan("SELECT id, user_id, reviewable_id, rating FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, reviewable_id ORDER BY id DESC) AS n FROM raw_reviews) r WHERE n = 1")
def review_dedup(c) -> DataFrame:
    return reviews.newest_per(c.raw_reviews, "user_id", "reviewable_id").select("id", "user_id", "reviewable_id", "rating")
