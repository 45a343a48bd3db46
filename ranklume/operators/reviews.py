"""Reviews: summaries, statistics and lists of one user's reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import contains_ci
from ..functions.scoring import histogram_bar

STARS = range(1, 6)
SUMMARY = ["ratings_count", "ratings_sum", "text_reviews_count", *(f"rating_{n}_count" for n in STARS)]


def summaries(reviews: DataFrame) -> DataFrame:
    """Counts and sums of the reviews of each thing, in one aggregation."""
    has_text = F.trim(F.coalesce("body", F.lit(""))) != ""
    count = lambda c: F.count(F.when(c, 1))
    return reviews.groupBy("reviewable_id").agg(F.count("*").alias("ratings_count"), F.sum("rating").alias("ratings_sum"), count(has_text).alias("text_reviews_count"), *[count(F.col("rating") == n).alias(f"rating_{n}_count") for n in STARS])


def averages(found: DataFrame) -> DataFrame:
    """Mean rating (one decimal) and the percent of five-star ratings; null where nothing is rated."""
    rated = F.col("ratings_count") > 0
    return found.select("reviewable_id", F.when(rated, F.round(F.col("ratings_sum") / F.col("ratings_count"), 1)).alias("mean"), F.when(rated, F.round(100.0 * F.col("rating_5_count") / F.col("ratings_count"), 1)).alias("five_star_percentage"))


def user_stats(reviews: DataFrame, user_id: int) -> DataFrame:
    """A row for each number of stars, also those never given: count, and percent of the tallest."""
    stars = reviews.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    own = reviews.where(F.col("user_id") == user_id).groupBy("rating").agg(F.count("*").alias("n"))
    x = stars.join(own, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    tallest = x.agg(F.max("n").alias("tallest"), F.sum("n").alias("total"), F.sum(F.col("rating") * F.col("n")).alias("points"))
    return x.join(F.broadcast(tallest)).select("rating", "n", histogram_bar(F.col("n"), F.col("tallest")).alias("bar"), F.when(F.col("total") > 0, F.round(F.col("points") / F.col("total"), 1)).alias("mean"))


def user_reviews(reviews: DataFrame, books: DataFrame, ranked_items: DataFrame | None, user_id: int, *, rating: int | None = None, kind: str | None = None, text: str | None = None, sort: str = "newest") -> DataFrame:
    """One user's reviews with title and rank. kind: ``written`` or ``rated`` (no text). Unranked books stay; an unknown sort is ``newest``, ``rank`` without a ranking too."""
    own = reviews.where(F.col("user_id") == user_id)
    if rating is not None:
        own = own.where(F.col("rating") == rating)
    if kind in ("written", "rated"):
        own = own.where(F.col("body").isNotNull() if kind == "written" else F.col("body").isNull())
    out = own.join(books.select(F.col("id").alias("reviewable_id"), "title"), "reviewable_id", "left")
    if text and text.strip():
        out = out.where(contains_ci(F.col("title"), text) | contains_ci(F.col("body"), text))
    if ranked_items is None:
        out = out.withColumn("rank", F.lit(None).cast("int"))
    else:
        out = out.join(ranked_items.select(F.col("item_id").alias("reviewable_id"), "rank"), "reviewable_id", "left")
    orders = {"newest": [F.desc("created_at")], "oldest": [F.asc("created_at")], "highest": [F.desc("rating")], "lowest": [F.asc("rating")]}
    if ranked_items is not None:
        orders["rank"] = [F.asc_nulls_last("rank")]
    return out.orderBy(*orders.get(sort, orders["newest"]), "id")


def newest_per(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the largest id for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
