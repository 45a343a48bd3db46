"""Imported list items: matched in the catalog, else with a provider, else not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..registry import PROVIDERS


@PROVIDERS.add("catalog")
def catalog_matches(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """key, match_id and score: items (key, title, creators) whose title's words are those of a catalog entry (id, title, creators)
    and that share a creator's name with it, in any case and without accents; items without creators match by title. The lowest id is taken."""
    name = lambda c: F.array_join(terms(c), " ")
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), name)
    left = items.select("key", name(F.col("title")).alias("_title"), names(F.col("creators")).alias("_who")).where("_title <> ''")
    right = catalog.select(F.col("id").alias("match_id"), name(F.col("title")).alias("_title"), names(F.col("creators")).alias("_names"))
    found = left.join(right, "_title").where((F.size("_who") == 0) | F.arrays_overlap("_who", "_names"))
    return found.groupBy("key").agg(F.min("match_id").alias("match_id")).withColumn("score", F.lit(1.0))


@PROVIDERS.add("fetched")
def fetched_matches(items: DataFrame, answers: DataFrame, min_score: float = 0.0) -> DataFrame:
    """key, match_id and score: the best answer (key, external_id, score) that a provider has given for an item."""
    best = Window.partitionBy("key").orderBy(F.desc_nulls_last("score"), "external_id")
    first = answers.where(F.col("score") >= min_score).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return first.join(items.select("key").distinct(), "key", "left_semi").select("key", F.col("external_id").alias("match_id"), "score")


def enriched(items: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """items with ``matched_by`` (a provider's name, or not_found), ``match_id`` (as text) and ``score``. Each step (a provider's
    name and the rows it looks in) gets what its predecessors left, so a later one is never asked for what is matched."""
    left, found = items, None
    for name, rows in steps:
        hits = PROVIDERS.get(name)(left, rows).select("key", F.col("match_id").cast("string").alias("match_id"), "score", F.lit(name).alias("matched_by"))
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select("key"), "key", "left_anti")
    if found is None:
        return items.select("*", F.lit("not_found").alias("matched_by"), F.lit(None).cast("string").alias("match_id"), F.lit(None).cast("double").alias("score"))
    return items.join(found, "key", "left").withColumn("matched_by", F.coalesce("matched_by", F.lit("not_found")))


def imported(items: DataFrame, known: DataFrame, *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items to ask a provider for, and those that need nothing because their external id is known already; ``force`` asks for all."""
    there = known.select("external_id").where("external_id is not null").distinct()
    if force:
        return items, items.limit(0)
    return items.join(there, "external_id", "left_anti"), items.join(there, "external_id", "left_semi")
