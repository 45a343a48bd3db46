"""Duplicates, merges, identity and integrity of catalog entities."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ITEM_OF_LIST


def duplicate_titles(items: DataFrame, links: DataFrame, item: str, who: str) -> DataFrame:
    """Groups of items of equal title (in any case) and equal, non-empty sets of artists: size, ids, and the id to keep."""
    sets = links.groupBy(F.col(item).alias("id")).agg(F.sort_array(F.collect_set(who)).alias("artists"))
    return items.join(sets, "id").groupBy(F.lower("title").alias("title"), "artists").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")


def same_title(items: DataFrame) -> DataFrame:
    """Titles, in lower case, that several items share."""
    return items.groupBy(F.lower("title").alias("title")).agg(F.count("*").alias("n")).where("n > 1")


def merged_links(links: DataFrame, merges: DataFrame, key: str, *unique: str) -> DataFrame:
    """links with ``key`` moved along merges (source_id, target_id), one row for each unique key; ``verified`` is true if any was."""
    moved = links.join(merges, links[key] == merges["source_id"], "left").withColumn(key, F.coalesce("target_id", key)).drop("source_id", "target_id")
    rest = [c for c in links.columns if c not in unique]
    if not rest:
        return moved.select(*unique).distinct()
    aggs = [(F.max(c) if c == "verified" else F.min(c)).alias(c) for c in rest]
    return moved.groupBy(*unique).agg(*aggs)


def merged_items(items: DataFrame, merges: DataFrame) -> DataFrame:
    """items without merge sources; a target takes the earliest year of all that it takes in."""
    years = items.join(merges, items["id"] == merges["source_id"]).groupBy(F.col("target_id").alias("id")).agg(F.min("release_year").alias("merged_year"))
    left = items.join(merges.select(F.col("source_id").alias("id")), "id", "left_anti").join(years, "id", "left")
    return left.withColumn("release_year", F.least("release_year", "merged_year")).drop("merged_year")


def merged_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Relations (song_id, related_id) after merges, without those of an item to itself."""
    out = merged_links(relations, merges, "song_id", "song_id", "related_id")
    return merged_links(out, merges, "related_id", "song_id", "related_id").where("song_id <> related_id")


def affected(items: DataFrame, merges: DataFrame) -> DataFrame:
    """Lists whose rankings a merge changes."""
    touched = merges.select(F.explode(F.array("source_id", "target_id")).alias("listable_id")).distinct()
    return items.join(touched, "listable_id", "left_semi").select("list_id").distinct()


def merged_category(categories: DataFrame, links: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Categories and their items after one is merged into another, which takes its name as an alternative one; the source is deleted softly."""
    hit = F.col("name") == target
    names = F.when(hit, F.array_union(F.coalesce("alternative_names", F.array().cast("array<string>")), F.array(F.lit(source)))).otherwise(F.col("alternative_names"))
    counted = categories.withColumn("alternative_names", names).withColumn("deleted", F.col("deleted") | (F.col("name") == source))
    return counted, links.withColumn("category", F.when(F.col("category") == source, target).otherwise(F.col("category"))).distinct()


def first_by(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def default_editions(editions: DataFrame) -> DataFrame:
    return first_by(editions, "book_id", F.desc_nulls_last("popularity"), "id")


def set_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: keys only in the old set, only in the new one, and in both."""
    both = old.select(F.col(key)).distinct().withColumn("o", F.lit(1)).join(new.select(F.col(key)).distinct().withColumn("n", F.lit(1)), key, "full")
    return both.agg(F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("o").isNull(), 1)).alias("extra"), F.count(F.when(F.col("n").isNotNull() & F.col("o").isNotNull(), 1)).alias("shared"))


def recounted(parents: DataFrame, links: DataFrame, key: str, counter: str) -> DataFrame:
    """parents with the counter as it is in links, 0 for none."""
    counts = links.groupBy(key).agg(F.count("*").alias("_n"))
    return parents.join(counts, key, "left").withColumn(counter, F.coalesce("_n", F.lit(0))).drop("_n")


def resolved_penalties(wanted: DataFrame, known: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Each wanted name with the id of the known global penalty of that name or its alias; null where one has to be made."""
    renamed = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    return wanted.withColumn("resolved", F.coalesce(F.try_element_at(renamed, F.col("name")), F.col("name"))).join(F.broadcast(known.groupBy(F.col("name").alias("resolved")).agg(F.min("id").alias("penalty_id"))), "resolved", "left")


def cloned_config(config: DataFrame, applications: DataFrame, new_id: int) -> tuple[DataFrame, DataFrame]:
    """A configuration's copy and, if it inherits penalties, copies of their applications."""
    copy = config.withColumn("inherited_from_id", F.col("id")).withColumn("id", F.lit(new_id).cast("long"))
    own = applications.join(config.where("inherit_penalties").select(F.col("id").alias("ranking_configuration_id")), "ranking_configuration_id", "left_semi")
    return copy, own.withColumn("ranking_configuration_id", F.lit(new_id).cast("long"))


def match_cascade(wanted: DataFrame, items: DataFrame, identifiers: DataFrame) -> DataFrame:
    """wanted (key, external_id, identifier, title) with the first match: by external id, by identifier, by exact title in any case. ``how`` names it."""
    by_id = items.select(F.col("id").alias("m1"), F.col("id").alias("external_id"))
    by_code = identifiers.groupBy(F.trim("value").alias("identifier")).agg(F.min("identifiable_id").alias("m2"))
    by_title = items.groupBy(F.lower("title").alias("_title")).agg(F.min("id").alias("m3"))
    x = wanted.withColumn("identifier", F.trim("identifier")).withColumn("_title", F.lower("title"))
    x = x.join(by_id, "external_id", "left").join(by_code, "identifier", "left").join(by_title, "_title", "left")
    how = F.when(F.col("m1").isNotNull(), "external_id").when(F.col("m2").isNotNull(), "identifier").when(F.col("m3").isNotNull(), "title").otherwise("none")
    return x.select("key", F.coalesce("m1", "m2", "m3").alias("match_id"), how.alias("how"))


def type_violations(lists: DataFrame, items: DataFrame) -> DataFrame:
    """List items whose type is not that of their list."""
    table = F.create_map(*[F.lit(x) for kv in ITEM_OF_LIST.items() for x in kv])
    x = items.join(lists.select(F.col("id").alias("list_id"), "type"), "list_id")
    return x.where(F.col("listable_type").isNotNull() & ~F.coalesce(F.try_element_at(table, F.col("type")) == F.col("listable_type"), F.lit(False)))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent does not exist; null keys are none."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def by_identifier(identifiers: DataFrame, value: str, types: list[int]) -> DataFrame:
    return identifiers.where((F.trim("value") == value.strip()) & F.col("identifier_type").isin(*types))


def patched(document: Column, removed: list[str], added: dict[str, Any]) -> Column:
    """A JSON object's text without some keys and with others set. Values keep their types; what is no object counts as empty."""
    kept = F.map_filter(F.coalesce(F.from_json(document, "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, v: ~k.isin(*removed, *added))
    if not added:
        return F.to_json(kept)
    return F.to_json(F.map_concat(kept, F.create_map(*[x for k, v in added.items() for x in (F.lit(k), F.parse_json(F.lit(json.dumps(v))))])))


def renamed_category(categories: DataFrame, links: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Categories and their items after one is renamed: a new one takes the items and the old name as an alternative one, the old
    one is deleted softly. Where another has the new name in any case, the two are merged into it, and it is restored if it was deleted."""
    same = categories.where((F.lower("name") == new.lower()) & (F.col("name") != old)).select("name").orderBy("name").first()  # one row
    if same:
        restored = categories.withColumn("deleted", F.when(F.col("name") == same["name"], False).otherwise(F.col("deleted")))
        merged, moved = merged_category(restored, links, old, same["name"])
        return merged, moved
    none = F.array().cast("array<string>")
    made = categories.where(F.col("name") == old).withColumn("name", F.lit(new)).withColumn("alternative_names", F.array(F.lit(old))).withColumn("deleted", F.lit(False))
    kept = categories.withColumn("alternative_names", F.coalesce("alternative_names", none)).withColumn("deleted", F.col("deleted") | (F.col("name") == old))
    return kept.unionByName(made), links.withColumn("category", F.when(F.col("category") == old, new).otherwise(F.col("category"))).distinct()


def deleted_category(categories: DataFrame, links: DataFrame, name: str, soft: bool = True) -> tuple[DataFrame, DataFrame]:
    """Categories and their items without those of one; softly, the category itself stays and is marked."""
    left = links.where(~F.col("category").eqNullSafe(F.lit(name)))
    if soft:
        return categories.withColumn("deleted", F.col("deleted") | (F.col("name") == name)), left
    return categories.where(~F.col("name").eqNullSafe(F.lit(name))), left


def medium(kind: Column) -> Column:
    """The part of a type's name before its first colons: Books, Movies, Games, Music or Global."""
    return F.split_part(kind, F.lit("::"), F.lit(1))


def configuration_violations(ranked_lists: DataFrame, lists: DataFrame, configurations: DataFrame) -> DataFrame:
    """Ranked lists (list_id, ranking_configuration_id) whose list's type is not that of their configuration."""
    x = ranked_lists.join(lists.select(F.col("id").alias("list_id"), F.col("type").alias("list_type")), "list_id")
    x = x.join(configurations.select(F.col("id").alias("ranking_configuration_id"), F.col("type").alias("configuration_type")), "ranking_configuration_id")
    return x.where(F.regexp_replace("list_type", "List$", "") != F.regexp_replace("configuration_type", "RankingConfiguration$", ""))


def penalty_violations(links: DataFrame, penalties: DataFrame, owners: DataFrame, owner: str, static_only: bool = False) -> DataFrame:
    """Links (penalty_id, ``owner``) of penalties to lists or configurations of another medium, with ``reason``: ``medium``, or ``dynamic``
    where only static penalties may be linked. Global penalties fit all."""
    x = links.join(penalties.select(F.col("id").alias("penalty_id"), F.col("type").alias("penalty_type"), "dynamic_type"), "penalty_id")
    x = x.join(owners.select(F.col("id").alias(owner), F.col("type").alias("owner_type")), owner)
    dynamic = F.lit(static_only) & F.col("dynamic_type").isNotNull()
    odd = (F.col("penalty_type") != "Global::Penalty") & (medium(F.col("penalty_type")) != medium(F.col("owner_type")))
    return x.withColumn("reason", F.when(dynamic, "dynamic").when(odd, "medium")).where("reason is not null").select(*links.columns, "reason")
