"""Queries on duplicates, merges and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities
from . import plan

SETS = "SELECT LOWER(s.title) AS title, a.artists, COUNT(*) AS n, MIN(s.id) AS keep_id FROM {items} s JOIN (SELECT {item} AS id, STRING_AGG(CAST({who} AS VARCHAR), ',' ORDER BY {who}) AS artists FROM (SELECT DISTINCT {item}, {who} FROM {links}) d GROUP BY {item}) a ON a.id = s.id GROUP BY LOWER(s.title), a.artists HAVING COUNT(*) > 1"
MERGES = "(SELECT CAST(id AS BIGINT) AS source_id, CAST(id - 100 AS BIGINT) AS target_id FROM books WHERE id >= 100 AND id < 200)"


def _merges(c) -> DataFrame:
    return c.books.where("id >= 100 and id < 200").select(F.col("id").alias("source_id"), (F.col("id") - 100).alias("target_id"))


@plan(SETS.format(items="songs", item="song_id", who="artist_id", links="song_artists"))
def duplicate_songs(c) -> DataFrame:
    found = entities.duplicate_titles(c.songs, c.song_artists, "song_id", "artist_id")
    return found.select("title", F.array_join(F.transform("artists", lambda x: x.cast("string")), ",").alias("artists"), "n", "keep_id")


@plan(SETS.format(items="books", item="book_id", who="author_id", links="book_authors"))
def duplicate_albums(c) -> DataFrame:
    found = entities.duplicate_titles(c.books, c.book_authors, "book_id", "author_id")
    return found.select("title", F.array_join(F.transform("artists", lambda x: x.cast("string")), ",").alias("artists"), "n", "keep_id")


@plan("SELECT LOWER(title) AS title, COUNT(*) AS n FROM songs GROUP BY LOWER(title) HAVING COUNT(*) > 1")
def same_title(c) -> DataFrame:
    return entities.same_title(c.songs)


@plan(f"SELECT list_id, COALESCE(m.target_id, li.listable_id) AS listable_id, MIN(position) AS position FROM list_items li LEFT JOIN {MERGES} m ON m.source_id = li.listable_id WHERE li.listable_id IS NOT NULL GROUP BY list_id, COALESCE(m.target_id, li.listable_id)")
def merge_entity(c) -> DataFrame:
    links = c.list_items.where("listable_id is not null").select("list_id", "listable_id", "position")
    return entities.merged_links(links, _merges(c), "listable_id", "list_id", "listable_id")


@plan(f"SELECT s.id, LEAST(s.release_year, COALESCE(t.y, s.release_year)) AS release_year FROM songs s LEFT JOIN (SELECT m.target_id, MIN(x.release_year) AS y FROM songs x JOIN {MERGES} m ON m.source_id = x.id GROUP BY m.target_id) t ON t.target_id = s.id WHERE s.id NOT IN (SELECT source_id FROM {MERGES} q)")
def merge_entity_years(c) -> DataFrame:
    return entities.merged_items(c.songs, _merges(c)).select("id", "release_year")


@plan(f"SELECT DISTINCT list_id FROM list_items WHERE listable_id IN (SELECT source_id FROM {MERGES} a UNION SELECT target_id FROM {MERGES} b)")
def merge_affected_lists(c) -> DataFrame:
    return entities.affected(c.list_items, _merges(c))


@plan("SELECT DISTINCT CASE WHEN category = 'Brand#3' THEN 'Brand#4' ELSE category END AS category, category_type, item_id FROM category_items")
def merge_category(c) -> DataFrame:
    names = c.categories.withColumn("alternative_names", F.lit(None).cast("array<string>"))
    return entities.merged_category(names, c.category_items, "Brand#3", "Brand#4")[1].select("category", "category_type", "item_id")


@plan("SELECT name, CASE WHEN name = 'Brand#4' THEN 'Brand#3' END AS alternatives, deleted OR name = 'Brand#3' AS deleted FROM categories")
def merge_category_names(c) -> DataFrame:
    names = c.categories.withColumn("alternative_names", F.lit(None).cast("array<string>"))
    merged = entities.merged_category(names, c.category_items, "Brand#3", "Brand#4")[0]
    return merged.select("name", F.array_join("alternative_names", ",").alias("alternatives"), "deleted")


@plan("SELECT book_id, id, popularity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY book_id ORDER BY popularity DESC NULLS LAST, id) AS n FROM editions) e WHERE n = 1")
def default_edition(c) -> DataFrame:
    return entities.default_editions(c.editions).select("book_id", "id", "popularity")


@plan("""
SELECT COUNT(*) FILTER (WHERE r.item_id IS NULL) AS missing, COUNT(*) FILTER (WHERE b.item_id IS NULL) AS extra, COUNT(*) FILTER (WHERE b.item_id IS NOT NULL AND r.item_id IS NOT NULL) AS shared
FROM (SELECT DISTINCT book_id AS item_id FROM book_authors) b FULL JOIN (SELECT DISTINCT item_id FROM ranked_items) r ON r.item_id = b.item_id
""")
def migration_verify(c) -> DataFrame:
    return entities.set_report(c.book_authors.select(F.col("book_id").alias("item_id")), c.ranked_items, "item_id")


@plan("SELECT k.id AS country_id, (SELECT COUNT(*) FROM book_countries b WHERE b.country_id = k.id) AS book_count FROM countries k")
def recount_counters(c) -> DataFrame:
    return entities.recounted(c.countries.select(F.col("id").alias("country_id")), c.book_countries, "country_id", "book_count")


WANTED = "(VALUES ('Voters unknown'), ('Few voters'), ('Brand new')) AS w(name)"
KNOWN = "(VALUES (1, 'Number of voters'), (2, 'Voters unknown'), (9, 'Voters unknown')) AS k(id, name)"


@plan(f"SELECT w.name, MIN(k.id) AS penalty_id FROM {WANTED} LEFT JOIN {KNOWN} ON k.name = CASE w.name WHEN 'Few voters' THEN 'Number of voters' ELSE w.name END GROUP BY w.name")
def penalty_resolver(c) -> DataFrame:
    wanted, known = c.spark.sql(f"SELECT * FROM {WANTED}"), c.spark.sql(f"SELECT * FROM {KNOWN}")
    return entities.resolved_penalties(wanted, known, {"Few voters": "Number of voters"}).select("name", "penalty_id")


@plan("SELECT CAST(2 AS BIGINT) AS ranking_configuration_id, id AS penalty_id, value FROM penalties")
def clone_config(c) -> DataFrame:
    config = c.spark.sql("SELECT CAST(1 AS BIGINT) AS id, true AS inherit_penalties")
    own = c.penalties.select(F.lit(1).cast("long").alias("ranking_configuration_id"), F.col("id").alias("penalty_id"), "value")
    return entities.cloned_config(config, own, 2)[1].select("ranking_configuration_id", "penalty_id", "value")


@plan("""
WITH w AS (SELECT id AS key, CASE WHEN id % 3 = 0 THEN id + 1900 END AS external_id, CASE WHEN id % 2 = 0 THEN CONCAT('Brand#3-', CAST(id % 500 AS STRING)) END AS identifier, CASE WHEN id % 5 = 0 THEN title ELSE 'none' END AS title FROM books),
c AS (SELECT TRIM(value) AS identifier, MIN(identifiable_id) AS m2 FROM identifiers GROUP BY TRIM(value)),
t AS (SELECT LOWER(title) AS title, MIN(id) AS m3 FROM books GROUP BY LOWER(title))
SELECT w.key, COALESCE(b.id, c.m2, t.m3) AS match_id, CASE WHEN b.id IS NOT NULL THEN 'external_id' WHEN c.m2 IS NOT NULL THEN 'identifier' WHEN t.m3 IS NOT NULL THEN 'title' ELSE 'none' END AS how
FROM w LEFT JOIN books b ON b.id = w.external_id LEFT JOIN c ON c.identifier = w.identifier LEFT JOIN t ON t.title = LOWER(w.title)
""")
def match_cascade(c) -> DataFrame:
    wanted = c.books.selectExpr("id as key", "case when id % 3 = 0 then id + 1900 end as external_id", "case when id % 2 = 0 then concat(' Brand#3-', id % 500) end as identifier", "case when id % 5 = 0 then title else 'none' end as title")
    return entities.match_cascade(wanted, c.books, c.identifiers)


@plan("SELECT li.list_id, li.listable_id FROM list_items li JOIN lists l ON l.id = li.list_id WHERE li.listable_id < 3 AND l.status = 1")
def type_compatibility(c) -> DataFrame:
    """Some items are given another type, which the check must find."""
    odd = c.list_items.join(c.lists.where("status = 1").select(F.col("id").alias("list_id"), F.lit(True).alias("open")), "list_id", "left").withColumn("listable_type", F.when((F.col("listable_id") < 3) & F.col("open"), "Games::Game").otherwise(F.col("listable_type")))
    return entities.type_violations(c.lists, odd).select("list_id", "listable_id")


@plan("SELECT list_id, listable_id FROM list_items WHERE listable_id IS NOT NULL AND listable_id NOT IN (SELECT item_id FROM ranked_items)")
def orphan_check(c) -> DataFrame:
    return entities.orphans(c.list_items, c.ranked_items, "listable_id", "item_id").select("list_id", "listable_id")


@plan("SELECT identifiable_id, identifier_type FROM identifiers WHERE TRIM(value) = 'Brand#4-2' AND identifier_type IN (0, 100, 200)")
def identifier_lookup(c) -> DataFrame:
    return entities.by_identifier(c.identifiers, " Brand#4-2", [0, 100, 200]).select("identifiable_id", "identifier_type")


@plan("SELECT event_id, CONCAT('{', CASE WHEN event_id % 2 = 1 THEN CONCAT('\"k\":', CAST(json_extract(props, '$.k') AS VARCHAR), ',') ELSE '' END, '\"n\":1,\"o\":{\"a\":[2,null]},\"verified\":false}') AS props FROM events")
def json_patch(c) -> DataFrame:
    gone, kept = (entities.patched(F.col("props"), x, {"n": 1, "o": {"a": [2, None]}, "verified": False}) for x in (["k"], []))
    return c.events.select("event_id", F.when(F.col("event_id") % 2 == 0, gone).otherwise(kept).alias("props"))
