"""Filters, joins and sorts that no composite query shows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import scopes
from . import plan


@plan("SELECT id FROM lists WHERE status IN (1, 3) AND type = 'Books::List' AND status NOT IN (0, 2) AND num_years_covered IS NULL AND number_of_voters IS NOT NULL")
def filter_equality(c) -> DataFrame:
    return c.lists.where(F.col("status").isin(1, 3) & (F.col("type") == "Books::List") & ~F.col("status").isin(0, 2) & F.col("num_years_covered").isNull() & F.col("number_of_voters").isNotNull()).select("id")


@plan("SELECT id FROM books WHERE first_published_year BETWEEN 1960 AND 1969 OR first_published_year >= 1999")
def filter_years(c) -> DataFrame:
    years, since = p.parse_years("1960s"), p.parse_years("1999", "since")
    year = F.col("first_published_year")
    return c.books.where(p.years_between(year, years.start, years.end) | p.years_between(year, since.start, since.end)).select("id")


@plan("SELECT id FROM lists WHERE name ILIKE '%LIST 1%' AND NOT name ILIKE '%\\%%' ESCAPE '\\'")
def filter_text(c) -> DataFrame:
    return c.lists.where(p.contains_ci(F.col("name"), "LIST 1") & ~p.contains_ci(F.col("name"), "%")).select("id")


@plan("SELECT name FROM categories WHERE LOWER(name) = 'economy' OR LOWER(name) = 'brand#2'")
def filter_equal_ci(c) -> DataFrame:
    return c.categories.where(p.equal_ci(F.col("name"), "Economy") | p.equal_ci(F.col("name"), "BRAND#2")).select("name")


@plan("SELECT id, COALESCE(label = 'western', FALSE) AS western, COALESCE(label <> 'western', TRUE) AS other, COALESCE(label = 'asian', FALSE) AS named FROM countries")
def filter_labels(c) -> DataFrame:
    labels = F.when(F.col("label").isNotNull(), F.array("label")).otherwise(F.array().cast("array<string>"))
    x = c.countries.withColumn("labels", labels)
    return x.select("id", p.has_label(F.col("labels"), "western").alias("western"), p.lacks_label(F.col("labels"), "western").alias("other"), p.any_equal_ci(F.col("labels"), "ASIAN").alias("named"))


@plan("SELECT event_id FROM events WHERE json_extract_string(props, '$.done') IS NULL AND json_extract_string(props, '$.k') <> '7'")
def filter_json(c) -> DataFrame:
    return c.events.where(p.json_flag_unset(F.col("props"), "$.done") & (F.get_json_object("props", "$.k") != "7")).select("event_id")


@plan("SELECT name, item_count FROM categories WHERE name ILIKE '%brand#1%' ORDER BY item_count DESC, name LIMIT 10")
def name_search(c) -> DataFrame:
    return c.categories.where(p.named_like(F.col("name"), " brand#1 ")).orderBy(F.desc("item_count"), "name").limit(10).select("name", "item_count")


@plan("SELECT id, title FROM songs WHERE release_year BETWEEN 1960 AND 1970 AND id IN (SELECT song_id FROM song_artists WHERE artist_id = 3)")
def model_scopes(c) -> DataFrame:
    return scopes.linked(scopes.released(c.songs, 1960, 1970), c.song_artists, "song_id", artist_id=3).select("id", "title")


GAMES = "SELECT id, title, release_year, CAST(id % 4 AS INT) AS game_type, CASE WHEN id % 8 = 0 THEN id % 50 END AS series_id FROM songs"


@plan(f"SELECT id, title FROM ({GAMES}) g WHERE game_type IN (0, 1, 2) AND release_year >= 1975 AND id IN (SELECT song_id FROM song_artists WHERE artist_id = 4)")
def game_scopes(c) -> DataFrame:
    games = c.songs.selectExpr("id", "title", "release_year", "cast(id % 4 as int) as game_type")
    companies = c.song_artists.withColumn("developer", F.lit(True))
    return scopes.linked(scopes.released(scopes.games_of(games, *scopes.STANDALONE_GAMES), 1975), companies, "song_id", artist_id=4, developer=True).select("id", "title")


@plan(f"SELECT id, title, series_id FROM ({GAMES}) g WHERE series_id = 16 OR id IN (SELECT identifiable_id FROM identifiers WHERE identifier_type = 100 AND value = ' Brand#3-77 ')")
def item_scopes(c) -> DataFrame:
    games = c.songs.selectExpr("id", "title", "case when id % 8 = 0 then id % 50 end as series_id")
    return scopes.in_series(games, 16).unionByName(scopes.with_identifier(games, c.identifiers, 100, " Brand#3-77 ")).distinct()


@plan("SELECT id, CAST(NULL AS INT) AS rank, 2 * id AS twice FROM authors")
def typed_null(c) -> DataFrame:
    return c.authors.select("id", F.lit(None).cast("int").alias("rank"), (2 * F.col("id")).alias("twice"))


@plan("SELECT b.id, b.first_published_year > 1990 OR k.id IS NOT NULL AS flag FROM books b LEFT JOIN (SELECT DISTINCT book_id AS id FROM book_authors) k ON k.id = b.id")
def exists_or_filter(c) -> DataFrame:
    known = c.book_authors.select(F.col("book_id").alias("id")).distinct().withColumn("known", F.lit(True))
    return c.books.join(known, "id", "left").select("id", ((F.col("first_published_year") > 1990) | F.col("known").isNotNull()).alias("flag"))


@plan("SELECT a.name, b.name AS parent, b.item_count AS parent_items FROM categories a LEFT JOIN categories b ON b.name = a.parent")
def parent_categories(c) -> DataFrame:
    up = c.categories.select(F.col("name").alias("parent"), F.col("item_count").alias("parent_items"))
    return c.categories.select("name", "parent").join(up, "parent", "left").select("name", "parent", "parent_items")


@plan("SELECT DISTINCT s.artist_id, li.list_id FROM song_artists s JOIN list_items li ON li.listable_id = s.song_id JOIN lists l ON l.id = li.list_id AND l.status = 3 WHERE s.artist_id < 3")
def through_chain(c) -> DataFrame:
    active = c.lists.where("status = 3").select(F.col("id").alias("list_id"))
    links = c.song_artists.where("artist_id < 3").join(c.list_items.select(F.col("listable_id").alias("song_id"), "list_id"), "song_id")
    return links.join(active, "list_id", "left_semi").select("artist_id", "list_id").distinct()


@plan("SELECT b.id, COALESCE(e.edition, -1) AS edition FROM books b LEFT JOIN (SELECT book_id, MIN(id) AS edition FROM editions GROUP BY book_id) e ON e.book_id = b.id")
def update_from_join(c) -> DataFrame:
    first = c.editions.groupBy(F.col("book_id").alias("id")).agg(F.min("id").alias("edition"))
    return c.books.join(first, "id", "left").select("id", F.coalesce("edition", F.lit(-1)).alias("edition"))


@plan("SELECT id, name FROM lists ORDER BY name DESC NULLS LAST, id")
def whitelisted_sort(c) -> DataFrame:
    return c.lists.orderBy(*p.sort_columns("name", "DESC", {"name": "name", "year": "year_published"}, "name")).select("id", "name")


@plan("SELECT id, num_years_covered FROM lists ORDER BY num_years_covered DESC NULLS FIRST, id")
def nulls_first(c) -> DataFrame:
    return c.lists.orderBy(F.desc_nulls_first("num_years_covered"), "id").select("id", "num_years_covered")


@plan("SELECT id, COALESCE(page_range, title) AS sort_title FROM books ORDER BY COALESCE(page_range, title), id")
def coalesced_sort(c) -> DataFrame:
    return c.books.select("id", F.coalesce("page_range", "title").alias("sort_title")).orderBy("sort_title", "id")
