"""Browsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse, ranking
from ..operators.browse import Choice, Shelf
from . import plan
from .rankings import MULTIPLIER, WEIGHT, _weights


def shelf(c) -> Shelf:
    return Shelf(c.ranked_items, c.books, c.category_items, c.book_countries, c.countries, c.book_authors, c.authors)


CHOICE = Choice(["ECONOMY", "Brand#2"], [0, 1, 2, 3, 4, 5, 6, 7, 8], (1955, 1999))
CHOSEN = """item_id IN (SELECT item_id FROM category_items WHERE category = 'ECONOMY') AND item_id IN (SELECT item_id FROM category_items WHERE category = 'Brand#2')
  AND item_id IN (SELECT id FROM books WHERE first_published_year BETWEEN 1955 AND 1999)"""
WIDE = Choice(["Brand#2"], [1, 2, 3], (1960, None))
WIDE_SQL = "item_id IN (SELECT item_id FROM category_items WHERE category = 'Brand#2') AND item_id IN (SELECT id FROM books WHERE first_published_year >= 1960)"


@plan(f"SELECT item_id, rank, score FROM ranked_items WHERE {CHOSEN} AND item_id IN (SELECT book_id FROM book_countries WHERE country_id BETWEEN 0 AND 8)")
def ranked_books(c) -> DataFrame:
    return browse.ranked_books(shelf(c), CHOICE).select("item_id", "rank", "score")


@plan("SELECT item_id, rank FROM ranked_items WHERE item_id IN (SELECT book_id FROM book_authors WHERE author_id IN (SELECT id FROM authors WHERE gender = 1))")
def ranked_collection_gender(c) -> DataFrame:
    return browse.ranked_books(shelf(c), Choice(collection="women")).select("item_id", "rank")


@plan("SELECT item_id, rank FROM ranked_items WHERE item_id IN (SELECT book_id FROM book_countries WHERE country_id IN (SELECT id FROM countries WHERE label = 'western'))")
def ranked_collection_label(c) -> DataFrame:
    return browse.ranked_books(shelf(c), Choice(collection="western")).select("item_id", "rank")


@plan("SELECT item_id, rank FROM ranked_items WHERE item_id IN (SELECT book_id FROM book_countries WHERE country_id IN (SELECT id FROM countries WHERE COALESCE(label, '') <> 'western'))")
def ranked_collection_negated(c) -> DataFrame:
    return browse.ranked_books(shelf(c), Choice(collection="non-western")).select("item_id", "rank")


@plan(f"SELECT category, COUNT(*) AS n FROM category_items WHERE category_type = 0 AND category <> 'Brand#2' AND item_id IN (SELECT item_id FROM ranked_items WHERE {WIDE_SQL} AND item_id IN (SELECT book_id FROM book_countries WHERE country_id IN (1, 2, 3))) GROUP BY category ORDER BY n DESC, category LIMIT 24")
def facet_genres(c) -> DataFrame:
    return browse.facet_genres(shelf(c), WIDE)


@plan(f"SELECT country_id, COUNT(*) AS n FROM book_countries WHERE country_id NOT IN (1, 2, 3) AND country_id IN (SELECT id FROM countries WHERE slug <> 'unknown') AND book_id IN (SELECT item_id FROM ranked_items WHERE {WIDE_SQL}) GROUP BY country_id ORDER BY n DESC, country_id LIMIT 24")
def facet_countries(c) -> DataFrame:
    return browse.facet_countries(shelf(c), WIDE)


@plan("SELECT k.name, n.n FROM categories k JOIN (SELECT category, COUNT(*) AS n FROM category_items WHERE item_id IN (SELECT item_id FROM ranked_items) GROUP BY category) n ON n.category = k.name WHERE k.category_type = 2 AND NOT k.deleted")
def browse_categories(c) -> DataFrame:
    names = c.categories.where("category_type = 2 and not deleted").select(F.col("name").alias("category"), "name")
    return browse.browse_counts(c.category_items, names, "category", c.ranked_items)


@plan("SELECT k.name, n.n FROM countries k JOIN (SELECT country_id, COUNT(*) AS n FROM book_countries WHERE book_id IN (SELECT item_id FROM ranked_items) GROUP BY country_id) n ON n.country_id = k.id")
def browse_countries(c) -> DataFrame:
    links = c.book_countries.select(F.col("book_id").alias("item_id"), "country_id")
    return browse.browse_counts(links, c.countries.select(F.col("id").alias("country_id"), "name"), "country_id", c.ranked_items, sort="name")


LISTS = f"WITH {WEIGHT}, w AS (SELECT id, CAST(ROUND(GREATEST(100 - LEAST(t, 100), 1)) AS INT) AS weight FROM weighted) SELECT l.id, l.name, l.year_published, w.weight FROM lists l JOIN w ON w.id = l.id WHERE l.status = 3"


@plan(f"{LISTS} AND (l.name ILIKE '%12%' OR l.source ILIKE '%12%' OR l.url ILIKE '%12%') ORDER BY weight DESC NULLS LAST, name, id")
def lists_by_weight(c) -> DataFrame:
    return browse.lists_page(c.lists, _weights(c), "12")


@plan(f"{LISTS} ORDER BY year_published DESC NULLS LAST, name, id")
def lists_newest(c) -> DataFrame:
    return browse.lists_page(c.lists, _weights(c), None, "newest")


@plan(f"""
WITH sums AS (
  SELECT ba.author_id, COUNT(*) AS books, SUM(r.score) AS total
  FROM ranked_items r JOIN book_authors ba ON ba.book_id = r.item_id AND ba.role = 0
  JOIN authors a ON a.id = ba.author_id AND NOT a.exclude_from_rankings WHERE r.score > 0 GROUP BY ba.author_id),
scored AS (SELECT author_id, CAST(ROUND(total * {MULTIPLIER}, 2) AS DECIMAL(20,2)) AS score FROM sums),
placed AS (SELECT author_id, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, author_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT a.id, a.name, p.rank FROM placed p JOIN authors a ON a.id = p.author_id ORDER BY p.rank
""")
def ranked_authors(c) -> DataFrame:
    found = ranking.author_ranking(c.ranked_items, c.book_authors, c.authors)
    return found.join(c.authors.select(F.col("id").alias("author_id"), "name"), "author_id").orderBy("rank").select(F.col("author_id").alias("id"), "name", "rank")


@plan("SELECT b.id, b.title, b.first_published_year, r.rank FROM book_authors a JOIN books b ON b.id = a.book_id LEFT JOIN ranked_items r ON r.item_id = b.id WHERE a.author_id = 7 AND a.role = 0")
def author_bibliography(c) -> DataFrame:
    return browse.bibliography(7, c.book_authors, c.books, c.ranked_items).select("id", "title", "first_published_year", "rank")


@plan("SELECT li.list_id, li.position, l.name FROM list_items li JOIN lists l ON l.id = li.list_id WHERE li.listable_id = 42 AND l.status = 3")
def item_list_appearances(c) -> DataFrame:
    return browse.appearances(42, c.list_items, c.lists, c.lists.select("id", F.lit(1).alias("weight")))


@plan("SELECT category, item_id, rank, title FROM (SELECT k.category, r.item_id, r.rank, b.title, ROW_NUMBER() OVER (PARTITION BY k.category ORDER BY r.rank, r.item_id) AS n FROM ranked_items r JOIN category_items k ON k.item_id = r.item_id JOIN books b ON b.id = r.item_id) t WHERE n <= 10")
def ranked_by_category(c) -> DataFrame:
    links = c.ranked_items.join(c.category_items, "item_id")
    return browse.top_per_group(links, "category", "rank", 10, "item_id").join(c.books.select(F.col("id").alias("item_id"), "title"), "item_id").select("category", "item_id", "rank", "title")


@plan("SELECT r.item_id, r.rank, s.title FROM ranked_items r JOIN songs s ON s.id = r.item_id WHERE s.release_year BETWEEN 1990 AND 1999 ORDER BY r.rank")
def ranked_by_year(c) -> DataFrame:
    from ..functions.predicates import parse_years, years_between

    years = parse_years("1990s")
    songs = c.songs.where(years_between(F.col("release_year"), years.start, years.end)).select(F.col("id").alias("item_id"), "title")
    return c.ranked_items.join(songs, "item_id").orderBy("rank").select("item_id", "rank", "title")


@plan("SELECT author_id, book_id, rank, place FROM (SELECT a.author_id, a.book_id, r.rank, CAST(ROW_NUMBER() OVER (PARTITION BY a.author_id ORDER BY r.rank, a.book_id) AS INT) AS place FROM book_authors a JOIN ranked_items r ON r.item_id = a.book_id) t WHERE place <= 3")
def top_n_per_author(c) -> DataFrame:
    links = c.book_authors.join(c.ranked_items.select(F.col("item_id").alias("book_id"), "rank"), "book_id")
    return browse.top_per_group(links, "author_id", "rank", 3, "book_id").select("author_id", "book_id", "rank", "place")


@plan("SELECT item_id, rank FROM ranked_items ORDER BY rank LIMIT 25 OFFSET 50")
def ranked_page(c) -> DataFrame:
    return browse.page(c.ranked_items, [F.asc("rank")], 3, 25).select("item_id", "rank")


@plan("SELECT item_id, rank, (SELECT COUNT(*) FROM ranked_items) AS total FROM ranked_items WHERE rank BETWEEN 51 AND 75")
def ranked_page_by_rank(c) -> DataFrame:
    """A page by its range of ranks: the scan is filtered, nothing is sorted or skipped."""
    total = c.ranked_items.agg(F.count("*").alias("total"))
    return c.ranked_items.where(F.col("rank").between(51, 75)).join(F.broadcast(total)).select("item_id", "rank", "total")
