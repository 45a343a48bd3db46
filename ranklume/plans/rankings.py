"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import canon, ranking
from ..schemas import DESCRIPTION_SOURCES
from . import plan

MULTIPLIER = "CASE WHEN books >= 6 THEN CAST(1 AS DECIMAL(18,17)) WHEN books = 5 THEN CAST(0.9722222222222222 AS DECIMAL(18,17)) WHEN books = 4 THEN CAST(0.8888888888888888 AS DECIMAL(18,17)) WHEN books = 3 THEN CAST(0.75 AS DECIMAL(18,17)) WHEN books = 2 THEN CAST(0.5555555555555555 AS DECIMAL(18,17)) ELSE CAST(0.30555555555555547 AS DECIMAL(18,17)) END"


@plan(f"""
WITH sums AS (
  SELECT ba.author_id, COUNT(*) AS books, SUM(r.score) AS total
  FROM ranked_items r JOIN book_authors ba ON ba.book_id = r.item_id AND ba.role = 0
  JOIN authors a ON a.id = ba.author_id AND NOT a.exclude_from_rankings WHERE r.score > 0 GROUP BY ba.author_id),
scored AS (SELECT author_id, books, CAST(ROUND(total * {MULTIPLIER}, 2) AS DECIMAL(20,2)) AS score FROM sums)
SELECT author_id, books, score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, author_id) AS INT) AS rank FROM scored WHERE score > 0
""")
def author_ranking(c) -> DataFrame:
    return ranking.author_ranking(c.ranked_items, c.book_authors, c.authors)


@plan("""
SELECT CAST(MEDIAN(number_of_voters) AS DOUBLE) AS median_voters FROM (
  SELECT number_of_voters FROM lists WHERE number_of_voters <> 1
  UNION ALL SELECT DISTINCT number_of_voters FROM lists WHERE number_of_voters = 1) v
""")
def median_voter_count(c) -> DataFrame:
    return ranking.median_voter_count(c.lists)


@plan("SELECT CAST(COALESCE(MEDIAN(n), 0) AS DOUBLE) AS median_items FROM (SELECT list_id, COUNT(*) AS n FROM list_items JOIN lists ON lists.id = list_id WHERE type = 'Books::List' GROUP BY list_id) s")
def median_list_count(c) -> DataFrame:
    return ranking.median_list_count(c.lists, c.list_items, "Books::List")


WESTERN = "SELECT li.list_id, ROUND(100.0 * COUNT(w.book_id) / COUNT(*), 2) AS percentage_western FROM list_items li LEFT JOIN (SELECT DISTINCT bc.book_id FROM book_countries bc JOIN countries n ON n.id = bc.country_id WHERE n.label = 'western') w ON w.book_id = li.listable_id WHERE li.listable_id IS NOT NULL GROUP BY li.list_id"


@plan(WESTERN.replace("ROUND(100.0 * COUNT(w.book_id) / COUNT(*), 2)", "CAST(ROUND(100.0 * COUNT(w.book_id) / COUNT(*), 2) AS DOUBLE)"))
def percentage_western(c) -> DataFrame:
    return ranking.percentage_western(c.list_items, c.book_countries, c.countries).withColumn("percentage_western", F.col("percentage_western").cast("double"))


@plan("""
SELECT li.list_id, li.listable_id,
  ROUND(CASE WHEN l.yearly_award OR b.first_published_year IS NULL THEN 0.8
    WHEN l.year_published IS NULL THEN NULL WHEN l.year_published - b.first_published_year <= 0 THEN 0.8
    WHEN l.year_published - b.first_published_year >= 50 THEN NULL
    ELSE (50.0 - (l.year_published - b.first_published_year)) / 50.0 * 0.8 END, 6) AS penalty
FROM list_items li JOIN lists l ON l.id = li.list_id LEFT JOIN books b ON b.id = li.listable_id WHERE li.listable_id IS NOT NULL
""")
def date_penalty(c) -> DataFrame:
    x = c.list_items.where("listable_id is not null").join(c.lists.select(F.col("id").alias("list_id"), "year_published", "yearly_award"), "list_id").join(c.books.select(F.col("id").alias("listable_id"), "first_published_year"), "listable_id", "left")
    return x.select("list_id", "listable_id", F.round(scoring.date_penalty(F.col("year_published"), F.col("first_published_year"), F.col("yearly_award"), 50, 80), 6).alias("penalty"))


WEIGHT = f"""
sums AS (SELECT {", ".join(f"COALESCE(SUM(CASE WHEN dynamic_type = {i} THEN value END), 0) AS m{i}" for i in range(9))} FROM penalties),
static AS (SELECT lp.list_id, SUM(p.value) AS v FROM list_penalties lp JOIN penalties p ON p.id = lp.penalty_id AND p.dynamic_type IS NULL GROUP BY lp.list_id),
west AS ({WESTERN}),
parts AS (
  SELECT l.id, l.high_quality_source, COALESCE(s.v, 0)
    + CASE WHEN number_of_voters IS NULL THEN 0 WHEN number_of_voters <= 1 THEN m0 WHEN number_of_voters > 50 THEN 0 ELSE LEAST(GREATEST(m0 * POW(1 - number_of_voters / 50.0, 2), 0), m0) END
    + CASE WHEN voter_names_unknown THEN m2 ELSE 0 END + CASE WHEN voter_count_unknown THEN m3 ELSE 0 END + CASE WHEN voter_count_estimated THEN m7 ELSE 0 END
    + CASE WHEN category_specific THEN m4 ELSE 0 END + CASE WHEN location_specific THEN m5 ELSE 0 END + CASE WHEN creator_specific THEN m8 ELSE 0 END
    + CASE WHEN NOT location_specific AND w.percentage_western >= 90 THEN m1 ELSE 0 END
    + CASE WHEN num_years_covered IS NULL OR num_years_covered >= 5025 THEN 0 ELSE LEAST(GREATEST(m6 * POW(1 - num_years_covered / 5025.0, 2), 0), m6) END AS total
  FROM lists l LEFT JOIN static s ON s.list_id = l.id LEFT JOIN west w ON w.list_id = l.id CROSS JOIN sums),
weighted AS (
  SELECT id, CASE WHEN high_quality_source THEN total * 2.0 / 3 ELSE total END AS t FROM parts)
"""


def _weights(c) -> DataFrame:
    return ranking.list_weight(c.lists, c.penalties, c.list_penalties, ranking.percentage_western(c.list_items, c.book_countries, c.countries))


@plan(f"WITH {WEIGHT} SELECT id, CAST(ROUND(t, 4) AS DOUBLE) AS penalty_percentage, CAST(ROUND(GREATEST(100 - LEAST(t, 100), 1)) AS INT) AS weight FROM weighted")
def list_weight(c) -> DataFrame:
    return _weights(c).select("id", F.round("penalty_percentage", 4).alias("penalty_percentage"), "weight")


@plan(f"""
WITH {WEIGHT},
w AS (SELECT id, CAST(ROUND(GREATEST(100 - LEAST(t, 100), 1)) AS INT) AS weight FROM weighted),
med AS (SELECT COALESCE(MEDIAN(n), 0) AS m FROM (SELECT list_id, COUNT(*) AS n FROM list_items JOIN lists ON lists.id = list_id WHERE type = 'Books::List' GROUP BY list_id) s),
parts AS (
  SELECT li.listable_id AS item_id, w.weight * (1 + 3.0 / 100 * POW(1 - (LEAST(GREATEST(COALESCE(li.position, GREATEST(m, 1)), 1), GREATEST(m, 1)) - 1) / GREATEST(m, 1), 3))
    * (1 - COALESCE(CASE WHEN l.yearly_award OR b.first_published_year IS NULL THEN 0.8
    WHEN l.year_published IS NULL THEN NULL WHEN l.year_published - b.first_published_year <= 0 THEN 0.8
    WHEN l.year_published - b.first_published_year >= 50 THEN NULL
    ELSE (50.0 - (l.year_published - b.first_published_year)) / 50.0 * 0.8 END, 0)) AS part
  FROM list_items li JOIN lists l ON l.id = li.list_id AND l.status = 3 JOIN w ON w.id = l.id LEFT JOIN books b ON b.id = li.listable_id CROSS JOIN med WHERE li.listable_id IS NOT NULL),
scores AS (SELECT item_id, ROUND(SUM(CAST(part AS DECIMAL(28,10))), 2) AS score FROM parts GROUP BY item_id)
SELECT item_id, CAST(score AS DECIMAL(20,2)) AS score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, item_id) AS INT) AS rank FROM scores
""".replace("parts AS (\n  SELECT li.", "contributions AS (\n  SELECT li.").replace("FROM parts GROUP BY item_id", "FROM contributions GROUP BY item_id"))
def item_ranking(c) -> DataFrame:
    """The pipeline of the master ranking. Its kernel is a placeholder: the SQL repeats it, so this checks the pipeline only."""
    median = ranking.median_list_count(c.lists, c.list_items, "Books::List")
    return ranking.ranked(ranking.item_scores(c.lists, c.list_items, _weights(c), c.books, median=median), most=c.lineitem.count())


@plan("""
WITH a AS (SELECT ba.author_id AS artist_id, SUM(r.score) AS s FROM ranked_items r JOIN book_authors ba ON ba.book_id = r.item_id WHERE r.item_id % 2 = 0 GROUP BY ba.author_id),
s AS (SELECT sa.artist_id, SUM(r.score) AS s FROM ranked_items r JOIN song_artists sa ON sa.song_id = r.item_id WHERE r.item_id % 2 = 1 GROUP BY sa.artist_id),
t AS (SELECT COALESCE(a.artist_id, s.artist_id) AS artist_id, CAST(COALESCE(a.s, 0) + COALESCE(s.s, 0) AS DECIMAL(20,2)) AS score FROM a FULL JOIN s ON a.artist_id = s.artist_id)
SELECT artist_id, score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, artist_id) AS INT) AS rank FROM t WHERE score > 0
""")
def artist_ranking(c) -> DataFrame:
    albums, songs = c.ranked_items.where("item_id % 2 = 0"), c.ranked_items.where("item_id % 2 = 1")
    return ranking.artist_ranking(albums, songs, c.book_authors.select(F.col("book_id").alias("album_id"), F.col("author_id").alias("artist_id")), c.song_artists)


@plan(f"""
SELECT describable_id, kind, locale, id, source FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY describable_id, kind, locale ORDER BY rank DESC, CASE source {" ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(DESCRIPTION_SOURCES))} ELSE 99 END, id) AS n
  FROM descriptions WHERE rank >= 0) d WHERE n = 1
""")
def description_resolver(c) -> DataFrame:
    return ranking.resolved_descriptions(c.descriptions, DESCRIPTION_SOURCES).select("describable_id", "kind", "locale", "id", "source")


@plan("""
SELECT id, CAST(CASE WHEN p IS NULL THEN NULL WHEN p <= 149 THEN 0 WHEN p <= 250 THEN 1 WHEN p <= 350 THEN 2 WHEN p <= 500 THEN 3 WHEN p <= 1000 THEN 4 ELSE 5 END AS INT) AS band FROM (
  SELECT id, CASE WHEN page_range IS NULL THEN ROUND(word_count / 275.0) WHEN REGEXP_MATCHES(page_range, '[a-zA-Z]') THEN NULL
    WHEN page_range NOT LIKE '%-%' THEN CAST(page_range AS INT)
    ELSE ROUND((CAST(SPLIT_PART(page_range, '-', 1) AS INT) + CAST(SPLIT_PART(page_range, '-', 2) AS INT)) / 2.0) END AS p FROM books) b
""")
def book_length(c) -> DataFrame:
    return c.books.select("id", scoring.book_length(F.col("page_range"), F.col("word_count")).alias("band"))


@plan()
def global_canon(c) -> DataFrame:
    """Tested against a fold in Python: SQL has no order-dependent selection of this kind."""
    found = canon.candidates(c.ranked_items, c.category_items, "ECONOMY", "SMALL", ["Brand#3"], canon.first_per_book(c.book_countries, "country_id", "country_id"), canon.first_per_book(c.book_authors, "author_id", "position", "author_id"))
    return canon.global_canon(found).select("requested", "delivered", "blocked_by_country", "blocked_by_author", F.explode("picked").alias("p")).select("p.item_id", "p.rank", "requested", "delivered", "blocked_by_country", "blocked_by_author")
