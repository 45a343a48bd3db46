"""The driver's tables as a catalog of lists, items, creators and reviews.

Stand-ins, not real data: the same SQL builds each view in Spark and in the SQL
that checks it. A view may read tables and views that stand before it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS: dict[str, str] = {
    "lists": """SELECT CAST(o_orderkey AS BIGINT) AS id, 'Books::List' AS type, CONCAT('List ', CAST(o_orderkey AS STRING)) AS name,
        CONCAT('Paper ', CAST(o_custkey % 70 AS STRING)) AS source, CONCAT('https://lists.example/', CAST(o_custkey AS STRING)) AS url,
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 3 END AS status, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year_published,
        CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 100 + 1 AS INT) END AS number_of_voters,
        CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey % 60 + 1 AS INT) END AS num_years_covered,
        o_orderpriority LIKE '1%' AS high_quality_source, o_orderpriority LIKE '5%' AS yearly_award,
        o_custkey % 11 = 0 AS voter_names_unknown, o_custkey % 9 = 0 AS voter_count_unknown,
        o_custkey % 13 = 0 AS location_specific, o_orderkey % 17 = 0 AS category_specific,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey % 31 = 0 END AS voter_count_estimated, o_orderkey % 37 = 0 AS creator_specific
        FROM orders""",
    "list_items": """SELECT CAST(l_orderkey AS BIGINT) AS list_id, 'Books::Book' AS listable_type,
        CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS listable_id, MIN(CAST(l_linenumber AS INT)) AS position
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "books": """SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS title,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(2001 - p_size AS INT) END AS first_published_year, CAST(p_size % 6 AS INT) AS book_length,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 7 AS BIGINT) END AS language_id,
        CASE WHEN p_partkey % 4 = 0 THEN CONCAT(CAST(p_size AS STRING), '-', CAST(p_size * 9 AS STRING)) WHEN p_partkey % 4 = 1 THEN CONCAT('p. ', CAST(p_size AS STRING)) WHEN p_partkey % 4 = 2 THEN CAST(p_size * 7 AS STRING) END AS page_range,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 6000 AS INT) END AS word_count
        FROM part""",
    "authors": """SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CAST(s_suppkey % 4 AS INT) AS gender, s_suppkey % 25 = 0 AS exclude_from_rankings FROM supplier""",
    "book_authors": """SELECT CAST(l_partkey AS BIGINT) AS book_id, CAST(l_suppkey AS BIGINT) AS author_id, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS role,
        CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS INT) AS position
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49) d""",
    "countries": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey = 24 THEN 'unknown' ELSE LOWER(n_name) END AS slug,
        CASE n_regionkey WHEN 0 THEN 'african' WHEN 1 THEN 'western' WHEN 2 THEN 'asian' WHEN 3 THEN 'western' END AS label FROM nation""",
    "book_countries": """SELECT DISTINCT ba.book_id, CAST(s.s_nationkey AS BIGINT) AS country_id FROM book_authors ba JOIN supplier s ON s.s_suppkey = ba.author_id""",
    "category_items": """SELECT DISTINCT category, category_type, item_id FROM (
        SELECT p_type AS category, 0 AS category_type, CAST(p_partkey AS BIGINT) AS item_id FROM part
        UNION ALL SELECT p_brand AS category, 2 AS category_type, CAST(p_partkey AS BIGINT) AS item_id FROM part) c""",
    "categories": """SELECT category AS name, category_type, CAST(COUNT(*) AS BIGINT) AS item_count, category = 'Brand#7' AS deleted, CAST(NULL AS STRING) AS parent FROM category_items WHERE category_type = 0 GROUP BY category, category_type
        UNION ALL SELECT category AS name, category_type, CAST(COUNT(*) AS BIGINT) AS item_count, category = 'Brand#7' AS deleted, CASE WHEN category LIKE 'Brand#1%' THEN 'ECONOMY' END AS parent FROM category_items WHERE category_type = 2 GROUP BY category, category_type""",
    "ranked_items": """SELECT item_id, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, item_id ASC) AS INT) AS rank, score FROM (
        SELECT li.listable_id AS item_id, CAST(ROUND(SUM(CAST(100 AS DECIMAL(10,2)) / li.position), 2) AS DECIMAL(10,2)) AS score
        FROM list_items li JOIN lists l ON l.id = li.list_id
        WHERE l.status = 3 AND li.listable_id IS NOT NULL AND li.listable_id % 10 <> 0 GROUP BY li.listable_id) s""",
    "reviews": """SELECT id, user_id, reviewable_id, rating, body, created_at FROM (
        SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, CAST(event_id % 200 + 1 AS BIGINT) AS reviewable_id,
        CAST(FLOOR(value) AS INT) % 5 + 1 AS rating, CASE WHEN event_type = 'purchase' THEN props END AS body, ts AS created_at,
        ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 200 ORDER BY event_id DESC) AS rn
        FROM events WHERE event_type IN ('view','click','purchase')) r WHERE rn = 1""",
    "raw_reviews": """SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, CAST(event_id % 200 + 1 AS BIGINT) AS reviewable_id, CAST(FLOOR(value) AS INT) % 5 + 1 AS rating FROM events""",
    "penalties": """SELECT * FROM (VALUES (1, CAST(NULL AS INT), 10), (2, CAST(NULL AS INT), 25), (3, 0, 40), (4, 1, 10), (5, 2, 5), (6, 3, 15), (7, 4, 8), (8, 5, 12), (9, 6, 30), (10, 7, 6), (11, 8, 20), (12, 5, 3)) AS p(id, dynamic_type, value)""",
    "list_penalties": """SELECT id AS list_id, 1 AS penalty_id FROM lists WHERE id % 23 = 0 UNION ALL SELECT id AS list_id, 2 AS penalty_id FROM lists WHERE id % 29 = 0""",
    "user_list_items": """SELECT list_id * 1000000 + listable_id AS id, list_id AS user_list_id, listable_id, CASE WHEN position % 5 = 0 THEN NULL ELSE position END AS position
        FROM list_items WHERE listable_id IS NOT NULL""",
    "user_lists": """SELECT DISTINCT user_list_id AS id, user_list_id % 40 AS user_id, CAST(user_list_id % 4 AS INT) AS list_type, user_list_id % 3 = 0 AS public FROM user_list_items""",
    "editions": """SELECT list_id * 100000 + listable_id AS id, listable_id AS book_id, CASE WHEN position = 1 THEN NULL ELSE CAST(position * 13 % 7 AS INT) END AS popularity
        FROM list_items WHERE listable_id IS NOT NULL AND list_id % 3 = 0""",
    "descriptions": """SELECT CAST(doc_id AS BIGINT) AS id, CAST(doc_id % 200 AS BIGINT) AS describable_id, CAST(doc_id % 2 AS INT) AS kind, lang AS locale,
        CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'manual' WHEN 1 THEN 'ai_generated' WHEN 2 THEN 'goodreads' WHEN 3 THEN 'wikipedia' WHEN 4 THEN 'openlibrary' WHEN 5 THEN 'publisher' WHEN 6 THEN 'musicbrainz' WHEN 7 THEN 'igdb' WHEN 8 THEN 'other' ELSE 'blog' END AS source,
        CAST(CASE WHEN doc_id % 7 = 0 THEN -1 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS rank, n_chars FROM documents""",
    "identifiers": """SELECT CAST(p_partkey AS BIGINT) AS identifiable_id, CAST(p_size % 3 * 100 AS INT) AS identifier_type, CONCAT(' ', p_brand, '-', CAST(p_partkey % 500 AS STRING), ' ') AS value FROM part""",
    "songs": """SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 2 = 0 THEN UPPER(p_name) ELSE p_name END AS title, CAST(1950 + p_size AS INT) AS release_year FROM part""",
    "song_artists": """SELECT DISTINCT CAST(p_partkey AS BIGINT) AS song_id, CAST(p_partkey % 5 AS BIGINT) AS artist_id FROM part WHERE p_partkey % 11 <> 0
        UNION ALL SELECT DISTINCT CAST(p_partkey AS BIGINT) AS song_id, CAST(10 + p_partkey % 3 AS BIGINT) AS artist_id FROM part WHERE p_partkey % 3 = 0""",
    "index_requests": """SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_type IN ('view', 'click') THEN 'Books::Book' ELSE 'Books::Author' END AS parent_type,
        CAST(user_id AS BIGINT) AS parent_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS action, ts FROM events""",
}


def order() -> list[str]:
    return list(VIEWS)


def needed(sql: str) -> list[str]:
    """The views that a query reads, and those that they read, in order of definition."""
    names: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = (words & VIEWS.keys()) - names
        names |= new
        todo += [VIEWS[n] for n in new]
    return [n for n in VIEWS if n in names]


def with_views(sql: str) -> str:
    """The query with the views it needs as common table expressions."""
    views = needed(sql)
    body = sql.strip()
    if not views:
        return body
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in views)
    own = re.match(r"(?i)with\s+", body)
    return f"WITH {head},\n{body[own.end():]}" if own else f"WITH {head}\n{body}"


class Catalog:
    """Tables and views of one folder of driver tables, as lazy frames: ``catalog.lists``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else self._view(name)
        return self._made[name]

    def _view(self, name: str) -> DataFrame:
        if name == "ranked_items":  # one window in SQL, ranges of scores here
            from .operators.ranking import ranked

            scores = re.search(r"FROM \((.*)\) s$", VIEWS[name], re.S)[1]
            return ranked(self._frame(scores), most=self.lineitem.count()).select("item_id", "rank", "score")
        return self._frame(VIEWS[name])

    def _frame(self, sql: str) -> DataFrame:
        read = {w: getattr(self, w) for w in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) if w in TABLES or w in VIEWS}
        text = re.sub(r"(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in read else m[0], sql)
        return self.spark.sql(text, **read)

    @cached_property
    def book_documents(self) -> DataFrame:
        """The search documents of books."""
        from .operators.search import book_documents

        return book_documents(self.books, self.category_items, self.book_countries, self.ranked_items)
