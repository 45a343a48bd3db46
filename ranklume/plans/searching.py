"""Search queries and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.predicates import Criteria
from ..operators import search
from . import plan

NAMES = {1: "ECONOMY", 2: "SMALL", 3: "Brand#2", 4: "Brand#9"}
TYPES = {0: "ECONOMY", 1: "SMALL"}
HAS = "id IN (SELECT item_id FROM category_items WHERE category = '{}')"
DOCS = "SELECT b.id, b.title, b.first_published_year, r.rank AS ranked_position FROM books b LEFT JOIN ranked_items r ON r.item_id = b.id WHERE "
ORDER = " ORDER BY ranked_position ASC NULLS LAST, first_published_year ASC NULLS LAST, LOWER(title), id LIMIT {} OFFSET {}"
COLUMNS = ["id", "title", "first_published_year", "ranked_position"]


def _sql(where: str, limit: int = 50, offset: int = 0) -> str:
    return f"SELECT * FROM ({DOCS} TRUE) d WHERE {where}".replace(" TRUE)", " 1 = 1)") + ORDER.format(limit, offset)


@plan(_sql(f"({HAS.format('ECONOMY')} OR {HAS.format('SMALL')}) AND id NOT IN (SELECT book_id FROM book_countries WHERE country_id IN (3, 4)) AND id IN (SELECT id FROM books WHERE book_length IN (1, 2, 3) AND first_published_year BETWEEN 1955 AND 1995) AND ranked_position <= 1500 AND id NOT IN (SELECT u.listable_id FROM user_list_items u JOIN user_lists l ON l.id = u.user_list_id WHERE l.user_id = 7 AND l.list_type = 1)"))
def saved_search(c) -> DataFrame:
    raw = {"included_category_ids": ["1", 2], "excluded_country_ids": [3, "4"], "book_length": ["1", "2", "3", "9"], "first_year_published_gt": "1955", "first_year_published_lt": 1995, "max_ranked_position": "1500", "ranked": "", "hide_read": "1"}
    read = c.user_list_items.join(c.user_lists.where("user_id = 7 and list_type = 1").select(F.col("id").alias("user_list_id")), "user_list_id", "left_semi").select(F.col("listable_id").alias("id")).distinct()
    return search.saved_search(c.book_documents, raw, NAMES, TYPES, read).select(*COLUMNS)


@plan(_sql(f"{HAS.format('SMALL')} AND {HAS.format('Brand#9')} AND ranked_position IS NULL AND id IN (SELECT id FROM books WHERE language_id IN (1, 2, 3))"))
def search_all_categories(c) -> DataFrame:
    criteria = Criteria({"included_category_ids": [2, 4], "genre_match_mode": "all", "ranked": "false", "included_language_ids": [1, 2, 3]})
    return search.search_page(search.matching(c.book_documents, criteria, NAMES, TYPES)).select(*COLUMNS)


@plan(_sql(f"{HAS.format('ECONOMY')} AND NOT {HAS.format('Brand#2')} AND COALESCE(id NOT IN (SELECT id FROM books WHERE language_id = 5), TRUE) AND id IN (SELECT book_id FROM book_countries WHERE country_id IN (1, 2, 3, 5, 8))", 20, 20))
def search_book_type_page(c) -> DataFrame:
    criteria = Criteria({"book_type": "0", "excluded_category_ids": [3], "excluded_language_ids": [5], "included_country_ids": [1, 2, 3, 5, 8]})
    return search.search_page(search.matching(c.book_documents, criteria, NAMES, TYPES), 2, 20).select(*COLUMNS)


@plan(_sql("1 = 0"))
def search_unparseable(c) -> DataFrame:
    return search.search_page(search.matching(c.book_documents, Criteria({"book_type": "abc"}), NAMES, TYPES)).select(*COLUMNS)


def _worded(table: str, field: str, words: list[str], rest: str = "") -> str:
    """Rows of a table with the score of a general search for these words: as a phrase 10, all of them ``every``."""
    phrase, every = " ".join(words), ", ".join(f"'{w}'" for w in words)
    return f"SELECT * FROM (SELECT id, {field}, CASE WHEN CONTAINS(CONCAT(' ', ARRAY_TO_STRING(w, ' '), ' '), ' {phrase} ') THEN 10.0 ELSE 0.0 END + CASE WHEN LIST_HAS_ALL(w, [{every}]) THEN {{every}} ELSE 0.0 END AS score FROM (SELECT *, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER({field}), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {table}) t) s WHERE score >= 1{rest}"


@plan(_worded("books", "title", ["ring", "red"]).format(every=8.0))
def general_search(c) -> DataFrame:
    return search.general_matches(c.book_documents, "Ring, ‘red’!").select("id", "title", "score")


@plan(_worded("(SELECT *, id % 3 = 0 AS single FROM books)", "title", ["red", "ring"], " AND score >= 10").format(every=8.0).replace("FROM (SELECT *, LIST_FILTER", "FROM (SELECT *, LIST_FILTER").replace(" t) s WHERE", " t WHERE single) s WHERE"))
def general_search_filtered(c) -> DataFrame:
    """Books that stand alone whose score is at least that of a phrase."""
    books = c.book_documents.withColumn("book_kind", F.when(F.col("id") % 3 == 0, "standalone").otherwise("volume"))
    found = search.general_matches(books, "red ring", min_score=10.0, filters=search.STANDALONE)
    return found.select("id", "title", F.when(F.col("score") > 18, 18.0).otherwise(F.col("score")).alias("score"))


@plan(_worded("authors", "name", ["supplier", "000000042"]).format(every=5.0))
def general_search_authors(c) -> DataFrame:
    """The name as a phrase and all of its words; the mark in it keeps it from being equal."""
    return search.general_matches(c.authors, "supplier 000000042!", "Books::Author").select("id", "name", "score")


@plan("SELECT b.id FROM books b WHERE b.title LIKE '%bolt%' OR b.id IN (SELECT song_id FROM song_artists WHERE artist_id = 11)")
def general_search_creators(c) -> DataFrame:
    names = c.song_artists.groupBy(F.col("song_id").alias("id")).agg(F.collect_set(F.when(F.col("artist_id") == 11, "The Bolt").otherwise("X")).alias("artist_names"))
    return search.general_matches(c.books.join(names, "id", "left"), "bolt", "Music::Album").select("id")


@plan("SELECT id AS value, name AS text FROM authors ORDER BY id LIMIT 10")
def autocomplete_types(c) -> DataFrame:
    return search.suggestions({"Books::Author": c.authors}, "Books::Author", "Suppl")


@plan("SELECT id, title FROM (SELECT *, CASE WHEN title LIKE 'wid%' OR title LIKE '% wid%' THEN 1 END AS hit FROM books) b WHERE hit = 1 ORDER BY id LIMIT 20")
def autocomplete(c) -> DataFrame:
    return search.completions(c.book_documents, "WID").select("id", "title")


@plan("SELECT b.id, b.title FROM books b WHERE b.title = 'red ring' AND b.id IN (SELECT a.book_id FROM book_authors a JOIN authors w ON w.id = a.author_id WHERE w.name LIKE '%#00000000%' OR w.name LIKE '%#00000001%')")
def title_and_creators(c) -> DataFrame:
    names = c.book_authors.join(c.authors.select(F.col("id").alias("author_id"), "name"), "author_id").groupBy(F.col("book_id").alias("id")).agg(F.collect_set("name").alias("author_names"))
    found = search.by_title_and_creators(c.books.join(names, "id"), "Red Ring", [f"Supplier {i:09d}" for i in range(20)], "author_names")
    return found.select("id", "title")


@plan("""
WITH w AS (SELECT id, STRING_SPLIT(title, ' ') AS words FROM books), s AS (SELECT COUNT(*) AS n, AVG(LEN(words)) AS mean FROM w),
t AS (SELECT id, LEN(words) AS len, UNNEST(words) AS term FROM w), h AS (SELECT id, len, term, COUNT(*) AS tf FROM t WHERE term IN ('red', 'bolt') GROUP BY id, len, term),
d AS (SELECT term, COUNT(*) AS df FROM h GROUP BY term)
SELECT h.id AS key, ROUND(SUM(LN(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM h JOIN d ON d.term = h.term CROSS JOIN s GROUP BY h.id
""")
def bm25_search(c) -> DataFrame:
    return search.bm25(c.books, "id", "title", "Red bolt").select("key", F.round("score", 4).alias("score"))


@plan("SELECT b.id, CAST(LEN(k.c) AS INT) AS n_categories, k.c[1] AS first_category, r.rank AS ranked_position, r.rank IS NOT NULL AS ranked FROM books b LEFT JOIN (SELECT item_id, LIST_SORT(LIST(category)) AS c FROM category_items GROUP BY item_id) k ON k.item_id = b.id LEFT JOIN ranked_items r ON r.item_id = b.id")
def search_documents(c) -> DataFrame:
    return c.book_documents.select("id", F.size("category_ids").alias("n_categories"), F.col("category_ids")[0].alias("first_category"), "ranked_position", "ranked")


TITLE = "CONCAT('  ‘', p_name, '’ — Café / ', UPPER(p_type), ' (B.O.B.) ')"


@plan("SELECT p_partkey, CONCAT('''', p_name, ''' caf ', LOWER(p_type), ' b.o.b.') AS normal FROM part")
def normalize_search_text(c) -> DataFrame:
    return c.part.select("p_partkey", text.search_text(F.expr(TITLE)).alias("normal"))


@plan("SELECT p_partkey, CONCAT('''', p_name, ''' Caf ', p_type, ' B O B') AS cleaned, CAST(1 AS INT) AS n FROM part")
def cleanup_for_indexing(c) -> DataFrame:
    items = text.index_texts(F.array(F.expr(TITLE), F.lit("  "), F.lit(None).cast("string")))
    return c.part.select("p_partkey", items[0].alias("cleaned"), F.size(items).alias("n"))


@plan("SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'song' WHEN 1 THEN 'album' ELSE 'ambiguous' END AS kind FROM orders")
def list_kind(c) -> DataFrame:
    name = F.expr("case cast(o_orderkey % 4 as int) when 0 then 'Best Tracks' when 1 then 'Great LPs' when 2 then 'Recordings' else 'Things' end")
    return c.orders.select("o_orderkey", text.list_kind(name).alias("kind"))


@plan("SELECT n_nationkey, CASE n_nationkey * 4 WHEN 36 THEN 'AU' WHEN 40 THEN 'AT' WHEN 56 THEN 'BE' WHEN 76 THEN 'BR' WHEN 32 THEN 'AR' END AS code FROM nation")
def country_codes(c) -> DataFrame:
    return c.nation.select("n_nationkey", text.country_code(F.col("n_nationkey") * 4).alias("code"))


@plan("SELECT p_partkey, CAST(p_size % 4 + 1 AS INT) AS batches, CASE WHEN p_size % 4 = 0 THEN 'x' END AS only FROM part")
def line_batches(c) -> DataFrame:
    lines = F.expr("concat('\n \n', array_join(array_repeat('x', cast(p_size % 4 + 1 as int)), '\n\n'))")
    found = text.line_batches(lines, 1)
    return c.part.select("p_partkey", F.size(found).alias("batches"), F.when(F.size(found) == 1, found[0]).alias("only"))


@plan("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE CONTAINS(a.p_name, SPLIT_PART(b.p_name, ' ', 2)) OR CONTAINS(SPLIT_PART(b.p_name, ' ', 2), a.p_name)")
def title_contains(c) -> DataFrame:
    a, b = c.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), c.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.upper(F.element_at(F.split("p_name", " "), 2)).alias("y"))
    return a.join(b, "a").where(text.either_contains(F.col("x"), F.col("y"))).select("a", "b")
