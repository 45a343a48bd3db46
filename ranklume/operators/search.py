"""Structured and scored search over catalog documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Criteria, page_window
from ..functions.text import edge_grams, folded, search_text, terms



@dataclass(frozen=True)
class Kind:
    """Fields of a kind of document and the boosts of the clauses that a general search has on them."""

    title: str
    boosts: dict[str, float]
    alternates: str | None = None
    creators: str | None = None
    subtitle: str | None = None


#: Fields and boosts of general searches, and boosts of completions.
WORK = {"phrase": 10.0, "keyword": 9.0, "all": 8.0, "creator_phrase": 6.0, "creator_all": 5.0}
KINDS = {
    "Books::Book": Kind("title", WORK | {"alternates": 7.0, "subtitle": 4.0}, "alternate_titles", "author_names", "subtitle"),
    "Books::Author": Kind("name", {"phrase": 10.0, "keyword": 8.0, "all": 5.0, "alternates": 3.0}, "alternate_names"),
    "Music::Artist": Kind("name", {"phrase": 10.0, "keyword": 8.0, "all": 5.0}),
    "Music::Album": Kind("title", WORK, creators="artist_names"),
    "Music::Song": Kind("title", WORK, creators="artist_names"),
    "Games::Game": Kind("title", WORK, creators="developer_names"),
}
COMPLETION_BOOSTS = {"grams": 10.0, "phrase": 8.0, "keyword": 6.0}
K1, B = 1.2, 0.75


def book_documents(books: DataFrame, category_items: DataFrame, book_countries: DataFrame, ranked_items: DataFrame) -> DataFrame:
    """A document for each book: names of categories, ids of countries, rank."""
    categories = category_items.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_set("category")).alias("category_ids"))
    countries = book_countries.groupBy(F.col("book_id").alias("id")).agg(F.sort_array(F.collect_set("country_id")).alias("country_ids"))
    x = books.join(categories, "id", "left").join(countries, "id", "left").join(ranked_items.select(F.col("item_id").alias("id"), F.col("rank").alias("ranked_position")), "id", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return x.select("id", "title", none(F.col("category_ids"), "string").alias("category_ids"), none(F.col("country_ids"), "bigint").alias("country_ids"), "language_id", "book_length", "first_published_year", "ranked_position", F.col("ranked_position").isNotNull().alias("ranked"))


def _in(c: Column, values: list) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _any(c: Column, values: list, kind: str) -> Column:
    return F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"))


def matching(documents: DataFrame, criteria: Criteria, names: dict[int, str], book_types: dict[int, str], excluded: DataFrame | None = None) -> DataFrame:
    """Documents that meet all criteria; none if one is given but cannot be read or resolved.

    names and book_types resolve the numbers of categories and of book types to the documents' categories. excluded (id)
    is an anti-join, so a long list of read books is no literal.
    """
    if criteria.unparseable:
        return documents.where(F.lit(False))
    keep = F.lit(True)
    wanted = criteria.ids("included_category_ids")
    if wanted:
        has = [F.array_contains("category_ids", names[i]) if i in names else F.lit(False) for i in wanted]
        keep = keep & (_every(has) if criteria.all_categories else _some(has))
    kind = criteria.number("book_type")
    if kind is not None:
        keep = keep & (F.array_contains("category_ids", book_types[kind]) if kind in book_types else F.lit(False))
    if ids := criteria.ids("included_language_ids"):
        keep = keep & _in(F.col("language_id"), ids)
    if ids := criteria.ids("included_country_ids"):
        keep = keep & _any(F.col("country_ids"), ids, "bigint")
    if bands := criteria.ids("book_length"):
        keep = keep & _in(F.col("book_length"), bands)
    low, high, most = (criteria.number(k) for k in ("first_year_published_gt", "first_year_published_lt", "max_ranked_position"))
    if low is not None:
        keep = keep & (F.col("first_published_year") >= low)
    if high is not None:
        keep = keep & (F.col("first_published_year") <= high)
    if criteria.ranked is not None:
        keep = keep & (F.col("ranked_position").isNotNull() if criteria.ranked else F.col("ranked_position").isNull())
    if most is not None:
        keep = keep & (F.col("ranked_position") <= most)
    if ids := [names[i] for i in criteria.ids("excluded_category_ids") if i in names]:
        keep = keep & ~_any(F.col("category_ids"), ids, "string")
    if ids := criteria.ids("excluded_language_ids"):
        keep = keep & ~_in(F.col("language_id"), ids)
    if ids := criteria.ids("excluded_country_ids"):
        keep = keep & ~_any(F.col("country_ids"), ids, "bigint")
    out = documents.where(keep)
    return out if excluded is None else out.join(excluded, "id", "left_anti")


def _every(x: list[Column]) -> Column:
    out = x[0]
    for c in x[1:]:
        out = out & c
    return out


def _some(x: list[Column]) -> Column:
    out = x[0]
    for c in x[1:]:
        out = out | c
    return out


def search_page(found: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """One page in the order of search: rank, year (none last), title, id; nothing beyond the first 10,000."""
    begin, size = page_window(page, per_page)
    return found.orderBy(F.asc_nulls_last("ranked_position"), F.asc_nulls_last("first_published_year"), F.lower("title"), "id").offset(begin).limit(size)


def saved_search(documents: DataFrame, raw: dict, names: dict[int, str], book_types: dict[int, str], read: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """A saved search's page. Books that its owner has read (id) are left out if it says so."""
    criteria = Criteria(raw)
    return search_page(matching(documents, criteria, names, book_types, read if criteria.hide_read else None), page, per_page)


def _phrase(text: Column, query: Column) -> Column:
    """Whether the query's words stand consecutively in the text."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(terms(c), " "), F.lit(" "))
    return F.coalesce(line(text).contains(line(query)), F.lit(False)) & (F.size(terms(query)) > 0)


def _all(text: Column, query: Column) -> Column:
    return F.coalesce((F.size(terms(query)) > 0) & (F.size(F.array_except(terms(query), terms(text))) == 0), F.lit(False))


def general_matches(documents: DataFrame, text: str, kind: str = "Books::Book", min_score: float = 1.0, filters: dict[str, Any] | None = None) -> DataFrame:
    """Documents that meet at least one clause of the kind's general search, with the sum of the clauses' boosts (``score``), from
    ``min_score`` on. ``filters`` are values that fields have to have; they add nothing to the score. Blank text finds nothing.

    The set of matches is what a search engine would give; its scores depend on its shards, so these are of our own.
    Fields that the documents lack have no clause.
    """
    fields, query = KINDS[kind], search_text(F.lit(text))
    title = F.col(fields.title)
    has = lambda name: name is not None and name in documents.columns
    clauses = {"phrase": _phrase(title, query), "keyword": folded(title) == query, "all": _all(title, query)}
    if has(fields.alternates):
        clauses["alternates"] = F.coalesce(F.exists(fields.alternates, lambda x: F.arrays_overlap(terms(x), terms(query))), F.lit(False))
    if has(fields.creators):
        clauses |= {"creator_phrase": _some_of(fields.creators, query, _phrase), "creator_all": _all(F.array_join(fields.creators, " "), query)}
    if has(fields.subtitle):
        clauses["subtitle"] = _all(F.col(fields.subtitle), query)
    for name, value in (filters or {}).items():
        documents = documents.where(F.col(name) == value)
    found = documents if text.strip() else documents.where(F.lit(False))
    return _scored(found, clauses, fields.boosts).where(F.col("score") >= min_score)


#: Fixed value: the kind of book that a general search is for by default.
STANDALONE = {"book_kind": "standalone"}


def _some_of(items: str, query: Column, test) -> Column:
    return F.coalesce(F.exists(items, lambda x: test(x, query)), F.lit(False))


def suggestions(documents: dict[str, DataFrame], item_type: str, text: str, size: int = 10) -> DataFrame:
    """Rows (value, text) for a box that completes items of the type; blank text and types without documents have none."""
    if item_type not in KINDS or item_type not in documents:
        raise ValueError(f"{item_type} has no documents to search")
    field = KINDS[item_type].title
    found = documents[item_type].withColumn("title", F.col(field))
    return completions(found if text.strip() else found.where(F.lit(False)), text, size).select(F.col("id").alias("value"), F.col("title").alias("text"))


def completions(documents: DataFrame, text: str, size: int = 20) -> DataFrame:
    """The best completions of what is typed: by beginnings of words, phrase, or the whole title."""
    query = search_text(F.lit(text))
    words = terms(query)
    grams = (F.size(words) > 0) & (F.size(F.array_intersect(edge_grams(F.col("title")), words)) > 0)
    found = _scored(documents, {"grams": grams, "phrase": _phrase(F.col("title"), query), "keyword": folded(F.col("title")) == query}, COMPLETION_BOOSTS)
    return found.orderBy(F.desc("score"), "id").limit(size)


#: Boosts of a search by title and creators.
PAIR_BOOSTS = {"phrase": 10.0, "keyword": 9.0, "all": 8.0, "creator_phrase": 6.0, "creator_all": 5.0}


def by_title_and_creators(documents: DataFrame, title: str, creators: list[str], field: str, required: bool = True, min_score: float = 0.0) -> DataFrame:
    """Documents whose title matches, with ``score``. Where creators are required, one of them has to be named and the title alone
    does not do; else they add to the score only."""
    query = search_text(F.lit(title))
    names = [search_text(F.lit(x)) for x in creators if x.strip()]
    clauses = {"phrase": _phrase(F.col("title"), query), "keyword": folded(F.col("title")) == query, "all": _all(F.col("title"), query)}
    found = documents.where(_some(list(clauses.values())))
    who = {"creator_phrase": _some([_some_of(field, x, _phrase) for x in names]), "creator_all": _some([_all(F.array_join(field, " "), x) for x in names])} if names else {}
    if required:
        found = found.where(_some(list(who.values())) if who else F.lit(False))
    return _scored(found, clauses | who, PAIR_BOOSTS).where(F.col("score") >= min_score)


def _scored(documents: DataFrame, clauses: dict[str, Column], boosts: dict[str, float]) -> DataFrame:
    score = sum((F.when(c, boosts[n]).otherwise(0.0) for n, c in clauses.items()), F.lit(0.0))
    return documents.withColumn("score", score).where("score > 0")


def bm25(documents: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Documents with a word of the query and their BM25 score, from document frequencies and lengths of the whole table."""
    words = documents.select(F.col(key).alias("key"), terms(F.col(text)).alias("words"))
    asked = words.sparkSession.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("term"))
    sizes = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    hits = words.select("key", F.size("words").alias("length"), F.explode("words").alias("term")).join(F.broadcast(asked), "term").groupBy("key", "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    x = hits.join(F.broadcast(df), "term").join(F.broadcast(sizes))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return x.groupBy("key").agg(F.sum(part).alias("score"))
