"""Browsing rankings: filters, facets, counts and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import contains_ci, years_between

#: Registered collections and what they keep. ``without`` keeps books of some country that lacks the label.
COLLECTIONS = {"women": ("gender", 1), "men": ("gender", 0), "non-binary": ("gender", 2), "western": ("label", "western"), "african": ("label", "african"), "non-western": ("without", "western")}


@dataclass(frozen=True)
class Shelf:
    """The frames that ranked books are filtered by."""

    ranked_items: DataFrame
    books: DataFrame
    category_items: DataFrame
    book_countries: DataFrame
    countries: DataFrame
    book_authors: DataFrame
    authors: DataFrame


@dataclass(frozen=True)
class Choice:
    """What a visitor has chosen: all of the categories, any of the countries, years, one collection."""

    categories: list[str] = field(default_factory=list)
    countries: list[int] = field(default_factory=list)
    years: tuple[int | None, int | None] = (None, None)
    collection: str | None = None


def _of_collection(shelf: Shelf, name: str) -> DataFrame:
    kind, value = COLLECTIONS[name]
    if kind == "gender":
        who = shelf.authors.where(F.col("gender") == value).select(F.col("id").alias("author_id"))
        return shelf.book_authors.join(who, "author_id", "left_semi").select(F.col("book_id").alias("item_id"))
    labelled = F.coalesce(F.col("label") == value, F.lit(False))
    where = shelf.countries.where(labelled if kind == "label" else ~labelled).select(F.col("id").alias("country_id"))
    return shelf.book_countries.join(where, "country_id", "left_semi").select(F.col("book_id").alias("item_id"))


def ranked_books(shelf: Shelf, choice: Choice) -> DataFrame:
    """Ranked items that meet the choice. Filters are semi-joins; books are joined only if years are asked for."""
    out = shelf.ranked_items.where("rank is not null")
    for category in choice.categories:
        out = out.join(shelf.category_items.where(F.col("category") == category).select("item_id"), "item_id", "left_semi")
    if choice.countries:
        out = out.join(shelf.book_countries.where(F.col("country_id").isin(*choice.countries)).select(F.col("book_id").alias("item_id")), "item_id", "left_semi")
    if choice.collection:
        out = out.join(_of_collection(shelf, choice.collection), "item_id", "left_semi")
    if choice.years != (None, None):
        out = out.join(shelf.books.where(years_between(F.col("first_published_year"), *choice.years)).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return out


def facet_genres(shelf: Shelf, choice: Choice, limit: int = 24) -> DataFrame:
    """Genres of the chosen books with counts: what one more genre would leave. Chosen genres are left out."""
    found = shelf.category_items.where(F.col("category_type") == 0).where(~F.col("category").isin(*choice.categories) if choice.categories else F.lit(True)).join(ranked_books(shelf, choice).select("item_id"), "item_id", "left_semi")
    return found.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)


def facet_countries(shelf: Shelf, choice: Choice, limit: int = 24) -> DataFrame:
    """Countries with counts as if none were chosen, as they are alternatives; chosen ones and ``unknown`` are left out."""
    open_choice = Choice(choice.categories, [], choice.years, choice.collection)
    known = shelf.countries.where("slug <> 'unknown'").where(~F.col("id").isin(*choice.countries) if choice.countries else F.lit(True)).select(F.col("id").alias("country_id"))
    books = ranked_books(shelf, open_choice).select(F.col("item_id").alias("book_id"))
    return shelf.book_countries.join(books, "book_id", "left_semi").join(F.broadcast(known), "country_id", "left_semi").groupBy("country_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_id").limit(limit)


def browse_counts(links: DataFrame, names: DataFrame, key: str, ranked_items: DataFrame, sort: str = "count") -> DataFrame:
    """Names with the number of their ranked items, without those that have none; by count or, for any other sort, by name."""
    counts = links.join(ranked_items.where("rank is not null").select("item_id"), "item_id", "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("name")] if sort == "count" else [F.asc("name")]
    return names.join(counts, key).select("name", "n").orderBy(*order)


def lists_page(lists: DataFrame, weights: DataFrame, text: str | None = None, sort: str = "weight") -> DataFrame:
    """Active lists whose name, source or address holds the text, by weight or, newest first, by year; nulls last, then by name."""
    holds = F.coalesce(contains_ci(F.col("name"), text) | contains_ci(F.col("source"), text) | contains_ci(F.col("url"), text), F.lit(False))
    found = lists.where("status = 3").where(holds).join(weights.select("id", "weight"), "id")
    first = F.desc_nulls_last("year_published") if sort == "newest" else F.desc_nulls_last("weight")
    return found.orderBy(first, "name", "id").select("id", "name", "year_published", "weight")


def bibliography(author_id: int, book_authors: DataFrame, books: DataFrame, ranked_items: DataFrame) -> DataFrame:
    """An author's books, ranked ones by rank, then the others by year and title."""
    own = book_authors.where((F.col("author_id") == author_id) & (F.col("role") == 0)).select(F.col("book_id").alias("id"))
    return own.join(books, "id").join(ranked_items.select(F.col("item_id").alias("id"), "rank"), "id", "left").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("first_published_year"), "title", "id")


def appearances(item_id: int, list_items: DataFrame, lists: DataFrame, weights: DataFrame) -> DataFrame:
    """Active lists of the configuration that hold an item, by place (none last), then name."""
    own = list_items.where(F.col("listable_id") == item_id).select("list_id", "position")
    return own.join(lists.where("status = 3").select(F.col("id").alias("list_id"), "name"), "list_id").join(weights.select(F.col("id").alias("list_id"), "weight"), "list_id", "left_semi").orderBy(F.asc_nulls_last("position"), "name")


def top_per_group(links: DataFrame, group: str, rank: str, n: int, tie: str) -> DataFrame:
    """The n best-ranked rows of each group; Spark limits each group before it is shuffled."""
    w = Window.partitionBy(group).orderBy(rank, tie)
    return links.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def page(df: DataFrame, order: list, number: int, per_page: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)
