"""List weights, medians and rankings of items and creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.columns import unused
from ..functions.scoring import flag
from ..registry import WEIGHTS
from ..schemas import PENALTY_TYPE


def median_voter_count(lists: DataFrame) -> DataFrame:
    """One row: the median of the lists' voters; all lists with one voter count as one, null ones not at all."""
    voters = lists.where(F.col("number_of_voters").isNotNull()).select("number_of_voters")
    distinct_ones = voters.where("number_of_voters = 1").limit(1)
    kept = voters.where("number_of_voters <> 1").unionAll(distinct_ones)
    return kept.agg(F.percentile("number_of_voters", F.lit(0.5)).alias("median_voters"))


def median_list_count(lists: DataFrame, items: DataFrame, list_type: str) -> DataFrame:
    """One row: the median number of items of lists of the type that have any; 0 if none has."""
    sized = items.join(lists.where(F.col("type") == list_type).select(F.col("id").alias("list_id")), "list_id").groupBy("list_id").agg(F.count("*").alias("n"))
    return sized.agg(F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_items"))


def percentage_western(items: DataFrame, book_countries: DataFrame, countries: DataFrame) -> DataFrame:
    """list_id and the percent of its items that have a country with the label western; lists without items have no row."""
    western = book_countries.join(countries.where("label = 'western'").select(F.col("id").alias("country_id")), "country_id").select(F.col("book_id").alias("listable_id"), F.lit(1).alias("western")).distinct()
    return items.where("listable_id is not null").join(western, "listable_id", "left").groupBy("list_id").agg(F.round(100.0 * F.count("western") / F.count("*"), 2).alias("percentage_western"))


#: The first years of media whose lists can reach back to their beginnings.
FIRST_YEARS = {"Books": -3000, "Movies": 1888, "Games": 1958}


def year_range(list_type: str, as_of_year: int, earliest: int | None = None, latest: int | None = None) -> int:
    """Years that a list of the type can cover; the first years of books, movies and games are fixed values."""
    medium = list_type.split("::")[0]
    if medium in FIRST_YEARS:
        return as_of_year - FIRST_YEARS[medium] + 1
    if medium == "Music":
        return 100 if earliest is None else max(latest or as_of_year, as_of_year) - earliest + 1
    return 100


@WEIGHTS.add(1)
def list_weight(lists: DataFrame, penalties: DataFrame, list_penalties: DataFrame, western: DataFrame, *, min_weight: int = 1, as_of_year: int = 2024, median: float = 50.0, western_threshold: float = 90.0, music_years: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Weight of each list: 100 less its penalties, at least ``min_weight``; ``details`` names each part.

    penalties (id, dynamic_type, value) are those that apply in the configuration; static ones have no dynamic_type and count
    where list_penalties links them. How many years a list can cover depends on its type; music_years are the first and last years
    of albums and songs. The penalties' sums per type are one small row; nothing is shuffled but the links.
    """
    kinds = {v: k for k, v in PENALTY_TYPE.items()}
    sums = penalties.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("dynamic_type") == code, F.col("value"))), F.lit(0)).alias(f"most_{name}") for code, name in kinds.items()])
    static = list_penalties.join(penalties.where("dynamic_type is null").select(F.col("id").alias("penalty_id"), "value"), "penalty_id").groupBy("list_id").agg(F.sum("value").alias("static"))
    x = lists.join(static, lists["id"] == static["list_id"], "left").drop("list_id").join(western, lists["id"] == western["list_id"], "left").drop("list_id").join(F.broadcast(sums))  # one row
    full = F.lit(float(year_range("", as_of_year)))
    for medium in (*FIRST_YEARS, "Music"):
        full = F.when(F.col("type").startswith(f"{medium}::"), F.lit(float(year_range(f"{medium}::List", as_of_year, *music_years)))).otherwise(full)
    flags = [(name, flag(F.col(name))) for name in ("voter_names_unknown", "voter_count_unknown", "voter_count_estimated", "category_specific", "location_specific", "creator_specific")]
    western_hit = ~flag(F.col("location_specific")) & (F.col("percentage_western") >= western_threshold)
    parts: dict[str, Column] = {"static": F.coalesce("static", F.lit(0)).cast("double"), "number_of_voters": scoring.voter_penalty(F.col("number_of_voters"), F.lit(median), F.col("most_number_of_voters"))}
    parts |= {name: F.when(hit, F.col(f"most_{name}")).otherwise(0).cast("double") for name, hit in [*flags, ("percentage_western", F.coalesce(western_hit, F.lit(False)))]}
    parts["num_years_covered"] = scoring.shortfall_penalty(F.col("num_years_covered"), full, F.col("most_num_years_covered"))
    total = sum(parts.values(), F.lit(0.0)) * F.when(flag(F.col("high_quality_source")), F.lit(2.0) / 3).otherwise(1.0)
    weight = F.round(F.greatest(100 - F.least(total, F.lit(100.0)), F.lit(float(min_weight)))).cast("int")
    details = F.struct(*[c.alias(n) for n, c in parts.items()], flag(F.col("high_quality_source")).alias("reduced"))
    return x.select("id", F.round(total, 6).alias("penalty_percentage"), weight.alias("weight"), details.alias("details"))


#: Rows that one task ranks.
ROWS_EACH = 1_000_000


def ranked(scores: DataFrame, score: str = "score", key: str = "item_id", rank: str = "rank", most: int | None = None) -> DataFrame:
    """Sequential ranks 1..N by score, then key; null scores are last. ``most`` is a bound of the number of rows where one is known.

    Up to ROWS_EACH rows are one window. More are cut into ranges of about half as many by approximate quantiles of the scores;
    a score that is a cut itself may have very many rows and is cut again by key. Ranges are ranked apart, and what stands before
    one is a prefix sum over as many rows as there are ranges. The cuts are constants, so every evaluation deals rows alike. The
    scores are read several times then, so they are checkpointed where the session names a folder.
    """
    n = scores.count() if most is None or most > ROWS_EACH else most
    if n <= ROWS_EACH:
        return scores.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(score), F.asc(key))).cast("int"))
    if scores.sparkSession.sparkContext.getCheckpointDir():
        scores = scores.checkpoint()
    parts = -(-2 * n // ROWS_EACH)
    at, of = F.col(score).cast("double"), F.col(key).cast("double")
    shares = [i / parts for i in range(1, parts)]
    values, keys = scores.select(at.alias("s"), of.alias("k")).approxQuantile(["s", "k"], shares, 0.2 / parts)
    cuts = F.array(*[F.lit(float(v)) for v in sorted(set(values))] or [F.lit(0.0)])
    above = F.size(F.filter(cuts, lambda c: c > at)) + F.size(F.filter(cuts, lambda c: c >= at))
    by_key = F.size(F.filter(F.array(*[F.lit(float(k)) for k in sorted(set(keys))] or [F.lit(0.0)]), lambda c: c <= of))
    part, sub, number, size, before = (unused(x, scores) for x in ("part", "sub", "number", "size", "before"))
    dealt = scores.withColumn(part, F.when(at.isNull(), 10 * parts).otherwise(above)).withColumn(sub, F.when(at.isNull() | F.array_contains(cuts, at), by_key).otherwise(0))
    within = Window.partitionBy(part, sub).orderBy(F.desc_nulls_last(score), F.asc(key))
    sizes = dealt.groupBy(part, sub).agg(F.count("*").alias(size))
    sums = sizes.withColumn(before, F.coalesce(F.sum(size).over(Window.orderBy(part, sub).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(part, sub, before)
    numbered = dealt.withColumn(number, F.row_number().over(within)).join(F.broadcast(sums), [part, sub])  # a row for each range
    return numbered.withColumn(rank, (F.col(number) + F.col(before)).cast("int")).drop(part, sub, number, before)


def item_scores(lists: DataFrame, items: DataFrame, weights: DataFrame, item_years: DataFrame, *, max_age: int | None = 50, max_percentage: int | None = 80, exponent: float = 3.0, bonus: float = 3.0, median: DataFrame | None = None) -> DataFrame:
    """item_id and score of every item on an active list. The kernel is a placeholder, see scoring.score_contribution."""
    active = lists.where("status = 3").select(F.col("id").alias("list_id"), "year_published", "yearly_award").join(weights.select(F.col("id").alias("list_id"), "weight"), "list_id")
    x = items.where("listable_id is not null").join(active, "list_id").join(item_years.select(F.col("id").alias("listable_id"), F.col("first_published_year").alias("item_year")), "listable_id", "left")
    if median is not None:
        x = x.join(F.broadcast(median))  # one row
    penalty = scoring.date_penalty(F.col("year_published"), F.col("item_year"), F.col("yearly_award"), max_age, max_percentage)
    part = scoring.score_contribution(F.col("weight"), F.col("position"), penalty, exponent, bonus, F.col("median_items") if median is not None else None)
    return x.groupBy(F.col("listable_id").alias("item_id")).agg(F.round(F.sum(part.cast("decimal(28,10)")), 2).cast("decimal(20,2)").alias("score"))


def author_ranking(ranked_items: DataFrame, book_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """Authors by the sum of their books' scores times a share that grows with their books up to six; scores over 0 after rounding."""
    who = authors.where(~flag(F.col("exclude_from_rankings"))).select(F.col("id").alias("author_id"))
    sums = ranked_items.where("score > 0").join(book_authors.where("role = 0").select(F.col("book_id").alias("item_id"), "author_id"), "item_id").join(who, "author_id").groupBy("author_id").agg(F.count("*").alias("books"), F.sum("score").alias("total"))
    score = F.round(F.col("total") * scoring.author_share(F.col("books")), 2).cast("decimal(20,2)")
    return ranked(sums.select("author_id", "books", score.alias("score")).where("score > 0"), "score", "author_id", most=authors.count())


def artist_ranking(albums: DataFrame, songs: DataFrame, album_artists: DataFrame, song_artists: DataFrame) -> DataFrame:
    """Artists by the sum of their albums' and songs' scores over 0."""

    def sums(scores: DataFrame, links: DataFrame, item: str, name: str) -> DataFrame:
        return scores.join(links.select(F.col(item).alias("item_id"), "artist_id").distinct(), "item_id").groupBy("artist_id").agg(F.sum("score").alias(name))

    both = sums(albums, album_artists, "album_id", "albums").join(sums(songs, song_artists, "song_id", "songs"), "artist_id", "full")
    total = (F.coalesce("albums", F.lit(0)) + F.coalesce("songs", F.lit(0))).cast("decimal(20,2)")
    return ranked(both.select("artist_id", total.alias("score")).where("score > 0"), "score", "artist_id")


def resolved_descriptions(descriptions: DataFrame, sources: list[str]) -> DataFrame:
    """The description to show for each thing, kind and locale: preferred ones first, then by source, then by id; deprecated ones never."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    w = Window.partitionBy("describable_id", "kind", "locale").orderBy(F.desc("rank"), F.when(place > 0, place).otherwise(99), "id")
    return descriptions.where("rank >= 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
