"""Known values of penalties, shares, medians, weights and bands."""

import pytest
from pyspark.sql import functions as F

from ranklume.functions import scoring
from ranklume.operators import ranking
from ranklume.schemas import PENALTY_TYPE

LISTS = "id long, status int, type string, number_of_voters int, num_years_covered int, high_quality_source boolean, voter_names_unknown boolean, voter_count_unknown boolean, voter_count_estimated boolean, category_specific boolean, location_specific boolean, creator_specific boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("list_year,item_year,award,age,share", [(2000, 1980, False, 50, 0.48), (2000, 2005, False, 50, 0.8), (2000, 1940, False, 50, None), (2000, None, False, 50, 0.8), (2000, 1940, True, 50, 0.8), (None, 1980, True, 50, 0.8), (None, 1980, False, 50, None), (2000, 1980, False, None, None), (2000, 1950, False, 50, None)])
def test_date_penalty(spark, list_year, item_year, award, age, share):
    got = one(spark, scoring.date_penalty(F.lit(list_year).cast("int"), F.lit(item_year).cast("int"), F.lit(award), age, 80))
    assert got == (None if share is None else pytest.approx(share))


@pytest.mark.parametrize("books,share", [(0, 0), (1, 0.3056), (2, 0.5556), (3, 0.75), (4, 0.8889), (5, 0.9722), (6, 1), (60, 1)])
def test_author_share(spark, books, share):
    assert float(one(spark, scoring.author_share(F.lit(books)))) == pytest.approx(share, abs=1e-4)


@pytest.mark.parametrize("voters,median", [([10, 25, 50, 100, 1, 1, None], 25), ([1, 2, 100], 2), ([None], None), ([1, 1, 1], 1)])
def test_median_voters(spark, voters, median):
    lists = spark.createDataFrame([(v,) for v in voters], "number_of_voters int")
    assert ranking.median_voter_count(lists).first()[0] == median


@pytest.mark.parametrize("voters,weight", [(100, 100), (2, 100), (1, 60), (None, 100)])
def test_voter_penalty(spark, voters, weight):
    assert weights(spark, [(3, 0, 40)], [], number_of_voters=voters, median=2.0) == weight


def weights(spark, penalties, static, western=None, median=50.0, min_weight=1, **flags):
    row = dict.fromkeys(["number_of_voters", "num_years_covered"]) | dict.fromkeys(["high_quality_source", "voter_names_unknown", "voter_count_unknown", "voter_count_estimated", "category_specific", "location_specific", "creator_specific"], False) | {"id": 1, "status": 3, "type": "Books::List"} | flags
    lists = spark.createDataFrame([row], LISTS)
    kinds = spark.createDataFrame(penalties, "id int, dynamic_type int, value int")
    links = spark.createDataFrame([(1, p) for p in static], "list_id long, penalty_id int")
    share = spark.createDataFrame([(1, western)] if western is not None else [], "list_id long, percentage_western double")
    return ranking.list_weight(lists, kinds, links, share, min_weight=min_weight, median=median).first()["weight"]


def test_weight_floor_and_cap(spark):
    assert weights(spark, [(1, None, 99)], [1], min_weight=5) == 5
    assert weights(spark, [(1, None, 80), (2, None, 70)], [1, 2], min_weight=0) == 0
    assert weights(spark, [(1, None, 30)], [1], high_quality_source=True) == 80


@pytest.mark.parametrize("share,location,weight", [(95.0, False, 90), (90.0, False, 90), (89.9, False, 100), (95.0, True, 100), (None, False, 100)])
def test_western_penalty(spark, share, location, weight):
    assert weights(spark, [(4, 1, 10)], [], western=share, location_specific=location) == weight


@pytest.mark.parametrize("pages,words,band", [("300", None, 2), ("100-200", None, 1), ("xii-200", None, None), ("0", None, None), ("0-50", None, None), ("149", None, 0), ("1001", None, 5), (None, 275 * 400, 3), ("", 275 * 600, 4), ("p. 3", 100000, None), (None, None, None), ("12 345", None, 0)])
def test_book_length(spark, pages, words, band):
    assert one(spark, scoring.book_length(F.lit(pages).cast("string"), F.lit(words).cast("int"))) == band


@pytest.mark.parametrize("score", ["cast(id % 7 as double)", "cast(if(id % 3 = 0, 5, id % 101) as decimal(20,2))", "if(id % 11 = 0, null, cast(id as double))", "cast(null as double)", "1.0"])
@pytest.mark.parametrize("each", [1_000_000, 200])
def test_ranks_are_sequential(spark, monkeypatch, each, score):
    monkeypatch.setattr(ranking, "ROWS_EACH", each)  # 200: ranges
    got = ranking.ranked(spark.range(3000).selectExpr("id as item_id", f"{score} as score").repartition(7)).collect()
    want = sorted(got, key=lambda r: (r["score"] is None, -(r["score"] or 0), r["item_id"]))
    assert [r["rank"] for r in want] == list(range(1, 3001))
    assert ranking.ranked(spark.range(0).selectExpr("id as item_id", "1.0 as score")).count() == 0


def test_kernel_properties(spark):
    part = lambda **k: one(spark, scoring.score_contribution(F.lit(k.get("weight", 50)), F.lit(k.get("position", 2)), F.lit(k.get("penalty", 0.0)), k.get("exponent", 3.0), k.get("bonus", 3.0)))
    assert part(position=1) > part(position=2) > part(position=9)
    assert part(weight=60) > part() > part(penalty=0.5)
    assert part(exponent=2.0) != part() != part(bonus=9.0)


def test_years_that_a_list_can_cover(spark):
    assert ranking.year_range("Books::List", 2024) == 5025 and ranking.year_range("Movies::List", 2024) == 137 and ranking.year_range("Games::List", 2024) == 67
    assert ranking.year_range("Music::Songs::List", 2024) == 100 and ranking.year_range("Music::Albums::List", 2024, 1950, 2030) == 81 and ranking.year_range("Music::Albums::List", 2024, 1950, 2000) == 75
    assert ranking.year_range("List", 2024) == 100
    flags = ("voter_names_unknown", "voter_count_unknown", "voter_count_estimated", "category_specific", "location_specific", "creator_specific", "high_quality_source")
    kinds = ["Books::List", "Games::List", "Music::Songs::List", "List"]
    lists = spark.createDataFrame([(i, k, 50) for i, k in enumerate(kinds)], "id long, type string, num_years_covered int").select("*", F.lit(None).cast("int").alias("number_of_voters"), *[F.lit(False).alias(f) for f in flags])
    penalties = spark.createDataFrame([(1, PENALTY_TYPE["num_years_covered"], 40)], "id int, dynamic_type int, value int")
    none = spark.createDataFrame([], "list_id long, penalty_id int")
    western = spark.createDataFrame([], "list_id long, percentage_western double")
    got = {r["id"]: r["penalty_percentage"] for r in ranking.list_weight(lists, penalties, none, western, music_years=(1950, 2000)).collect()}
    assert got == {i: round(40 * (1 - 50 / n) ** 2, 6) for i, n in enumerate((5025, 67, 75, 100))}
