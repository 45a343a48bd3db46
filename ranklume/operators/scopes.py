"""Scopes of items: what a kind, a time, a link or an identifier narrows them to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import years_between

#: Codes of games' kinds, and the kinds that stand for themselves.
GAME_TYPES = {"main_game": 0, "remake": 1, "remaster": 2, "expansion": 3}
STANDALONE_GAMES = ("main_game", "remake", "remaster")


def games_of(games: DataFrame, *kinds: str) -> DataFrame:
    return games.where(F.col("game_type").isin(*[GAME_TYPES[k] for k in kinds]))


def released(items: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Items of the years from start to end, both included; either may be open."""
    return items.where(years_between(F.col("release_year"), start, end))


def linked(items: DataFrame, links: DataFrame, item: str, **wanted) -> DataFrame:
    """Items with a link (``item`` is its key of items) that has all the wanted values, once each: by developer, publisher, platform, artist or genre."""
    hit = links
    for name, value in wanted.items():
        hit = hit.where(F.col(name) == value)
    return items.join(hit.select(F.col(item).alias("id")), "id", "left_semi")


def with_identifier(items: DataFrame, identifiers: DataFrame, kind: int, value: str) -> DataFrame:
    """Items that have the identifier: the value as it is."""
    return linked(items, identifiers, "identifiable_id", identifier_type=kind, value=value)


def in_series(games: DataFrame, series_id: int) -> DataFrame:
    return games.where(F.col("series_id") == series_id)
