"""Readers: Parquet tables, JDBC replicas, text, JSON and keyset scans."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import list_kind
from ..schemas import IMPORTED_ITEMS

#: What stands before a list's name: its source with a note of a country, which may have a year; or the source alone.
NOTED = r"^(.+?)\s*\(([A-Za-z\s/]+)(?:,\s*([0-9]{4}))?\)\s*-\s*(.+)$"
PLAIN = r"^(.+?)\s*-\s*(.+)$"
#: A name and the year in a note at its end, where more may follow the year.
DATED = r"^(.+?)\s*\(([0-9]{4})[^)]*\)$"


def replica(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table of a read-only replica; with a numeric key and its bounds, read in ranges at once. The JDBC driver has to be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def keyset(df: DataFrame, key: str, after: int | None, size: int) -> DataFrame:
    """The next ``size`` rows by key: a filter and a top-k, however far in the scan is."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def list_lines(lines: DataFrame) -> DataFrame:
    """Columns of the lines (value) of a list of lists, and ``route``: valid, missing_country, missing_year, ambiguous or invalid.

    A line is cut once, after the first note of a country or else at its first dash. The year is the one in that note, else
    the one in a note at the end of the name. Comments and blank lines drop out.
    """
    line = F.col("value")
    kept = lines.where(~line.rlike(r"^\s*(#|$)"))
    noted, plain = line.rlike(NOTED), line.rlike(PLAIN)
    group = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    early = F.when(noted, group(line, NOTED, 3))
    rest = F.when(noted, group(line, NOTED, 4)).when(plain, group(line, PLAIN, 2))
    late = early.isNull() & rest.rlike(DATED)
    cut = {
        "source": F.when(noted, group(line, NOTED, 1)).when(plain, group(line, PLAIN, 1)),
        "country": F.when(noted, group(line, NOTED, 2)),
        "name": F.when(late, group(rest, DATED, 1)).otherwise(rest),
    }
    year = F.when(late, group(rest, DATED, 2)).otherwise(early).try_cast("int")
    out = kept.select("*", *[F.regexp_replace(c, r"^\s+|\s+$", "").alias(n) for n, c in cut.items()], year.alias("year"))
    kind = list_kind(F.col("name"))
    route = F.when(F.col("name").isNull(), "invalid").when(kind == "ambiguous", "ambiguous").when(F.col("country").isNull(), "missing_country").when(F.col("year").isNull(), "missing_year").otherwise("valid")
    return out.select("*", F.when(F.col("name").isNotNull(), kind).alias("list_type"), route.alias("route"))


def imported_items(lists: DataFrame, document: str, key: str = "songs") -> DataFrame:
    """A row for each element of the JSON array ``key``: place from 0 and the fields of IMPORTED_ITEMS. Broken or missing arrays give none."""
    return lists.select("*", F.posexplode(F.from_json(document, f"struct<{key}:{IMPORTED_ITEMS}>")[key]).alias("idx", "item")).select(*[c for c in lists.columns if c != document], "idx", "item.*")


def lucene_escaped(text: str) -> str:
    """Text with the special characters of Lucene's syntax, spaces among them, as plain ones."""
    return re.sub(r'([+\-&|!(){}\[\]^"~*?:\\/ ])', r"\\\1", text)


@dataclass(frozen=True)
class ApiQuery:
    """A query of a games catalog's API; each step returns a new one, and a later step of a kind replaces an earlier one, but
    for conditions, which all hold. The request itself is left to the caller."""

    parts: tuple[tuple[str, str], ...] = ()
    #: Clauses in the order in which they are written.
    ORDER: ClassVar[tuple[str, ...]] = ("fields", "exclude", "search", "where", "sort", "limit", "offset")

    def _with(self, name: str, text: str) -> ApiQuery:
        return replace(self, parts=tuple((dict(self.parts) | {name: text}).items()))

    def fields(self, *names: str) -> ApiQuery:
        """The fields to return; all where none is named."""
        return self._with("fields", ", ".join(names) or "*")

    def exclude(self, *names: str) -> ApiQuery:
        return self._with("exclude", ", ".join(names))

    def where(self, condition: str | dict[str, Any]) -> ApiQuery:
        """A condition as text, or values by field: a list means any of them, None a field without value."""
        if not isinstance(condition, (str, dict)):
            raise ValueError("where: text or values by field")
        one = lambda v: "null" if v is None else f"({','.join(map(str, v))})" if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v)
        new = condition if isinstance(condition, str) else " & ".join(f"{k} = {one(v)}" for k, v in condition.items())
        return self._with("where", " & ".join(x for x in (dict(self.parts).get("where"), new) if x))

    def search(self, text: str) -> ApiQuery:
        return self._with("search", '"' + re.sub(r'(["\\])', r"\\\1", text) + '"')

    def sort(self, field: str, direction: str = "asc") -> ApiQuery:
        return self._with("sort", f"{field} {direction}")

    def limit(self, n: int) -> ApiQuery:
        if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= 500:
            raise ValueError("limit: 1 to 500")
        return self._with("limit", str(n))

    def offset(self, n: int) -> ApiQuery:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("offset: 0 or more")
        return self._with("offset", str(n))

    def __str__(self) -> str:
        said = dict(self.parts)
        if not said:
            raise ValueError("a query has to have a clause")
        return " ".join(f"{k} {said[k]};" for k in self.ORDER if k in said)
