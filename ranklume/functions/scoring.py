"""Scores, penalties and bands as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What share of the summed scores an author of so many books keeps; six books and more keep all.
AUTHOR_SHARES = [Decimal("0.30555555555555547"), Decimal("0.5555555555555555"), Decimal("0.75"), Decimal("0.8888888888888888"), Decimal("0.9722222222222222"), Decimal("1")]


def flag(c: Column) -> Column:
    """A nullable flag: null is false."""
    return F.coalesce(c, F.lit(False))


def shortfall_penalty(actual: Column, wanted: Column, most: Column) -> Column:
    """``most`` at nothing, falling with the square of the way to ``wanted``, 0 from there on and for null."""
    part = most * F.pow(1 - actual / wanted, F.lit(2))
    return F.when(actual.isNull() | (actual >= wanted), F.lit(0.0)).otherwise(F.least(F.greatest(part, F.lit(0.0)), most.cast("double")))


def voter_penalty(voters: Column, median: Column, most: Column) -> Column:
    """As shortfall_penalty, but one voter or none costs all, and the median itself costs nothing only by the curve."""
    part = F.least(F.greatest(most * F.pow(1 - voters / median, F.lit(2)), F.lit(0.0)), most.cast("double"))
    return F.when(voters.isNull(), F.lit(0.0)).when(voters <= 1, most.cast("double")).when(voters > median, F.lit(0.0)).otherwise(part)


def date_penalty(list_year: Column, item_year: Column, yearly_award: Column, max_age: Column | int | None, max_percentage: Column | int | None) -> Column:
    """Share of an item's contribution lost because the list came soon after it; null where none applies."""
    age = F.lit(max_age).cast("double") if not isinstance(max_age, Column) else max_age
    most = F.lit(max_percentage).cast("double") if not isinstance(max_percentage, Column) else max_percentage
    gap = list_year - item_year
    share = (age - gap) / age * most / 100
    none = F.lit(None).cast("double")
    return F.when(age.isNull() | most.isNull(), none).when(flag(yearly_award) | item_year.isNull(), most / 100).when(list_year.isNull(), none).when(gap <= 0, most / 100).when((gap > age) | (share == 0), none).otherwise(share)


def author_share(books: Column) -> Column:
    """The multiplier for an author of so many ranked books."""
    out = F.lit(AUTHOR_SHARES[-1]).cast("decimal(18,17)")
    for n in range(len(AUTHOR_SHARES) - 1, 0, -1):
        out = F.when(books <= n, F.lit(AUTHOR_SHARES[n - 1]).cast("decimal(18,17)")).otherwise(out)
    return F.when(books <= 0, F.lit(0).cast("decimal(18,17)")).otherwise(out)


def score_contribution(weight: Column, position: Column, penalty: Column, exponent: float = 3.0, bonus: float = 3.0, median_length: Column | None = None) -> Column:
    """What one place on one list adds to an item's score. NOT the original kernel, which is unknown.

    A placeholder with the properties that are known: better places, heavier lists, the exponent and the bonus pool all
    change scores, and penalties lower them. Null weights count as 0, null places as the median list's last.
    """
    length = F.greatest(F.coalesce(median_length, F.lit(1.0)), F.lit(1.0)) if median_length is not None else F.lit(10.0)
    place = F.least(F.greatest(F.coalesce(position.cast("double"), length), F.lit(1.0)), length)
    part = F.pow(1 - (place - 1) / length, F.lit(exponent))
    return F.coalesce(weight.cast("double"), F.lit(0.0)) * (1 + F.lit(bonus) / 100 * part) * (1 - F.coalesce(penalty, F.lit(0.0)))


def book_length(page_range: Column, word_count: Column) -> Column:
    """Code of a book's length band: pages first (the rounded middle of a range), words only where no pages are given."""
    blank = page_range.isNull() | (F.trim(page_range) == "")
    numbers = F.transform(F.split(page_range, "-"), lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(p, r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)))
    used = F.filter(numbers, lambda n: F.lit(True))
    single = F.element_at(used, 1)
    middle = F.when(F.exists(used, lambda n: n == 0), F.lit(None)).otherwise(F.round((F.array_min(used) + F.array_max(used)) / 2.0))
    ranged = F.when(page_range.rlike("[a-zA-Z]"), F.lit(None)).when(~page_range.contains("-"), F.when(single > 0, single)).otherwise(middle)
    pages = F.when(blank, F.round(word_count / 275.0)).otherwise(ranged)
    return F.when(pages.isNull(), F.lit(None)).when(pages <= 149, 0).when(pages <= 250, 1).when(pages <= 350, 2).when(pages <= 500, 3).when(pages <= 1000, 4).otherwise(5).cast("int")


def histogram_bar(count: Column, tallest: Column) -> Column:
    """Percent of the tallest bar, 0 where all are empty."""
    return F.when(tallest > 0, F.round(100.0 * count / tallest).cast("int")).otherwise(0)
