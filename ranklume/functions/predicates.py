"""Predicates and readers of user input."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_escaped(text: str) -> str:
    """The text with LIKE's wildcards as plain characters."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def contains_ci(c: Column, text: str | None) -> Column:
    """Whether the column holds the text (without outer white space), in any case. A blank text filters nothing."""
    return F.lit(True) if not (text or "").strip() else c.ilike(f"%{like_escaped(text.strip())}%")


def named_like(c: Column, text: str | None) -> Column:
    """As contains_ci for a search of names, where a blank text finds nothing."""
    return contains_ci(c, text) if (text or "").strip() else F.lit(False)


def equal_ci(c: Column, text: str) -> Column:
    return F.lower(c) == text.lower()


def any_equal_ci(items: Column, text: str) -> Column:
    """Whether an array has the text, in any case; null arrays have none."""
    return F.coalesce(F.exists(items, lambda x: F.lower(x) == text.lower()), F.lit(False))


def has_label(labels: Column, label: str) -> Column:
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def lacks_label(labels: Column, label: str) -> Column:
    """Not labelled so, or without labels at all."""
    return ~has_label(labels, label)


def json_flag_unset(document: Column, path: str) -> Column:
    """The JSON value is missing, null, or anything but true."""
    value = F.get_json_object(document, path)
    return value.isNull() | (value != "true")


def visible_to(public: Column, owner: Column, user: int | None) -> Column:
    return F.coalesce(public, F.lit(False)) | (F.lit(False) if user is None else owner == user)


def years_between(c: Column, start: int | None, end: int | None) -> Column:
    """Inclusive bounds, either may be open; a null year passes only if both are."""
    out = F.lit(True)
    if start is not None:
        out = out & (c >= start)
    if end is not None:
        out = out & (c <= end)
    return out


@dataclass(frozen=True)
class Years:
    start: int | None
    end: int | None
    kind: str


def parse_years(text: str | None, mode: str | None = None) -> Years | None:
    """``1990s``, ``1990-1995``, ``1994``; with mode ``since`` or ``through`` one open end. Blank gives None, other text ValueError."""
    text = (text or "").strip()
    if not text:
        return None
    single = re.fullmatch(r"\d{4}", text, re.ASCII)
    if mode in ("since", "through"):
        if not single:
            raise ValueError(f"no year: {text}")
        return Years(int(text), None, mode) if mode == "since" else Years(None, int(text), mode)
    if single:
        return Years(int(text), int(text), "single")
    if decade := re.fullmatch(r"(\d{4})s", text, re.ASCII):
        return Years(int(decade[1]), int(decade[1]) + 9, "decade")
    if span := re.fullmatch(r"(\d{4})-(\d{4})", text, re.ASCII):
        if int(span[1]) > int(span[2]):
            raise ValueError(f"the first year is later: {text}")
        return Years(int(span[1]), int(span[2]), "range")
    raise ValueError(f"no years: {text}")


def resolved_slugs(text: str | None, known: dict[str, Any], most: int) -> list[Any] | None:
    """Values of comma-separated slugs; None if one is unknown or there are more than ``most``. Repeats count once."""
    slugs = list(dict.fromkeys(s.strip() for s in (text or "").split(",") if s.strip()))
    if len(slugs) > most or any(s not in known for s in slugs):
        return None
    return [known[s] for s in slugs]


def sort_columns(key: str | None, direction: str | None, allowed: dict[str, str], default: str) -> list[Column]:
    """The order for a requested key if it is allowed, else the default; nulls last, then id."""
    column = F.col(allowed.get(key or "", allowed[default]))
    return [column.desc_nulls_last() if (direction or "").lower() == "desc" else column.asc_nulls_last(), F.col("id").asc()]


def page_window(page: int, per_page: int, most: int = 10_000) -> tuple[int, int]:
    """Offset and size of a page; nothing lies beyond ``most`` rows."""
    if page < 1:
        raise ValueError("pages count from 1")
    begin = (page - 1) * per_page
    return (0, 0) if begin >= most else (begin, min(per_page, most - begin))


def integer(value: Any) -> int | None:
    """A whole number, or None for anything that is not one."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        return int(value) if not isinstance(value, float) else int(value)
    except (TypeError, ValueError):
        return None


class Criteria:
    """Typed readers over the raw JSON of a saved search."""

    LISTS = ("included_category_ids", "excluded_category_ids", "included_language_ids", "excluded_language_ids", "included_country_ids", "excluded_country_ids", "book_length")
    NUMBERS = ("book_type", "first_year_published_gt", "first_year_published_lt", "max_ranked_position")

    def __init__(self, raw: dict[str, Any] | None):
        self.raw = raw or {}

    def ids(self, key: str) -> list[int]:
        found = [n for x in self._all(key) if (n := integer(x)) is not None]
        return [n for n in found if 0 <= n <= 5] if key == "book_length" else found

    def number(self, key: str) -> int | None:
        return integer(self.raw.get(key))

    @property
    def ranked(self) -> bool | None:
        return {"true": True, "false": False, True: True, False: False}.get(self.raw.get("ranked") if not isinstance(self.raw.get("ranked"), (list, dict)) else None)

    @property
    def all_categories(self) -> bool:
        return str(self.raw.get("genre_match_mode")) == "all"

    @property
    def hide_read(self) -> bool:
        value = self.raw.get("hide_read")
        return value not in (None, "", False, 0, "0", "f", "F", "false", "FALSE", "False", "off", "OFF")

    @property
    def unparseable(self) -> bool:
        """Whether a criterion is given that reads as nothing: such a search finds nothing."""
        given = lambda key: any(str(x if x is not None else "").strip() for x in self._all(key))
        return any(given(k) and not self.ids(k) for k in self.LISTS) or any(given(k) and self.number(k) is None for k in self.NUMBERS)

    def _all(self, key: str) -> list[Any]:
        value = self.raw.get(key)
        return value if isinstance(value, list) else [] if value is None else [value]


#: Fixed value: the most ids that a criterion keeps when it is written.
MOST_IDS = 200


def written_criteria(raw: dict[str, Any] | None) -> dict[str, Any]:
    """A saved search's criteria as they are stored: readable values only, ids once each and at most MOST_IDS of them."""
    found = Criteria(raw)
    out: dict[str, Any] = {k: n for k in Criteria.NUMBERS if (n := found.number(k)) is not None}
    for key in Criteria.LISTS:
        ids = list(dict.fromkeys(found.ids(key)))
        if ids:
            out[key] = ids if key == "book_length" else ids[:MOST_IDS]
    if found.ranked is not None:
        out["ranked"] = str(found.ranked).lower()
    if found.hide_read:
        out["hide_read"] = True
    if found.all_categories:
        out["genre_match_mode"] = "all"
    return out
