"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curly quotes and what stands for them.
CURLY, STRAIGHT = "‘’‚‛“”„‟", "''''\"\"\"\""
#: Accented letters and their bases, for folding.
ACCENTED, BASES = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Words that tell lists of songs from lists of albums.
SONG_WORDS, ALBUM_WORDS = ("track", "song", "single", "recording"), ("album", "record", "lp", "disc", "cd")
#: ISO 3166-1 numeric codes and their two letters.
COUNTRIES = {840: "US", 392: "JP", 826: "GB", 124: "CA", 250: "FR", 276: "DE", 380: "IT", 724: "ES", 528: "NL", 752: "SE", 616: "PL", 203: "CZ", 643: "RU", 156: "CN", 410: "KR", 158: "TW", 36: "AU", 76: "BR", 484: "MX", 32: "AR", 56: "BE", 40: "AT", 756: "CH", 208: "DK", 246: "FI", 578: "NO", 372: "IE", 620: "PT", 792: "TR", 356: "IN", 702: "SG", 554: "NZ", 804: "UA", 348: "HU", 300: "GR", 784: "AE"}


def straight_quotes(c: Column) -> Column:
    return F.translate(c, CURLY, STRAIGHT)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def search_text(c: Column) -> Column:
    """Normalised query text: straight quotes, lower case; what is no ASCII word character, space, hyphen, apostrophe or period becomes a space."""
    return F.coalesce(_squeezed(F.regexp_replace(F.lower(straight_quotes(c)), r"[^A-Za-z0-9_\s\-'.]", " ")), F.lit(""))


def index_texts(items: Column) -> Column:
    """Texts as they are indexed; blank ones drop out."""
    clean = F.transform(items, lambda t: _squeezed(F.regexp_replace(straight_quotes(t), r"[^A-Za-z0-9_\s\-'\"]", " ")))
    return F.coalesce(F.filter(clean, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, ACCENTED, BASES))


def terms(c: Column) -> Column:
    """Folded words."""
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def edge_grams(c: Column, least: int = 3, most: int = 20) -> Column:
    """Beginnings of the folded words."""
    return F.array_distinct(F.flatten(F.transform(terms(c), lambda t: F.when(F.length(t) >= least, F.transform(F.sequence(F.lit(least), F.least(F.length(t), F.lit(most))), lambda n: F.substring(t, F.lit(1), n))).otherwise(F.array().cast("array<string>")))))


def list_kind(name: Column) -> Column:
    """song, album or ambiguous, by the words in a list's name."""
    low = F.lower(name)
    hits = lambda words: F.greatest(*[low.contains(w) for w in words])
    song, album = hits(SONG_WORDS), hits(ALBUM_WORDS)
    return F.when(song & ~album, "song").when(album & ~song, "album").otherwise("ambiguous")


def country_code(numeric: Column) -> Column:
    """Two letters of a numeric code; null for others."""
    table = F.create_map(*[x for k, v in COUNTRIES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, numeric.cast("int"))


def either_contains(a: Column, b: Column) -> Column:
    """Whether one title is part of the other, in any case."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return x.contains(y) | y.contains(x)


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))


def line_batches(text: Column, size: int = 100) -> Column:
    """Lines that are not blank, joined again in batches of ``size``."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*$"))
    starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(lines, i, F.lit(size)), "\n"))


def year_of(c: Column) -> Column:
    """The year that a date's text starts with."""
    return F.substring(c, 1, 4).try_cast("int")
