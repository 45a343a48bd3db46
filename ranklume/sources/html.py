"""HTML as a source: stripped to its lists, or cleaned by an allow-list."""

from __future__ import annotations

import html
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

#: Elements that go with all they hold, attributes that stay, elements without an end.
UNWANTED = frozenset({
    "script", "style", "link", "meta", "noscript", "img", "picture", "audio", "video", "source", "track", "canvas", "svg", "button", "form", "input",
    "select", "textarea", "label", "fieldset", "legend", "optgroup", "option", "datalist", "output", "progress", "meter", "iframe", "embed",
    "object", "param", "map", "area", "figure", "figcaption", "dialog", "menu", "menuitem", "details", "summary", "slot", "template", "nav", "aside",
    "footer", "header", "ruby", "rt", "rp", "time", "data", "abbr", "dfn", "code", "pre", "samp", "kbd", "var", "blockquote", "q", "cite",
})
KEPT_ATTRIBUTES = frozenset({"id", "class", "href", "src", "alt", "title"})
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
#: What a review may have.
REVIEW_TAGS, REVIEW_ATTRIBUTES = frozenset({"p", "br", "a", "i", "b", "em", "strong", "blockquote"}), frozenset({"href", "title"})
DROPPED = frozenset({"script", "style"})


class _Rewriter(HTMLParser):
    """Writes the document again without some elements (with or without what they hold) and attributes."""

    def __init__(self, gone: frozenset[str], allowed: frozenset[str] | None, attributes: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.gone, self.allowed, self.attributes = gone, allowed, attributes
        self.out: list[str] = []
        self.depth: list[str] = []  # open elements that go with what they hold
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.gone:
            if tag not in VOID:
                self.depth.append(tag)
            return
        if self.depth or self.allowed is not None and tag not in self.allowed:
            return
        kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs if k in self.attributes and not (k in ("href", "src") and (v or "").strip().lower().startswith(("javascript:", "data:", "vbscript:"))))
        self.out.append(f"<{tag}{kept}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.depth:
            if tag in self.depth:
                while self.depth.pop() != tag:
                    pass
            return
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(html.escape(data, quote=False))

    def result(self) -> str:
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def _rewritten(text: str | None, gone: frozenset[str], allowed: frozenset[str] | None, attributes: frozenset[str]) -> str | None:
    if text is None or not text.strip():
        return None
    parser = _Rewriter(gone, allowed, attributes)
    parser.feed(text)
    parser.close()
    return parser.result()


def simplify(text: str | None) -> str | None:
    """HTML without elements that hold no list, and with few attributes; None for blank text."""
    return _rewritten(text, UNWANTED, None, KEPT_ATTRIBUTES)


def sanitize(text: str | None) -> str | None:
    """A review's body by the allow-list; other elements leave what they hold. None where no visible text is left."""
    out = _rewritten(text, DROPPED, REVIEW_TAGS, REVIEW_ATTRIBUTES)
    if out is None:
        return None
    plain = _rewritten(text, DROPPED, frozenset(), frozenset()) or ""
    return out if html.unescape(plain).strip(" \t\n\r\f\v ​‌‍﻿") else None


def _simplified(pages: pd.Series) -> pd.Series:
    return pages.map(simplify)


def _sanitized(bodies: pd.Series) -> pd.Series:
    return bodies.map(sanitize)


def simplified(c: Column) -> Column:
    """simplify over a column: trees of elements are no regular expression, so Arrow batches go to Python."""
    return F.pandas_udf(_simplified, "string")(c)


def sanitized(c: Column) -> Column:
    return F.pandas_udf(_sanitized, "string")(c)


def rendered(body: Column) -> Column:
    """A sanitised body with spoilers (``||so||``) as spans, links that vouch for nothing, and blank-line paragraphs where it has none."""
    blocks = body.rlike(r"(?i)<(?:p|br|blockquote|pre)[\s/>]")
    split = F.filter(F.split(body, r"\r?\n\s*\r?\n"), lambda p: F.trim(p) != "")
    paragraphs = F.array_join(F.transform(split, lambda p: F.concat(F.lit("<p>"), F.regexp_replace(F.trim(p), r"\r?\n", "<br>"), F.lit("</p>"))), "")
    out = F.when(blocks, body).otherwise(paragraphs)
    out = F.regexp_replace(out, r"(?s)\|\|((?:(?!</?(?:p|blockquote)\b).)+?)\|\|", '<span class="review-spoiler">$1</span>')
    out = F.regexp_replace(out, r'<a href="([^"]*)"(?: title="[^"]*")?>', '<a href="$1" rel="nofollow ugc noopener">')
    return F.when(body.isNotNull() & (F.trim(body) != ""), out)
