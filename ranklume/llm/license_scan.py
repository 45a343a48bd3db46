"""License scans by ordered signature rules.

Rules are regular expressions over a text's lower-cased words, joined by single
spaces: sentences and titles written by hand (license_rules), and forms in which
texts name a license. A keyword automaton reads each text once and names the rules that may
match; only those run. Where detections overlap, one that lies within a
detection of higher priority (or an equal one that is longer) is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import RULES
from .common import small_batches

#: Words after ASCII lower-casing: what stands between ASCII characters other than letters and digits.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases whose every place is reported, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Labels and the names by which texts call the licenses, as words.
NAMES = {
    "0bsd": "(?:0bsd|zero clause bsd)",
    "afl": "academic free license",
    "agpl": "(?:agpl|(?:gnu )?affero general public license)",
    "apache": "apache(?: software)?(?: license)?",
    "artistic": "artistic license",
    "bsd": "bsd(?: style| [0-9] clause)?(?: license)?",
    "bsl": "boost software license",
    "busl": "business source license",
    "cc-by": "(?:creative commons|cc) (?:attribution|by)(?: [0-9] [0-9])?",
    "cc-by-nc": "(?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc)",
    "cc-by-nd": "(?:creative commons|cc) (?:attribution|by) (?:noderivatives|no derivatives|nd)",
    "cc-by-sa": "(?:creative commons|cc) (?:attribution|by) (?:sharealike|share alike|sa)",
    "cc0": "(?:cc0|creative commons zero)",
    "cddl": "(?:cddl|common development and distribution license)",
    "cecill": "cecill(?: [abc])?",
    "cpl": "common public license",
    "epl": "(?:epl|eclipse public license)",
    "eupl": "(?:eupl|european union public licen[cs]e)",
    "gfdl": "(?:gfdl|gnu free documentation license)",
    "gpl": "(?:gpl|gnu general public license|general public license)",
    "isc": "isc(?: license)?",
    "lgpl": "(?:lgpl|(?:gnu )?(?:lesser|library) general public license)",
    "mit": "(?:mit|expat)(?: license)?",
    "mpl": "(?:mpl|mozilla public license)",
    "ms-pl": "(?:ms pl|microsoft public license)",
    "ofl": "(?:sil )?open font license",
    "osl": "open software license",
    "postgresql": "postgresql licen[cs]e",
    "python": "python software foundation license",
    "ruby": "ruby license",
    "sspl": "(?:sspl|server side public license)",
    "unlicense": "unlicense",
    "upl": "universal permissive license",
    "wtfpl": "(?:wtfpl|do what the fuck you want to public license)",
    "zlib": "zlib(?: libpng)?(?: license)?",
    "zpl": "zope public license",
}
#: How texts name a license; priority, weight, keywords of which every match has one, pattern about the name.
FORMS = [
    (90, 0.99, ("spdx",), r"spdx license identifier {}"),
    (80, 0.95, tuple(f"{verb} {by}" for verb in "licensed released distributed available published provided covered".split() for by in ("under", "by")), r"(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?{}(?: (?:version|v) ?[0-9]+(?: [0-9]+)*)?"),
    (75, 0.95, ("under terms", "under the terms", "under conditions", "under the conditions"), r"under (?:the )?(?:terms|conditions) (?:and conditions )?of (?:the )?{}"),
    (70, 0.9, ("licens", "licenc"), r"licen[cs]es? {}"),
    (65, 0.9, (" version", *(f" v{space}{digit}" for space in ("", " ") for digit in range(10))), r"{} (?:version|v) ?[0-9]+(?: [0-9]+)*(?: or (?:any )?later(?: version)?)?"),
    (60, 0.85, ("copying", "license file", "notice"), r"{} see (?:the )?(?:copying|license file|notice)"),
    (55, 0.85, ("dual licensed ", "either "), r"(?:dual licensed|either) (?:under )?(?:the )?{} or"),
]
@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


#: What a worker has compiled: the rules, and what detections() needs.
_MADE: dict[str, Any] = {}


#: A class, a wildcard or a character with a count, or a character that may be missing: no part of a literal run.
VARIABLE = re.compile(r"(?:\[[^\]]*\]|.)(?:\{[^}]*\}|[?*])\??|\[[^\]]*\]")


def literal(pattern: str) -> str:
    """The longest run of characters that every match has, by leaving out groups, classes and what may be missing."""
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)(?:\{[^}]*\}|[?*])?", "\0", pattern)) != pattern:
        pattern = shorter
    return max(VARIABLE.sub("\0", pattern).split("\0"), key=len)


def written_rules() -> list[Rule]:
    """The rules of license_rules, each behind its longest literal run."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, weight, pattern = line.split(" ", 3)
        out.append(Rule(label, int(priority), float(weight), (literal(pattern),), pattern))
    return out


def rules() -> list[Rule]:
    """The written rules and every form of every name, the first of equal priority first."""
    if "rules" in _MADE:
        return _MADE["rules"]
    out = written_rules() + [Rule(label, p, w, keys, form.replace("{}", f"(?:{name})")) for p, w, keys, form in FORMS for label, name in NAMES.items()]
    _MADE["rules"] = sorted(out, key=lambda r: -r.priority)
    return _MADE["rules"]


def _compiled():
    """The keyword automaton, the rules behind each keyword, and for the rules of one form a search that tells whether any can match."""
    if "all" in _MADE:
        return _MADE["all"]
    import ahocorasick

    found, machine = rules(), ahocorasick.Automaton()
    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(found):
        for k in r.keywords:
            by_key.setdefault(k, []).append(i)
    for k in by_key:
        machine.add_word(k, k)
    machine.make_automaton()
    forms: dict[tuple, list[int]] = {}
    for i, r in enumerate(found):
        forms.setdefault((r.priority, r.keywords), []).append(i)
    gates = {i: k for k, group in forms.items() for i in group}
    anyname = {k: re.compile(rb"(?<![^ ])(?:" + b"|".join(found[i].pattern.encode() for i in group) + rb")(?![^ ])") for k, group in forms.items() if len(group) > 1}
    _MADE["all"] = machine, by_key, gates, anyname, [re.compile(rb"(?<![^ ])" + r.pattern.encode() + rb"(?![^ ])") for r in found]
    return _MADE["all"]


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text; none for null and empty texts."""
    return WORDS.findall((text or "").encode().lower())


def positions(line: bytes) -> Callable[[int], int]:
    """The position of the word that a byte of the joined words stands in; their spaces are looked up when first asked."""
    spaces: list[np.ndarray] = []

    def place(byte: int) -> int:
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32))
        return int(np.searchsorted(spaces[0], byte))

    return place


def base_places(line: bytes, place: Callable[[int], int]) -> list[tuple[int, str]]:
    """Word positions and labels of all places of the base phrases in the joined words."""
    out, padded = [], b" " + line + b" "
    for phrase, label in BASE:
        sought = b" " + phrase.encode() + b" "
        at = padded.find(sought)
        while at >= 0:
            out.append((place(at), label))
            at = padded.find(sought, at + 1)
    return out


def detections(line: bytes) -> list[tuple[int, int, str, float]]:
    """What the rules find in the joined words, without the suppressed: byte start, end, label, weight, by start."""
    machine, by_key, gates, anyname, patterns = _compiled()
    keys = {k for _, k in machine.iter(line.decode())}
    if not keys:
        return []
    found, all_rules = [], rules()
    open_gates = {g: g not in anyname or bool(anyname[g].search(line)) for g in {gates[i] for k in keys for i in by_key[k]}}
    for i in sorted({i for k in keys for i in by_key[k] if open_gates[gates[i]]}):
        r = all_rules[i]
        found += [(m.start(), m.end(), r.label, r.weight, r.priority) for m in patterns[i].finditer(line)]
    found.sort(key=lambda x: (-x[4], x[0] - x[1], x[0], x[2]))
    kept: list[tuple[int, int, str, float]] = []
    rank = {s: i + 1 for i, s in enumerate(sorted({x[0] for x in found}))}
    reach = [0] * (len(rank) + 1)  # a Fenwick tree: the furthest end of a kept interval that starts at or before
    for start, end, label, weight, _ in found:
        i, furthest = rank[start], 0
        while i:
            furthest, i = max(furthest, reach[i]), i & (i - 1)
        if furthest < end:
            kept.append((start, end, label, weight))
            i = rank[start]
            while i < len(reach):
                reach[i], i = max(reach[i], end), i + (i & -i)
    return sorted(kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start_word:bigint,end_word:bigint,label:string,weight:double>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text).

    Null and empty texts have no words, no detection and the score 0. The score is 1 minus the product of (1 - weight)
    of the kept detections and, by 0.9, of each base label. Rows are scanned one by one: repeated rows give repeated
    results, and other columns of docs are not read.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                line = b" ".join(words)
                place = positions(line)
                places = base_places(line, place) if b"license" in line else []
                hits = detections(line)
                base = sorted({label for _, label in places})
                miss = 0.1 ** len(base)
                for *_, weight in hits:
                    miss *= 1 - weight
                starts = [p for p, _ in places]
                spans = [{"start_word": place(a), "end_word": place(b) + 1, "label": label, "weight": w} for a, b, label, w in hits]
                out.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(h[2] for h in hits)})), 1 - miss, spans))
            columns = zip(*out, strict=True) if out else [[] for _ in ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("weight", pa.float64())])))])
