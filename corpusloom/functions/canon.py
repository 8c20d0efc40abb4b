"""Canonical forms of text: folded punctuation, normal form, slugs, weighted length and what stands above the fold.

Unicode normalisation has no built-in expression, so these are Arrow-batched pandas UDFs; null stays null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 256

# Fixed values.
FOLDED = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "—": "-", "–": "-", "―": "-", "…": "...", " ": " "}
URL = re.compile(r"https?://\S+|www\.\S+", re.IGNORECASE)
PICTURE = "[\U0001f300-\U0001faff\U00002600-\U000027bf\U0001f000-\U0001f2ff\U0001f900-\U0001f9ff⭐⬆↔-↪⏩-⏺▪-◾⤴⤵〰〽㊗㊙\U0001f1e6-\U0001f1ff]"
EMOJI = re.compile(f"[\U0001f1e6-\U0001f1ff]{{2}}|[0-9#*]️?⃣|{PICTURE}(?:️|[\U0001f3fb-\U0001f3ff]|‍(?:{PICTURE}|[♀♂⚕⚖✈❤])️?)*")
LIGHT = ((0x0000, 0x10FF), (0x2000, 0x200D), (0x2010, 0x201F), (0x2032, 0x2037))
URL_UNITS, EMOJI_UNITS, HEAVY_UNITS = 23, 2, 2
URL_TRAIL = ".,;:!?'\"]"

_FOLD = str.maketrans(FOLDED)


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_FOLD)


def _normal(text: str) -> str:
    plain = EMOJI.sub(" ", URL.sub(" ", _fold(text).lower()))
    return " ".join(re.sub(r"[^\w\s']", " ", plain).replace("'", "").split())


def _slug(name: str) -> str:
    ascii_ = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower().strip().lstrip("@")
    slug = re.sub("[^a-z0-9]+", "-", ascii_).strip("-") or "unknown"
    return f"author-{slug}" if slug[0].isdigit() else slug


def _url_end(url: str) -> int:
    """Where a matched address ends without the punctuation and unbalanced brackets behind it."""
    end = len(url)
    while end and (url[end - 1] in URL_TRAIL or url[end - 1] == ")" and url.count(")", 0, end) > url.count("(", 0, end)):
        end -= 1
    return end


def units(text: str) -> Iterator[tuple[int, int]]:
    """(length, weight) of the parts of an NFC text that a weighted count never splits: addresses, emoji, characters."""
    at, ends = 0, {m.start(): m.start() + _url_end(m[0]) for m in URL.finditer(text)}
    while at < len(text):
        if ends.get(at, 0) > at:
            step, weight = ends[at] - at, URL_UNITS
        elif m := EMOJI.match(text, at):
            step, weight = len(m[0]), EMOJI_UNITS
        else:
            step, weight = 1, 1 if any(low <= ord(text[at]) <= high for low, high in LIGHT) else HEAVY_UNITS
        yield step, weight
        at += step


def _weight(text: str) -> int:
    return sum(w for _, w in units(unicodedata.normalize("NFC", text)))


def cut_index(text: str, budget: int) -> int:
    """How many characters fit in a budget of units, an emoji being two and all else one; no emoji is split."""
    at = used = 0
    while at < len(text):
        m = EMOJI.match(text, at)
        step, weight = (len(m[0]), EMOJI_UNITS) if m else (1, 1)
        if used + weight > budget:
            break
        at, used = at + step, used + weight
    return at


_CLAUSE_END = re.compile(r"[.!?…:;,](?=\s|$)|\n")


def _above_fold(text: str, budget: int, lines: int) -> tuple[int, str | None, bool, bool]:
    """(cut index, what cuts, whether a clause ends before it, whether it falls inside a word)."""
    rows = text.split("\n")
    head = "\n".join(rows[:lines])
    at = cut_index(head, budget)
    if at < len(head):
        by = "chars"
    elif len(rows) > lines:
        by = "lines"
    else:
        return len(text), None, True, False
    ended = any(m.end() <= at for m in _CLAUSE_END.finditer(text, 0, at + 1))
    inside = by == "chars" and 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return at, by, ended, inside


def _mapped(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    to = {"string": pa.string(), "long": pa.int64()}[kind]

    @F.arrow_udf(kind)
    def each(texts: pa.Array) -> pa.Array:
        # a slice at a time becomes Python strings, so a batch of long texts is never held as such
        parts = (texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE))
        return pa.concat_arrays([pa.array([], to), *(pa.array([None if t is None else f(t) for t in part], to) for part in parts)])

    return each


def fold_punct(text: Column | str) -> Column:
    """FN-01: NFKC, and quotes, dashes, ellipses and hard blanks as their plain forms."""
    return _mapped(_fold, "string")(text)


def normalize_text(text: Column | str) -> Column:
    """FN-02: folded, lower case, without addresses, emoji, punctuation and apostrophes, blanks collapsed."""
    return _mapped(_normal, "string")(text)


def slugify(name: Column | str) -> Column:
    """PRJ-04: an ASCII slug; `unknown` for nothing, `author-` before a digit."""
    return _mapped(_slug, "string")(name)


def x_length(text: Column | str) -> Column:
    """FN-07: weighted length: an address 23, an emoji 2, heavy characters 2, all else 1."""
    return _mapped(_weight, "long")(text)


def above_fold(text: Column | str, budget: int = 140, lines: int = 3) -> Column:
    """FN-18: struct<cut_index, cut_by, boundary_within, mid_word> of what shows before the text is folded."""

    @F.pandas_udf("cut_index long, cut_by string, boundary_within boolean, mid_word boolean")
    def each(texts: pd.Series) -> pd.DataFrame:
        rows = [_above_fold(t, budget, lines) if isinstance(t, str) else (None, None, None, None) for t in texts]
        return pd.DataFrame(rows, columns=["cut_index", "cut_by", "boundary_within", "mid_word"])

    return each(text)
