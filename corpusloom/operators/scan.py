"""A scan of texts for the rules of a table: literal phrases by one automaton, patterns one after another, spans in the text as it was given."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import FOLDED

RULE = "id string, `group` string, rank int, phrase string, pattern string, flags string, scope string, anchored boolean"
HIT = "struct<start:int,rank:int,stop:int,id:string,span:string,group:string,line:int>"
FIELDS = ("id", "group", "rank", "phrase", "pattern", "flags", "scope", "anchored")
SCOPES = ("text", "line1", "tail2")
#: The table of rules goes to every task, so it is measured; a larger one is refused, not cut.
MOST_BYTES = 32 << 20
SLICE = 64
#: What str.split() calls a word in an ASCII text.
_WORDS = re.compile(r"[^\x09-\x0d\x1c-\x20]+")

_FLAGS = {"i": re.IGNORECASE, "s": re.DOTALL, "x": re.VERBOSE}


def plain_case(c: str) -> str:
    """The one character that stands for all cases of c in comparisons without case."""
    upper = c.upper()
    lower = (upper if len(upper) == 1 else c).lower()
    return lower if len(lower) == 1 else c


class Text:
    """A text folded character by character, with the place in the text of each folded one, and with its lines that are not blank."""

    def __init__(self, text: str):
        self.text = text
        if text.isascii():
            self.folded, self.origin = text, range(len(text))
        else:
            parts = ["".join(FOLDED.get(f, f) for f in unicodedata.normalize("NFKC", c)) for c in text]
            self.folded = "".join(parts)
            self.origin = [i for i, p in enumerate(parts) for _ in p]
        self.breaks = [m.start() for m in re.finditer("\n", self.folded)]
        edges = [-1, *self.breaks, len(self.folded)]
        self.lines = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if self.folded[a + 1 : b].strip()]

    def scope(self, name: str) -> tuple[int, int] | None:
        if name == "text":
            return 0, len(self.folded)
        if not self.lines:
            return None
        return self.lines[0] if name == "line1" else (self.lines[-2:][0][0], self.lines[-1][1])

    def hit(self, start: int, stop: int, rule: tuple) -> tuple:
        """(start, rank, stop, id, span, group, line); start and stop are places in the text as given."""
        first, last = self.origin[start], self.origin[stop - 1] + 1
        return first, rule[2], last, rule[0], self.text[first:last], rule[1], bisect_right(self.breaks, start - 1) + 1


def phrase_form(phrase: str) -> str:
    """FN-14: a phrase without case, its words joined by one blank."""
    return " ".join("".join(map(plain_case, Text(phrase).folded)).split())


def ascii_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Scanner:
    """The rules of a table, ready to scan. Literal phrases share one automaton, so a text is read once for all of them."""

    def __init__(self, rules: tuple[tuple, ...]):
        self.patterns, by_form = [], {}
        for rule in rules:
            id_, _, _, phrase, pattern, flags, scope, anchored = rule
            if scope not in SCOPES:
                raise ValueError(f"rule {id_}: no scope {scope}")
            if pattern:
                try:
                    how = sum({_FLAGS[f] for f in flags if f in _FLAGS}, re.MULTILINE)
                    self.patterns.append((re.compile(pattern, how), rule))
                except re.error as e:
                    raise ValueError(f"rule {id_}: {e}") from e
            elif phrase and (form := phrase_form(phrase)):
                by_form.setdefault(form, []).append(rule)
        self.phrases = list(by_form.items())
        self.automaton = ahocorasick.Automaton() if self.phrases else None
        for k, (form, _) in enumerate(self.phrases):
            self.automaton.add_word(form, (k, len(form)))
        if self.automaton:
            self.automaton.make_automaton()

    def _literal(self, text: Text) -> Iterator[tuple[int, int, int]]:
        """(start, stop, number of the phrase) in the folded text, in order of stop; white space counts as one blank."""
        if text.folded.isascii():
            # a character is one character in lower case, so only hits need their places: by the words they begin and end in
            words = text.folded.lower().split()
            ends = None
            for end, (k, size) in self.automaton.iter(" ".join(words)):
                if ends is None:
                    ends = list(accumulate((len(w) + 1 for w in words)))
                    places = [m.start() for m in _WORDS.finditer(text.folded)]
                first, last = (bisect_right(ends, x) for x in (end - size + 1, end))
                yield places[first] + end - size + 1 - (ends[first] - len(words[first]) - 1), places[last] + end + 1 - (ends[last] - len(words[last]) - 1), k
            return
        plain, places, space = [], [], True
        for i, c in enumerate(text.folded):
            if c.isspace():
                if not space:
                    plain.append(" ")
                    places.append(i)
                space = True
            else:
                plain.append(plain_case(c))
                places.append(i)
                space = False
        for end, (k, size) in self.automaton.iter("".join(plain)):
            yield places[end - size + 1], places[end] + 1, k

    def hits(self, value: str | None, disjoint: bool = False) -> list[tuple]:
        """FN-15: all hits in order of start, rank, stop and id. Those of one rule don't overlap; with disjoint those of one group don't (see leftmost)."""
        if not value:
            return []
        text, out = Text(value), []
        ranges = {s: text.scope(s) for s in SCOPES}
        if self.automaton:
            folded, reached = text.folded, {}
            for start, stop, k in self._literal(text):
                form, rules = self.phrases[k]
                if takes_boundary(form[0]) and start and ascii_word(folded[start - 1]):
                    continue
                for n, rule in enumerate(rules):
                    within = ranges[rule[6]]
                    if within is None or start < within[0] or stop > within[1]:
                        continue
                    if stop < within[1] and takes_boundary(form[-1]) and ascii_word(folded[stop]):
                        continue
                    if rule[7] and start != _first_word(folded, *within):
                        continue
                    if start >= reached.get((k, n), 0):
                        reached[k, n] = stop
                        out.append(text.hit(start, stop, rule))
        for compiled, rule in self.patterns:
            within = ranges[rule[6]]
            if within is None:
                continue
            low, high = within
            if rule[7]:
                m = compiled.match(text.folded, _first_word(text.folded, low, high), high)
                found = [m] if m else []
            else:
                found = compiled.finditer(text.folded, low, high)
            out.extend(text.hit(*m.span(), rule) for m in found if m.end() > m.start())
        out.sort(key=lambda h: (h[0], h[1], h[2], h[3]))
        return disjoint_hits(out) if disjoint else out


def takes_boundary(c: str) -> bool:
    """Whether a phrase's end takes a boundary: letters and digits of any script do."""
    return c.isalnum()


def _first_word(folded: str, low: int, high: int) -> int:
    """Where the first letter or digit stands."""
    return next((i for i in range(low, high) if folded[i].isalnum()), high)


def disjoint_hits(hits: list[tuple]) -> list[tuple]:
    """WN-11 in each group: by start, rank and falling length; a hit stays if it begins where the group's last kept one ended, or later."""
    ends: dict = {}
    out = []
    for h in sorted(hits, key=lambda h: (h[0], h[1], -h[2])):
        if h[0] >= ends.get(h[5], -1):
            ends[h[5]] = h[2]
            out.append(h)
    return out


@lru_cache(maxsize=4)
def _scanner(digest: str, rules: tuple[tuple, ...]) -> Scanner:
    return Scanner(rules)


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A table of rules from dictionaries; absent fields take what filled() gives them."""
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rules], RULE)


def filled(rules: DataFrame) -> DataFrame:
    """Rules with all fields: rank 2, flags i (case is not looked at), scope text, not anchored, and the id's part before a point as the group."""
    rules = rules.withColumns({f: F.lit(None).cast("string") for f in FIELDS if f not in rules.columns})
    given = {"rank": 2, "flags": "i", "scope": "text", "anchored": False}
    group = F.coalesce(F.col("group").cast("string"), F.element_at(F.split("id", r"\."), 1)).alias("group")
    kinds = {"rank": "int", "anchored": "boolean"}
    rest = [F.coalesce(F.col(f).cast(kinds.get(f, "string")), F.lit(given[f])).alias(f) if f in given else F.col(f).cast("string").alias(f) for f in FIELDS if f != "group"]
    return rules.select(group, *rest).select(*FIELDS).where("id is not null and coalesce(pattern, phrase, '') != ''")


def taken(rules: DataFrame) -> tuple[str, tuple[tuple, ...]]:
    """The rules with a digest. They are counted in bytes first."""
    table = filled(rules)
    size = table.agg(F.sum(F.length("id") + F.length(F.coalesce("phrase", F.lit(""))) + F.length(F.coalesce("pattern", F.lit(""))) + 64)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a rules table of {size} bytes does not go to every task; scan with parts of it")
    found = tuple(sorted((tuple(r) for r in table.collect()), key=lambda r: tuple(str(x) for x in r)))
    return hashlib.sha256(repr(found).encode()).hexdigest(), found


def _slices(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """A few rows of a batch at a time, so that only their hits are Python objects."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32()), ("id", pa.string()), ("span", pa.string()), ("group", pa.string()), ("line", pa.int32())]))


def _hit_lists(rows: list[list[tuple]]) -> pa.Array:
    flat = list(zip(*(h for hits in rows for h in hits), strict=True)) or [()] * 7
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _HITS.value_type, strict=True)], fields=list(_HITS.value_type))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), values)


def rule_hits(texts: DataFrame, rules: DataFrame, text: str = "text", disjoint: bool = False, name: str = "hits") -> DataFrame:
    """FN-15: texts with hits: array<struct<start,rank,stop,id,span,group,line>> of all rules, by start, rank, stop, id.

    Rules have an id and a phrase (words with any white space between; no ASCII letter or digit beside it) or a pattern; see filled() for the rest.
    scope is the text, its first line or its last two that are not blank; an anchored rule must begin at the first letter or digit of its scope. Quotes,
    dashes and compatibility forms are folded for the match; start and stop are places in the text as it is, stop behind the last character. Null and
    empty texts have no hits, rules without phrase and pattern none. A text costs time linear in its length and hits for all phrases together.
    """
    digest, found = taken(rules)
    shared = texts.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf(f"array<{HIT}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner(digest, shared.value)
        for part in _slices(batches):
            yield _hit_lists([scanner.hits(t, disjoint) for t in part.to_pylist()])

    return texts.withColumn(name, scan(F.col(text)))


def register(spark: SparkSession, rules: DataFrame, name: str = "rule_hits") -> None:
    """The scan as a table function for SQL: select ... from texts, lateral rule_hits(text)."""
    digest, found = taken(rules)
    shared = spark.sparkContext.broadcast(found)

    class Scan:
        def __init__(self):
            self.scanner = _scanner(digest, shared.value)

        def eval(self, text: str):
            yield from self.scanner.hits(text)

    spark.udtf.register(name, F.udtf(Scan, returnType="start int, rank int, stop int, id string, span string, `group` string, line int"))


def leftmost(hits: Column | str) -> Column:
    """WN-11: the hits of an array (as rule_hits gives them) that don't overlap: by start, then rank, then the longest, whatever their group."""

    @F.arrow_udf(f"array<{HIT}>")
    def each(hits: pa.Array) -> pa.Array:
        out = []
        for part in _slices([hits]):
            rows = part.flatten()
            start, rank, stop = (rows.field(n).to_pylist() for n in ("start", "rank", "stop"))
            at, lists, offsets = 0, [], [0]
            for size in pc.fill_null(pc.list_value_length(part), -1).to_pylist():
                last = -1
                for k in sorted(range(at, at + max(size, 0)), key=lambda k: (start[k], rank[k], -stop[k])):
                    if start[k] >= last:
                        last = stop[k]
                        lists.append(k)
                at += max(size, 0)
                offsets.append(len(lists))
            mask = part.is_null() if part.null_count else None
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows.take(pa.array(lists, pa.int64())), mask=mask))
        return pa.concat_arrays(out) if out else hits

    return each(F.col(hits) if isinstance(hits, str) else hits)


def tiers(hits: Column | str, groups: tuple[str, ...] = ("t1", "t2", "t3", "claude")) -> Column:
    """AG-20: struct of the counts of hits in each tier, after leftmost() over all tiers, and whether they are a cluster."""
    kept = leftmost(hits)
    count = lambda g: F.size(F.filter(kept, lambda h: h["group"] == g))
    n = [count(g) for g in groups]
    cluster = (n[0] >= 3) | (n[0] + n[1] + n[2] >= 5) | (n[3] >= 2)
    return F.struct(*(c.alias(g) for c, g in zip(n, groups, strict=True)), cluster.alias("cluster"))
