"""Texts against texts: longest common strings, line pairs, edits, closeness, merging of near-equal lessons."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import dropped, kept

PAIR_RATIO = 0.5
LENGTH_CHANGE = 0.10
SIMILAR = 0.6
BLOCK = 4096  # sets that have one token in front and are joined by it in one task
SLICE = 64  # texts whose hashes are held together
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def window_keys(text: str, size: int, width: int) -> np.ndarray:
    """Hashes of strings of size characters of a text: of every width strings in a row at least the one with the least hash.

    Two texts that share size + width - 1 characters in a row share such a hash.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(len(codes) + 1, BASE, np.uint64)
        powers[0] = 1
        powers, back = np.cumprod(powers), np.full(n, INVERSE, np.uint64)
        back[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[:-1])))
        keys = (sums[size:] - sums[:n]) * np.cumprod(back)
        for shift in (33, 29, 32):
            keys ^= keys >> np.uint64(shift)
            keys *= MIX
    return np.unique(np.lib.stride_tricks.sliding_window_view(keys, width).min(axis=1))


def _grams(df: DataFrame, name: str, text: str, k: int) -> DataFrame:
    """(name, gram) with hashes of strings of each text, chosen so that texts which share k characters in a row share one."""
    width = k // 4 + 1
    size = k - width + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.columns
            for at in range(0, len(batch), SLICE):
                found = [window_keys(t or "", size, width) for t in texts.slice(at, SLICE).to_pylist()]
                rows = pa.array(np.repeat(np.arange(at, at + len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([names.take(rows), pa.array(np.concatenate(found).view(np.int64))], [name, "gram"])

    return df.select(name, text).where(F.col(text).isNotNull()).mapInArrow(each, f"`{name}` {dict(df.dtypes)[name]}, gram long")


class Substrings:
    """All substrings of a text in one automaton: a text streams past it in linear time, whatever repeats in either."""

    def __init__(self, text: str):
        # state 0 is the empty string; each state has its longest string's size, the state of its longest other suffix, and where it first ends
        self.size, self.link, self.end, self.go = [0], [-1], [0], [{}]
        last = 0
        for i, c in enumerate(text):
            new = len(self.size)
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            self.end.append(i + 1)
            self.go.append({})
            at = last
            while at >= 0 and c not in self.go[at]:
                self.go[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.go[at][c]
                if self.size[to] == self.size[at] + 1:
                    self.link[new] = to
                else:
                    twin = len(self.size)
                    self.size.append(self.size[at] + 1)
                    self.link.append(self.link[to])
                    self.end.append(self.end[to])
                    self.go.append(dict(self.go[to]))
                    while at >= 0 and self.go[at].get(c) == to:
                        self.go[at][c] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def longest(self, text: str) -> tuple[int, int, int]:
        """(start, start in the automaton's text, length) of the longest common string: the first in text, then the first in the other."""
        state = length = best = start = other = 0
        go, link, size = self.go, self.link, self.size
        for i, c in enumerate(text):
            while state and c not in go[state]:
                state = link[state]
                length = size[state]
            to = go[state].get(c)
            if to is not None:
                state, length = to, length + 1
                if length > best:
                    best, start, other = length, i + 1 - length, self.end[state] - length
        return start, other, best


def _distinct(df: DataFrame, name: str, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, text) of the distinct texts, and (key, name) of all rows that have one."""
    digest = F.unhex(F.sha2(text, 256)).alias(key)
    df = df.where(F.col(text).isNotNull())
    return df.select(text).distinct().select(digest, text), df.select(digest, name)


def common_strings(texts: DataFrame, references: DataFrame, k: int = 40) -> DataFrame:
    """JN-03: (id, ref, start, ref_start, length): the longest common string of each (id, text) and (ref, ref_text) if it has k characters or more; of equal ones the first in the text, then in the reference.

    Two texts have one exactly if they share a string of k characters. Those that do share a hash of a shorter string (window_keys), so these hashes are
    joined and only the pairs that meet are compared, each in time linear in both texts. Equal texts are compared once, and each of their rows gets what
    was found. Null texts have none.
    """
    ours, rows = _distinct(texts, "id", "text", "one")
    theirs, names = _distinct(references, "ref", "ref_text", "two")
    met = _grams(ours, "one", "text", k).join(_grams(theirs, "two", "ref_text", k), "gram").select("one", "two").distinct()
    pairs = met.join(ours, "one").join(theirs, "two").sortWithinPartitions("two")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, strings = None, None
        for batch in batches:
            rows = []
            for one, two, a, b in zip(batch["one"], batch["two"], batch["text"], batch["ref_text"], strict=True):
                if held != b:
                    held, strings = b, Substrings(b)
                start, other, length = strings.longest(a)
                if length >= k:
                    rows.append((one, two, start, other, length))
            yield pd.DataFrame(rows, columns=["one", "two", "start", "ref_start", "length"])

    found = pairs.select("one", "two", "text", "ref_text").mapInPandas(each, "one binary, two binary, start long, ref_start long, length long")
    return found.join(names, "two").join(rows, "one").select("id", "ref", "start", "ref_start", "length")


def _longest_match(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common string, as difflib finds it: the first in a, then the first in b. Strings of one size are compared as a set."""
    best, start, known, size = 0, 0, min(len(a), len(b)) + 1, 4
    while best + 1 < known:
        size = min(size, known - 1)
        seen = {b[j : j + size] for j in range(len(b) - size + 1)}
        at = next((i for i in range(len(a) - size + 1) if a[i : i + size] in seen), -1)
        if at < 0:
            known, size = size, (best + size) // 2
            continue
        best, start, there = size, at, b.find(a[at : at + size])
        while at + best < len(a) and there + best < len(b) and a[at + best] == b[there + best]:
            best += 1
        size = max(best + 1, min(2 * best, (best + known) // 2))
    return start, b.find(a[start : start + best]), best


def line_ratio(a: str, b: str, least: float = 0.0) -> float:
    """difflib's ratio of two lines without junk; of those below least anything below least, as soon as no rest can lift them."""
    both = len(a) + len(b)
    if not both or a == b:
        return 1.0
    matched, open_ = 0, [(a, b)]
    most = min(len(a), len(b))
    while open_ and 2.0 * most / both >= least:
        x, y = open_.pop(0)
        i, j, k = _longest_match(x, y)
        most -= min(len(x), len(y))
        if k:
            matched += k
            parts = [p for p in ((x[:i], y[:j]), (x[i + k :], y[j + k :])) if p[0] and p[1]]
            most += k + sum(min(map(len, p)) for p in parts)
            open_ += parts
    return 2.0 * (most if open_ else matched) / both


def pair_lines(a: list[str], b: list[str], least: float = PAIR_RATIO) -> dict[int, int]:
    """JN-21: lines of a paired with lines of b, the most alike first, each used once."""
    ranked = sorted((-r, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (r := line_ratio(x, y, least)) >= least)
    out: dict[int, int] = {}
    taken: set[int] = set()
    for _, i, j in ranked:
        if i not in out and j not in taken:
            out[i] = j
            taken.add(j)
    return out


def line_edits(draft: str, live: str) -> list[str]:
    """FN-20: tags of what changed from a draft to the published text: lines cut, added and changed, dashes removed, length."""
    a, b = ([x.strip() for x in t.split("\n") if x.strip()] for t in (draft, live))
    tags = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        pairs = {i1 + i: j1 + j for i, j in pair_lines(a[i1:i2], b[j1:j2]).items()} if tag == "replace" else {}
        if tag == "replace":
            taken = set(pairs.values())
            if i1 == j1 == 0 and 0 not in pairs and 0 not in taken:
                pairs[0] = 0
            if i2 == len(a) and j2 == len(b) and i2 - 1 not in pairs and j2 - 1 not in set(pairs.values()):
                pairs[i2 - 1] = j2 - 1
        for i in range(i1, i2):
            tags.append("cut_line" if i not in pairs else "changed_first_line" if i == 0 else "changed_ending" if i == len(a) - 1 else "changed_line")
        tags += ["added_line"] * (j2 - j1 - len(pairs))
    if live.count("—") < draft.count("—"):
        tags.append("removed_em_dash")
    before, after = (len(re.findall(r"[A-Za-z0-9][A-Za-z0-9'’\-]*", t)) for t in (draft, live))
    if before and abs(after - before) / before >= LENGTH_CHANGE:
        tags.append("shortened" if after < before else "lengthened")
    return tags


def edits(pairs: DataFrame, draft: str = "draft", live: str = "live") -> DataFrame:
    """FN-20: pairs with edits, an array of tags."""

    @F.pandas_udf("array<string>")
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([line_edits(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("edits", each(draft, live))


def closest(candidates: DataFrame, exemplars: DataFrame, n: int = 2) -> DataFrame:
    """JN-15: the n exemplars of each candidate that agree in most of archetype, hook and ending, then by Jaccard of words, then by id.

    Both have id, archetype, hook, ending and words (an array). Exemplars that agree in a field come first; a candidate that has fewer than n of them takes
    those that share a word, and then the first by id, of which 2 n are enough.
    """
    fields = ("archetype", "hook", "ending")
    sides = [df.select(F.col("id").alias(f"{x}_id"), F.col("words").alias(f"{x}_words"), *(F.col(f).alias(f"{x}_{f}") for f in fields)) for df, x in ((candidates, "c"), (exemplars, "e"))]
    tagged = [s.select(f"{x}_id", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"{x}_{f}").alias("v")) for f in fields))).alias("on")).where("on.v is not null") for s, x in zip(sides, "ce", strict=True)]
    alike = tagged[0].join(tagged[1], "on").groupBy("c_id", "e_id").agg(F.count_distinct("on.f").cast("int").alias("same"))
    # Words are looked at only where they can decide: a pair that agrees in fewer fields than n others of its candidate is none of the n.
    levels = alike.groupBy("c_id").pivot("same", list(range(1, len(fields) + 1))).count().na.fill(0)
    above, level = F.lit(0), F.lit(1)
    for k in range(1, len(fields) + 1):
        above = sum((F.col(str(j)) for j in range(k, len(fields) + 1)), F.lit(0))
        level = F.when(above >= n, k).otherwise(level)
    least = levels.select("c_id", level.alias("level"), sum((F.col(str(k)) for k in range(1, len(fields) + 1)), F.lit(0)).alias("count"))
    kept = alike.join(least.select("c_id", "level"), "c_id").where("same >= level").select("c_id", "e_id")
    few = sides[0].select("c_id", "c_words").join(least.where(F.col("count") >= n), "c_id", "left_anti")
    by_word = [few.select("c_id", F.explode(F.array_distinct("c_words")).alias("word")), sides[1].select("e_id", F.explode(F.array_distinct("e_words")).alias("word"))]
    shared = by_word[0].join(by_word[1], "word").select("c_id", "e_id").distinct()
    first = sides[1].select("e_id").distinct().orderBy("e_id").limit(2 * n).agg(F.collect_list("e_id").alias("ids"))
    rest = few.select("c_id").crossJoin(first).select("c_id", F.explode("ids").alias("e_id"))
    met = kept.unionByName(shared).unionByName(rest).distinct().join(sides[0], "c_id").join(sides[1], "e_id")
    same = sum(F.coalesce((F.col(f"c_{f}") == F.col(f"e_{f}")).cast("int"), F.lit(0)) for f in fields)
    both = F.size(F.array_union("c_words", "e_words"))
    jaccard = F.when(both > 0, F.size(F.array_intersect("c_words", "e_words")) / both).otherwise(0.0)
    ranked = met.withColumn("same", same).withColumn("jaccard", jaccard)
    place = F.row_number().over(Window.partitionBy("c_id").orderBy(F.desc("same"), F.desc("jaccard"), "e_id"))
    return ranked.withColumn("k", place).where(F.col("k") <= n).select(F.col("c_id").alias("id"), F.col("e_id").alias("exemplar"), "same", F.round("jaccard", 6).alias("jaccard"), "k")


def similar_sets(sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(id, other) of the sets (id, scope, tokens: distinct ones) of one scope with a Jaccard of least or more, id < other.

    Two such sets share c = ceil(least / (1 + least) (n + m)) tokens or more. In a common order, rare tokens first, the first shared one is then among the
    first n - c + 1 of the one and m - c + 1 of the other, so these are joined. Of the pairs that meet, those whose parity bitmaps differ in more bits than
    n + m - 2 c are none; the rest are compared whole. A token that more than BLOCK sets have in front is dealt to blocks, and a task counts for two of them.
    """
    share, bits = least / (1 + least), [f"bits{w}" for w in range(4)]
    tokens = sets.select("id", F.xxhash64("scope").alias("at"), "scope", F.size("tokens").alias("n"), F.explode("tokens").alias("word"))
    tokens = tokens.select("id", "at", "n", F.xxhash64("scope", "word").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    parity = [F.expr(f"bit_xor(if((token & 192) = {64 * w}, shiftleft(1L, cast(token & 63 as int)), 0L))").alias(x) for w, x in enumerate(bits)]
    listed = tokens.join(often, "token").groupBy("id", "at", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"), *parity)
    front = F.slice("all", 1, (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int"))
    firsts = listed.select("id", "n", *bits, F.posexplode(front).alias("p", "first")).select("id", "n", *bits, "p", "first.token", "first.df")
    firsts = kept(firsts.where("df > 1").drop("df"), "firsts")
    heavy = firsts.groupBy("token").count().where(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = firsts.join(F.broadcast(heavy), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), "blocks").cast("int")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "beside").alias("low"), F.greatest("block", "beside").alias("high"), "id", "n", "p", "block", *bits)
    few = dealt.where(F.col("p") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9)).alias("x")  # p counts from 0; x is the smaller set
    n, m, must = F.col("x.n"), F.col("y.n"), F.ceil(share * (F.col("x.n") + F.col("y.n")) - 1e-9)
    good = (n < m) | ((n == m) & (F.col("x.id") < F.col("y.id")))
    good &= (F.col("x.p") <= n - must) & (F.col("y.p") <= m - must)
    good &= (F.col("x.block") != F.col("y.block")) == (F.col("x.low") != F.col("x.high"))
    good &= sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits), F.lit(0)) <= n + m - 2 * must
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "low", "high")]
    met = few.join(dealt.alias("y"), [*same, good]).select(F.least("x.id", "y.id").alias("id"), F.greatest("x.id", "y.id").alias("other")).distinct()
    met = kept(met, "met")
    whole = met.join(sets.select("id", F.col("scope").alias("a"), F.col("tokens").alias("x")), "id").join(sets.select(F.col("id").alias("other"), F.col("scope").alias("b"), F.col("tokens").alias("y")), "other")
    common = F.size(F.array_intersect("x", "y"))
    return whole.where(F.col("a").eqNullSafe(F.col("b")) & (common / (F.size("x") + F.size("y") - common) >= least)).select("id", "other")


def _leaders(pairs: DataFrame) -> DataFrame:
    """(id) of the ends of pairs (id < other) that no earlier leader is paired with. An end without an open earlier one is a leader, and closes those it is paired with."""
    open_, found = pairs, None
    while open_.limit(1).count():
        first = kept(open_.select("id").join(open_.select(F.col("other").alias("id")), "id", "left_anti").distinct(), "leaders")
        closed = open_.join(first, "id", "left_semi").select("other").distinct()
        rest = open_.join(first, "id", "left_anti").join(closed.select(F.col("other").alias("id")), "id", "left_anti").join(closed, "other", "left_anti")
        last, open_ = open_, kept(rest.select("id", "other"), "open")
        found = first if found is None else found.unionByName(first)
        if last is not pairs:
            dropped(last)
    return found if found is not None else pairs.select("id").limit(0)


def consolidate(lessons: DataFrame) -> DataFrame:
    """ST-03 (first part): lessons (id, section, tag, instruction, count) with merged_into: in order, each takes in the later ones of its section and tag with a token Jaccard of 0.6 or more.

    Equal sets of tokens are one to all others, so each is compared once, under its least id. What is taken in takes nothing in; of several that could
    take a lesson the first does. Ids are of one section and tag.
    """

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(re.findall(r"\w+", t.lower()))) if isinstance(t, str) else [])

    scope = F.struct("section", "tag").alias("scope")
    parsed = kept(lessons.select("id", scope, tokens("instruction").alias("tokens")).where("size(tokens) > 0"), "tokens")
    sets = kept(parsed.groupBy("scope", "tokens").agg(F.min("id").alias("id")), "sets")
    pairs = kept(similar_sets(sets), "similar")
    into = pairs.join(_leaders(pairs), "id", "left_semi").groupBy("other").agg(F.min("id").alias("into"))
    ends = sets.select("scope", "tokens", F.col("id").alias("first")).join(into, F.col("first") == F.col("other"), "left").select("scope", "tokens", "first", "into")
    copies = parsed.join(ends, ["scope", "tokens"]).select("id", F.coalesce("into", F.when(F.col("id") != F.col("first"), F.col("first"))).alias("merged_into"))
    return lessons.join(copies.where("merged_into is not null"), "id", "left")


def resolve_draft(drafts: DataFrame, query: str) -> DataFrame:
    """TK-09: drafts (cid, run, run_date, title) by how many of the query's words they hold: 1 for a word, 0.6 for its beginning, 0.8 for the cid, over the number of words; ambiguous is true where the best is shared."""
    asked = query.lower().split()
    words = F.split(F.regexp_replace(F.lower(F.col("title")), "[^a-z0-9]+", " "), " ")

    def found(w: str) -> Column:
        return F.when(F.array_contains(words, w), 1.0).when(F.lower("cid") == w, 0.8).when(F.exists(words, lambda x: x.startswith(F.lit(w))), 0.6).otherwise(0.0)

    score = sum(map(found, asked), F.lit(0.0)) / max(1, len(asked))
    scored = drafts.withColumn("score", score).where("score > 0")
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    return scored.withColumn("ambiguous", F.col("score") == best).where("ambiguous").withColumn("ambiguous", F.count("*").over(Window.partitionBy(F.lit(1))) > 1).orderBy(F.desc("run_date"), "cid")
