"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, drop_stage, in_groups, map_arrow, mixed, stage, unused_names, utf8_rows

ORDER = 5
START = "\x02"  # what stands before a text
QUANTILE = 0.99  # of trusted text
MODEL_ROWS = 6_000_000  # n-grams and contexts that a task holds at once; more are scored in as many passes as needed
NO_LANGUAGE = ""
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(64)]


def normal(text: str) -> str:
    """Lower case, one blank for every run of white space."""
    return " ".join(text.replace(START, " ").lower().split())


def joined(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The normal forms behind order - 1 starts each, joined; the places of their characters; whose they are."""
    forms = [normal(t) for t in texts]
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    ends = np.cumsum(sizes + order - 1)
    place = np.arange(int(sizes.sum())) + np.repeat(ends - np.cumsum(sizes), sizes)
    return "".join(START * (order - 1) + f for f in forms), place, np.repeat(np.arange(len(forms)), sizes)


def symbols(text: str) -> np.ndarray:
    return mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))


def gram_sums(s: np.ndarray, order: int) -> list[np.ndarray]:
    """For m up to order: a 64-bit sum over the m symbols that end at each place (places before the m-th are not used)."""
    out = [np.zeros(len(s), np.uint64)]
    for m in range(order):
        step = out[-1].copy()
        step[m:] += s[: len(s) - m] * _POWERS[m]
        out.append(step)
    return out


# ---------------------------------------------------------------- counts


def _counted(order: int):
    """Per task: how often each character follows the order - 1 characters before it, over words and blanks alike."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), strict=True)
        for group in in_groups(rows, lambda x: len(x[1] or b""), 4_000_000):
            for lang in {x for x, _ in group}:
                text, place, _ = joined([(t or b"").decode() for x, t in group if x == lang], order)
                if not len(place):
                    continue
                sums = gram_sums(symbols(text), order)[order]
                _, first, many = np.unique(sums[place], return_index=True, return_counts=True)
                grams = [text[i - order + 1 : i + 1] for i in place[first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(many, pa.int64())], ["lang", "gram", "n"])

    return each


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), summed in each task before the shuffle."""
    return map_arrow(texts.select("lang", "text"), lambda: _counted(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- model


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of the trusted (lang, text) rows: (lang, kind, gram, value).

    kind p: the probability of the gram's last character after the others; kind g: the weight of the next lower order
    after the context gram; kind v: one over the size of the alphabet (gram empty). Counts, contexts and lower orders
    are joined by (lang, gram), which spreads each language over all tasks. Below the highest order a gram counts the
    distinct characters before it, or its occurrences where it begins a text; each order has three discounts of its own.
    """
    raw = stage(counts(texts, order), "grams")
    size = raw.groupBy("lang").agg(F.countDistinct(F.substring("gram", -1, 1)).alias("v"))
    base = size.select("lang", (1 / (F.col("v") + 1)).alias("uniform"))
    levels = {order: raw}
    for m in range(order - 1, 0, -1):
        wider = levels[m + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        levels[m] = wider.select("lang", "gram", F.when(F.col("gram").startswith(START), F.col("n")).otherwise(F.col("kinds")).alias("n"))
    out, lower = [base.select("lang", F.lit("v").alias("kind"), F.lit("").alias("gram"), F.col("uniform").alias("value"))], None
    for m in range(1, order + 1):
        level = stage(levels[m].withColumn("context", F.expr(f"substring(gram, 1, {m - 1})")), f"level{m}")
        many = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)]
        seen = level.groupBy("lang").agg(*many)
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        # Of a count that no gram has the discount is half of it.
        share = lambda k: F.col(f"n{k + 1}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}"))
        discount = [F.when(F.col(f"n{k}") > 0, F.greatest(F.lit(0.1 * k), F.least(F.lit(float(k)), k - (k + 1) * y * share(k)))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)]
        seen = seen.select("lang", *discount)
        of = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), *(F.count_if(F.least("n", F.lit(3)) == k).alias(f"c{k}") for k in (1, 2, 3)))
        of = of.join(F.broadcast(seen), "lang").withColumn("gamma", (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total"))
        rows = level.join(of, ["lang", "context"])
        own = (F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
        if lower is None:
            rows = rows.join(F.broadcast(base), "lang").withColumn("below", F.col("uniform"))
        else:
            rows = rows.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower.select("lang", F.col("gram").alias("shorter"), F.col("value").alias("below")), ["lang", "shorter"])
        rows = rows.select("lang", F.lit("p").alias("kind"), "gram", (own + F.col("gamma") * F.col("below")).alias("value"), "context", "gamma")
        found = stage(rows, f"order{m}")
        lower = found
        out.append(found.select("lang", "kind", "gram", "value"))
        out.append(found.groupBy("lang", F.col("context").alias("gram")).agg(F.first("gamma").alias("value")).select("lang", F.lit("g").alias("kind"), "gram", "value"))
    return stage(reduce(DataFrame.union, out), "model")


_KIND = {"p": 0, "g": 1, "v": 2}


def language_seed(lang: str) -> int:
    codes = np.frombuffer(lang.encode("utf-32-le"), "<u4").astype(np.uint64)
    return int(mixed(Rolling(mixed(codes + np.uint64(1))).span(np.array([0]), np.array([len(codes)])))[0])


def key_offset(lang: str, kind: str, size: int) -> np.uint64:
    """What makes the sum of a gram of a size its key in the table of a language and a kind."""
    return mixed(np.array([language_seed(lang) ^ (size * 4 + _KIND[kind] + 1)], np.uint64))[0]


def _keyed(table: DataFrame) -> DataFrame:
    """key, value (a logarithm) and before (the character before the predicted one, -1 for none) of each row of the model."""

    def make():
        offsets: dict[tuple, np.uint64] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams = batch.column(2).to_pylist()
            s = symbols("".join(grams))
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            ends, key = np.cumsum(sizes), np.zeros(len(grams), np.uint64)
            for m in range(int(sizes.max(initial=0))):
                at = np.flatnonzero(sizes > m)
                key[at] += s[ends[at] - 1 - m] * _POWERS[m]
            which = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes.tolist(), strict=True))
            for x in set(which) - offsets.keys():
                offsets[x] = key_offset(*x)
            key += np.fromiter(map(offsets.__getitem__, which), np.uint64, len(which))
            before = [ord(g[-2]) if k == "p" and len(g) > 1 else ord(g[-1]) if k == "g" and g else -1 for (_, k, _), g in zip(which, grams, strict=True)]
            value = np.log(np.maximum(batch.column(3).to_numpy(), 1e-300))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value), pa.array(before, pa.int64())], ["key", "value", "before"])

        return each

    return map_arrow(table.select("lang", "kind", "gram", "value"), make, "key long, value double, before long")


class Part:
    """A part of the model, its keys sorted behind an index of their first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, number: int = 0, parts: int = 1, order: int = ORDER):
        keys = keys.view(np.uint64)
        o = np.argsort(keys)
        self.keys, self.values = np.append(keys[o], np.uint64(0)), np.append(values[o], 0.0)
        self.number, self.parts, self.order = number, parts, order
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys[o], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = (key >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        hit = (self.keys[at] == key) & (at < end)
        out = np.where(hit, at, -1)
        open_ = np.flatnonzero(~hit & (at + 1 < end))
        at, end, key = at[open_] + 1, end[open_], key[open_]
        while len(open_):
            hit = self.keys[at] == key
            out[open_[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            open_, at, end, key = open_[more], at[more] + 1, end[more], key[more]
        return out

    def scores(self, lang: str, texts: list[str]) -> np.ndarray:
        """Summed log-probability and number of predicted characters of each text, of this part's characters."""
        out = np.zeros((len(texts), 2))
        uniform = self.find(np.array([key_offset(lang, "v", 0)], np.uint64))[0]
        text, place, owner = joined(texts, self.order)
        if uniform < 0 or not len(place):  # no model of the language, or no character
            return out
        s = symbols(text)
        if self.parts > 1:
            before = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")[place - 1]
            mine = before % self.parts == self.number
            place, owner = place[mine], owner[mine]
        sums = gram_sums(s, self.order)
        found, open_ = np.zeros(len(place)), np.arange(len(place))
        for m in range(self.order, 0, -1):
            here = place[open_]
            at = self.find(sums[m][here] + key_offset(lang, "p", m))
            known = at >= 0
            found[open_[known]] += self.values[at[known]]
            open_ = open_[~known]
            at = self.find(sums[m - 1][place[open_] - 1] + key_offset(lang, "g", m - 1))
            found[open_] += np.where(at >= 0, self.values[at], 0.0)
        found[open_] += self.values[uniform]
        out[:, 0] = np.bincount(owner, found, len(texts))
        out[:, 1] = np.bincount(owner, minlength=len(texts))
        return out


@lru_cache(maxsize=1)
def load_part(path: str, number: int, parts: int, order: int) -> Part:
    """A part from the shared folder. A worker keeps the last one."""
    fs, root = pafs.FileSystem.from_uri(path)
    names = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".parquet")]
    rows = [pq.read_table(x, columns=["key", "value"], filesystem=fs) for x in sorted(names)]
    columns = [np.concatenate([t[c].to_numpy() for t in rows] + [np.zeros(0, kind)]) for c, kind in (("key", np.int64), ("value", np.float64))]
    return Part(*columns, number, parts, order)


def parts_of(table: DataFrame, most: int = MODEL_ROWS, order: int = ORDER) -> list[tuple[str, int, int, int]]:
    """The model in parts of about most rows, written to the shared folder: (path, number, parts, order) of each. The driver sees no row.

    A part holds what predicts a character after certain others; what looks at no character before is in all.
    """
    keyed = stage(_keyed(table), "keyed")
    n = int(keyed.count() // most) + 1
    if n == 1:
        return [(keyed.loom_path, 0, 1, order)]
    out = [(stage(keyed.where((F.col("before") < 0) | (F.pmod("before", F.lit(n)) == k)), "part").loom_path, k, n, order) for k in range(n)]
    drop_stage(keyed)
    return out


def perplexities(docs: DataFrame, parts: list[tuple[str, int, int, int]], n_name: str = "n_predicted", name: str = "perplexity") -> DataFrame:
    """docs (with text and lang) and, of every row, the number of predicted characters and the perplexity (null without any or for a language without a model)."""
    columns, (logp, n) = docs.columns, unused_names(docs, "logp", "predicted")
    text, lang = columns.index("text"), columns.index("lang")
    for k, one in enumerate(parts):

        def make(one=one, k=k):
            part = load_part(*one)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                langs, sums = [x or NO_LANGUAGE for x in batch.column(lang).to_pylist()], []
                for group in in_groups(zip(langs, utf8_rows(batch.column(text)), strict=True), lambda x: len(x[1] or b""), 1_000_000):
                    own = np.zeros((len(group), 2))
                    for which in {x for x, _ in group}:
                        at = [i for i, (x, _) in enumerate(group) if x == which]
                        own[at] = part.scores(which, [(group[i][1] or b"").decode() for i in at])
                    sums.append(own)
                sums = np.concatenate([*sums, np.zeros((0, 2))])
                if k:
                    sums += np.stack([batch.column(len(columns) + j).to_numpy(zero_copy_only=False) for j in (0, 1)], axis=1)
                return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sums[:, 0]), pa.array(sums[:, 1])], [*columns, logp, n])

            return each

        schema = docs.select(*(F.col(f"`{c}`") for c in columns)).schema.add(logp, "double").add(n, "double")
        docs = map_arrow(docs, make, schema)
    own = [F.col(f"`{c}`") for c in columns]
    return docs.select(*own, F.col(n).cast("long").alias(n_name), F.when(F.col(n) > 0, F.exp(-F.col(logp) / F.col(n))).alias(name))


# ---------------------------------------------------------------- classifier


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, text and held (a quarter of the ids, by hash) of documents that are labelled good and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    # the labels grow with the documents, so the join is the same at every size
    rows = docs.select("doc_id", "text", "lang").where("text is not null").join(good.hint("merge"), "doc_id", "left_semi")
    return rows.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held"))


def _deviation(n: str, perplexity: str) -> F.Column:
    """How far the mean log-probability is from the language's middle, in units that don't depend on the length of the text."""
    return (F.log(perplexity) - F.col("middle")) * F.sqrt(n)


def limits(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per language of held-out (lang, n_predicted, perplexity): middle, and highest, the quantile of the deviation."""
    held = held.where("perplexity is not null")
    middle = held.groupBy("lang").agg(F.percentile_approx(F.log("perplexity"), 0.5, 10_000).alias("middle"))
    apart = held.join(middle, "lang").withColumn("d", _deviation("n_predicted", "perplexity"))
    return apart.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx("d", quantile, 10_000).alias("highest"))


def _judged(docs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """docs with the columns n_predicted, perplexity, threshold and keep under the given names."""
    n, perplexity, threshold, keep = names
    trusted = trusted_texts(docs, labels)
    parts = parts_of(model(trusted.where("not held")))
    scored = perplexities(trusted.where("held").select("lang", "text"), parts).select("lang", "n_predicted", "perplexity")
    known = stage(limits(stage(scored, "held")), "limits")
    lang, *rest = unused_names(docs, "kn_lang", "kn_middle", "kn_highest")
    known = known.select(F.col("lang").alias(lang), *(F.col(c).alias(x) for c, x in zip(("middle", "highest"), rest, strict=True)))
    out = perplexities(docs, parts, n, perplexity).join(known, F.coalesce("lang", F.lit(NO_LANGUAGE)) == F.col(lang), "left")
    middle, highest = map(F.col, rest)
    apart = (F.log(perplexity) - middle) * F.sqrt(n)
    out = out.withColumn(threshold, F.exp(middle + F.try_divide(highest, F.sqrt(n)))).withColumn(keep, F.coalesce(apart <= highest, F.lit(True)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *names)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with n_predicted, perplexity, threshold (the highest perplexity kept for the text's length) and keep.

    The model is trained on three quarters of the trusted documents, all of them. The log-perplexity of a text of n
    characters strays from the language's middle by about one over the root of n, so that deviation, times the root of n,
    is what the quantile is of: that of the other quarter, by language. Documents above it are rejected. Junk that
    repeats an ordinary word is as predictable as text and is kept. A document without a word, or of a language without trusted text, can't be judged and is kept. Null texts have no word; null
    languages are a language of their own; labels of one id are merged to the worst; rows that share an id or repeat are
    judged each; very long texts are taken whole; an empty table stays empty; extra columns stay, but columns of docs
    named n_predicted, perplexity, threshold or keep are replaced.
    """
    names = ["n_predicted", "perplexity", "threshold", "keep"]
    return _judged(docs.drop(*names), labels, names)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that classified() keeps, with all their own columns, whatever their names."""
    names = unused_names(docs, "kn_n", "kn_perplexity", "kn_threshold", "kn_keep")
    return _judged(docs, labels, names).where(F.col(names[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
