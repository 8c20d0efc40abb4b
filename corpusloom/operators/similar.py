"""Pairs of texts that share most of their word n-grams: an exact prefix join over hashes, rare ones first, and a comparison of the grams themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import dropped, kept

BITS = 40  # of a gram's hash. It only finds candidates, so that two grams of one hash cost time and change nothing.
TOGETHER = 256  # texts whose grams are hashed together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _BASE
    return (h ^ (h >> np.uint64(29))) * _BASE


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text, ASCII words joined by one blank, the distinct hashes of its grams of width words."""
    codes = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), dtype=np.uint64)])
    ends = np.flatnonzero(codes == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    h = _mixed((sums[last] - sums[first]) * _powers(_INVERSE, len(codes))[first]) if len(last) else np.zeros(0, np.uint64)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    low = np.searchsorted(starts, at)  # the first word of each text
    return [np.unique(h[a : max(a, b - width + 1)]) if t else h[:0] for t, a, b in zip(texts, low, low[1:], strict=False)]


def _gram_rows(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, h) for each distinct gram of docs (id, norm, k), n in number; k, a hash of the keys, is mixed into h."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = gram_hashes([t.encode() for t in part.column(1).to_pylist()], width)
                sizes = np.array([len(x) for x in found], np.int64)
                keys = _mixed(part.column(2).to_numpy().view(np.uint64))
                h = _mixed(np.concatenate(found) ^ np.repeat(keys, sizes)) >> np.uint64(64 - BITS)
                if len(h):
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), sizes)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(h.view(np.int64))], ["id", "n", "h"])

    return docs.select("id", "norm", "k").mapInArrow(each, f"id {dict(docs.dtypes)['id']}, n int, h long")


def _compared(pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, c, an, bn) of pairs (a, b, a_norm, b_norm): the distinct grams that both have, and each."""

    def grams(text: str) -> set[str]:
        w = text.split(" ")
        return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = grams(one.as_py()), grams(two.as_py())
                out.append((len(x & y), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in zip(*out, strict=True))], ["a", "b", "c", "an", "bn"]) if out else batch.slice(0, 0)

    id_ = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "a_norm", "b_norm").mapInArrow(each, f"a {id_}, b {id_}, c long, an long, bn long")


def copies(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(id, first) of the rows of docs (id, norm, keys) whose keys and norm a row of a smaller id has too, first being the least. Written."""
    by = Window.partitionBy(*keys, "sha")
    rows = docs.select("id", *keys, F.sha2("norm", 256).alias("sha")).withColumn("first", F.min("id").over(by))
    return kept(rows.where(F.col("id") != F.col("first")).select("id", "first"), "copies")


def jaccard() -> Column:
    return F.col("c").cast("double") / (F.col("an") + F.col("bn") - F.col("c"))


def similar(docs: DataFrame, keys: list[str], width: int, least: float) -> DataFrame:
    """(a, b, c, an, bn) of all pairs a < b of docs (id, norm, keys) with equal keys and a Jaccard of their width-grams of least or more. Written.

    norm is ASCII words joined by one blank; ids are distinct; a null key is like none. A text whose grams are shared to less than the share that least
    asks for is like none. Of the others only the rarest shared grams are joined, as many as two similar texts can't both be without. What meets is
    compared whole, by the grams and not their hashes. Shuffled are 40 bits and an id for each gram, and texts only of pairs that meet.
    """
    docs = docs.where(" and ".join(f"{c} is not null" for c in ["id", *keys])).withColumn("k", F.xxhash64(*keys))
    need = F.ceil(F.col("n") * least - 1e-9)
    rows = _gram_rows(docs, width).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("df > 1")
    lists = rows.groupBy("id", "n").agg(F.collect_list(F.struct("df", "h")).alias("grams")).where(F.size("grams") >= need)
    prefix = lists.select("id", "n", F.explode(F.slice(F.array_sort("grams"), F.lit(1), (F.size("grams") - need + 1).cast("int"))).alias("g")).select("id", "n", "g.h")
    prefix = kept(prefix, "prefix")
    one, two = (prefix.select("h", F.col("id").alias(x), F.col("n").alias(f"{x}n")) for x in "ab")
    near = (F.col("an") >= F.col("bn") * least - 1e-9) & (F.col("bn") >= F.col("an") * least - 1e-9)
    met = kept(one.join(two, "h").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct(), "met")
    ids = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = kept(docs.join(kept(ids, "ids"), "id", "left_semi").select("id", "norm", *keys), "texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("norm").alias(f"{x}_norm"), F.struct(*keys).alias(f"{x}_keys"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where("a_keys = b_keys")
    found = kept(_compared(pairs, width).where(jaccard() >= least), "similar")
    dropped(prefix, met, texts)
    return found
