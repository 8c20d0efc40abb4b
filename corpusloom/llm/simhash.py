"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by lookups of Hamming balls in segment tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, stage, utf8_rows
from .components import components

SHINGLE = 3  # words, as the contract of the query has it
SEED = 42
BITS = 64
SEGMENTS = 4
RADIUS = 2  # differing bits of a link


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text; 0 for a null text or one without words."""
    words = data.translate(LOWER).split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in cuts), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row. Extra columns are not looked at."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle) for t in utf8_rows(batch.column(1))], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return each

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, fp long")


def _mask(segment: int) -> int:
    """The bits of a segment, as a signed long."""
    width = BITS // SEGMENTS
    mask = ((1 << width) - 1) << (segment * width)
    return mask - (1 << 64) if mask >> 63 else mask


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def segment_keys(fp: Column) -> list[Column]:
    """The tables' keys of a fingerprint: for each segment that is left out, the three others."""
    return [F.struct(F.lit(out).cast("byte").alias("out"), fp.bitwiseAND(F.lit(~_mask(out))).alias("key")) for out in range(SEGMENTS)]


def probes(fp: Column) -> list[Column]:
    """The keys that a fingerprint is looked up under: its own, and in each table the radius-1 Hamming balls of the later segments."""
    width, balls = BITS // SEGMENTS, []
    for out in range(SEGMENTS):
        for bit in range((out + 1) * width, BITS):
            balls.append(F.struct(F.lit(out).cast("byte").alias("out"), fp.bitwiseXOR(F.lit(_bit(bit))).bitwiseAND(F.lit(~_mask(out))).alias("key")))
    return segment_keys(fp) + balls


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between all fingerprints at two or fewer differing bits.

    Multi-index hashing over four segments of 16 bits. Two differing bits lie in one segment or in two: table k holds
    every fingerprint under the segments other than k. If the bits lie in one segment, the others are equal and the
    fingerprint's own key finds the match; if they lie in two, the table that leaves out the earlier one is looked up
    under the Hamming ball of the later one. Every match is verified by the complete distance. A key fixes 48 bits, so
    that at most 2**16 distinct fingerprints share one, however many documents there are.
    """
    spark = distinct.sparkSession
    fp = distinct.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")  # a small table that grows a hundredfold in the next step
    table = fp.select(F.col("fp").alias("b"), F.explode(F.array(*segment_keys(F.col("fp")))).alias("at")).select("b", "at.*")
    asked = fp.select(F.col("fp").alias("a"), F.explode(F.array(*probes(F.col("fp")))).alias("at")).select("a", "at.*")
    met = asked.join(table, ["out", "key"]).where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS) & (F.col("a") != F.col("b")))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id reachable over links, itself included).

    Equal fingerprints are folded to one row before any link is sought, so a group of copies costs one row, and the
    last join has the (possibly hot) fingerprint on its streamed side only, where adaptive execution splits it.
    Null or wordless texts have fingerprint zero and are linked like any other; very long texts are taken whole; a null
    doc_id never names a component (a component of null ids has none); rows that share a doc_id and repeated rows are all
    returned; extra columns are not looked at; an empty table gives an empty result.
    """
    own = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")
