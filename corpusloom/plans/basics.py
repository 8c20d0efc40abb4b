"""Corpus counts, splits and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: train and held-out documents by content hash, and repeats of an earlier text."""
    docs = table(spark, sf_dir, "documents")
    hashed = docs.select("doc_id", "lang", T.content_sha(T.ascii_norm("text")).alias("sha"))
    ranked = hashed.withColumn("copy", F.row_number().over(Window.partitionBy("sha").orderBy("doc_id")) > 1)
    return ranked.groupBy("lang", T.is_heldout("sha").alias("heldout")).agg(F.count("*").alias("n"), F.count_if("copy").alias("copies"))


QUERIES = {"split_counts": split_counts}

_SHA = "sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))"

ORACLES = {
    "split_counts": f"""
with h as (select doc_id, lang, {_SHA} as sha from documents),
r as (select *, row_number() over (partition by sha order by doc_id) > 1 as copy from h)
select lang, ('0x' || substr(sha, 1, 8))::bigint % 4 = 0 as heldout, count(*) as n, count(*) filter (copy) as copies
from r group by 1, 2""",
}
