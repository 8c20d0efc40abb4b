"""SNK-06: features of posts in a Parquet table that grows by what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import exists

KEY = ("post_id", "content_sha")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, path):
        return None
    # names of folders are read as text
    return spark.read.parquet(path).withColumns({"failed": F.col("failed").cast("boolean"), "batch": F.col("batch").cast("long")})


def with_key(posts: DataFrame, text: str = "text") -> DataFrame:
    return posts.withColumn("content_sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def update_features(posts: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], problem: Column | None = None, splits: tuple[str, ...] = ("train", "self", "heldout"), retry: bool = False) -> DataFrame:
    """Write the features of the posts (post_id, split, text) that the table at path has not got for their text; gives this run's (post_id, content_sha, failed, reason).

    compute adds columns to posts (one row each); problem is a reason, over compute's columns, for a row to be put aside: it is kept in the same table
    under failed, so that it isn't worked out again before its text changes, or with retry is. Only rows whose (post_id, content_sha) is new are computed: an
    anti-join on the two keys comes first, which reads no features. A post's older rows stay; current_features() gives the newest text's. Null ids are left
    out; of rows with the same id and text one is written.
    """
    spark = posts.sparkSession
    ours = with_key(posts.where(F.col("post_id").isNotNull() & F.col("split").isin(*splits))).dropDuplicates(list(KEY))
    have = stored(spark, path)
    if have is not None:
        ours = ours.join((have.where("not failed") if retry else have).select(*KEY).distinct(), list(KEY), "left_anti")
    reason = F.lit(None).cast("string") if problem is None else problem
    batch = (have.agg(F.max("batch")).first()[0] if have is not None else 0) + 1
    rows = compute(ours).withColumn("reason", reason).withColumns({"failed": F.col("reason").isNotNull(), "batch": F.lit(batch).cast("long")})
    rows.drop("text").write.mode("append").partitionBy("batch", "failed").parquet(path)
    now = stored(spark, path)
    return now.where(F.col("batch") == batch).select(*KEY, "failed", "reason")


def current_features(posts: DataFrame, path: str) -> DataFrame:
    """The stored features of the posts as their texts are now, the last batch's; failed rows and posts that were never computed are absent."""
    have = stored(posts.sparkSession, path)
    if have is None:
        raise ValueError(f"no features at {path}")
    keys = with_key(posts).select(*KEY).distinct()
    good = have.where("not failed").join(keys, list(KEY), "left_semi")
    last = good.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return good.join(last, [*KEY, "batch"], "left_semi").drop("failed", "reason")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, content_sha, reason, batch) of the rows put aside that no later batch has mended."""
    have = stored(spark, path)
    return have.where("failed").join(have.where("not failed").select(*KEY), list(KEY), "left_anti").select(*KEY, "reason", "batch")
