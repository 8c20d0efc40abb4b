"""Fillers of a length near a post's: the best of each author in ranges of lengths, by cells of a power of two, so no post meets all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BANDS = (0.3, 0.5)
AUTHORS, MOST = 3, 4
LEVELS = 31
HELD = 3  # of an author in a cell: two are used at most, and one may be the post itself


def _best(rows: DataFrame, *key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key, "author").orderBy("jitter", "filler"))
    return rows.withColumn("place", place).where(F.col("place") <= HELD).select(*key, "author", "jitter", "filler")


def fillers(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    """TK-03: (id, filler, k): up to four posts (id, lang, author, n_chars) of the language of each wanted one, from the narrowest band of lengths that has three authors: first one of each author, by the hash of the id, then their second ones.

    ids are unique. With three authors or more no author gives a third post.
    """
    ours = posts.where("lang is not null and id is not null").select("lang", "author", F.col("n_chars").cast("long").alias("n_chars"), F.col("id").alias("filler"), F.sha2(F.col("id").cast("string"), 256).alias("jitter"))
    single = _best(ours, "lang", "n_chars")
    cells = single.where("n_chars is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("cell", F.expr("shiftright(n_chars, level)"))
    cells = _best(cells, "lang", "level", "cell")
    sought = wanted.where("lang is not null").select("lang", F.col("n_chars").cast("long").alias("n"))
    ranges = None
    for band, share in enumerate(BANDS, 1):
        reach = F.floor(F.lit(share) * F.col("n")).cast("long")
        one = sought.where("n >= 0").distinct().select("lang", "n", F.lit(band).alias("band"), (F.col("n") - reach).alias("low"), (F.col("n") + reach + 1).alias("high"))
        ranges = one if ranges is None else ranges.unionByName(one)
    # The cells of a power of two that make up the range from low to before high: at most two of a level.
    ranges = ranges.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumns({"low": F.expr("shiftright(low + shiftleft(1L, level) - 1, level)"), "high": F.expr("shiftright(high, level)")}).where("low < high")
    ends = F.filter(F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)), lambda c: c.isNotNull())
    near = ranges.select("lang", "n", "band", "level", F.explode(ends).alias("cell")).join(cells, ["lang", "level", "cell"])
    near = _best(near, "lang", "n", "band")
    targets = wanted.where("lang is not null").select("id", "lang", F.col("n_chars").cast("long").alias("n"))
    other = F.col("filler") != F.col("id")
    met = targets.join(near, ["lang", "n"]).where(other).select("id", "band", "author", "jitter", "filler")
    whole = targets.join(_best(single, "lang"), "lang").where(other).select("id", F.lit(len(BANDS) + 1).alias("band"), "author", "jitter", "filler")
    met = met.unionByName(whole)
    bands = met.groupBy("id", "band").agg(F.count_distinct("author").alias("authors")).where(F.col("authors") >= AUTHORS).groupBy("id").agg(F.min("band").alias("band"))
    own = F.row_number().over(Window.partitionBy("id", "author").orderBy("jitter", "filler"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("own", "jitter"))
    return met.join(bands, ["id", "band"]).withColumn("own", own).withColumn("k", k).where(F.col("k") <= MOST).select("id", "filler", "k")
