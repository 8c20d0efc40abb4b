"""Exact quantiles of groups of any size: a sketch bounds each quantile, and only what lies between the bounds is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 4 / ACCURACY  # of the rank; the sketch is right to 1 / ACCURACY


def exact_quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...], *others: Column) -> DataFrame:
    """(group, quantiles: array of double, others...): quantiles by interpolation as percentile() has them, null for no values.

    One pass counts and bounds, a second counts what is below each bound and gathers the values inside, equal ones as one. A rank outside its bounds is an error.
    """
    edges = [min(1.0, max(0.0, q + s * MARGIN)) for q in at for s in (-1, 1)]
    x = F.col(value).cast("double")
    bounds = df.groupBy(group).agg(F.count(value).alias("n"), F.percentile_approx(x, F.array(*map(F.lit, edges)), ACCURACY).alias("edges"), *others)
    rows = df.select(F.col(group).alias("_g"), x.alias("x")).where("x is not null").join(F.broadcast(bounds.select(group, "edges")), F.col("_g").eqNullSafe(F.col(group)))
    low, high = (lambda k: F.col("edges")[2 * k]), (lambda k: F.col("edges")[2 * k + 1])
    below = rows.groupBy("_g").agg(F.array(*(F.count_if(F.col("x") < low(k)) for k in range(len(at)))).alias("below"))
    inside = F.filter(F.array(*(F.when((F.col("x") >= low(k)) & (F.col("x") <= high(k)), F.lit(k)) for k in range(len(at)))), lambda k: k.isNotNull())
    counted = rows.select("_g", "x", F.explode(inside).alias("k")).groupBy("_g", "k", "x").count()
    upto = F.sum("count").over(Window.partitionBy("_g", "k").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("upto", upto).withColumnRenamed("_g", "_g1")
    sizes = bounds.select(F.col(group).alias("_g2"), "n")
    place = (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, at)), F.col("k") + 1)
    joined = ranked.join(F.broadcast(below), F.col("_g1").eqNullSafe(F.col("_g"))).join(F.broadcast(sizes), F.col("_g1").eqNullSafe(F.col("_g2"))).withColumns({"place": place, "upto": F.col("upto") + F.col("below")[F.col("k")]})
    first = lambda rank: F.min(F.when(F.col("upto") > rank(F.col("place")), F.col("x")))
    found = joined.groupBy("_g1", "k").agg(F.first("place").alias("place"), first(F.floor).alias("one"), first(F.ceil).alias("two"), F.max(F.col("below")[F.col("k")]).alias("under"))
    part = F.col("place") - F.floor("place")
    missed = F.col("one").isNull() | F.col("two").isNull() | (F.col("under") > F.floor("place"))
    exact = F.when(missed, F.raise_error(F.lit("a quantile lies outside its bounds"))).when(F.col("one") == F.col("two"), F.col("one")).otherwise((F.ceil("place") - F.col("place")) * F.col("one") + part * F.col("two"))
    lists = found.groupBy("_g1").agg(F.map_from_entries(F.collect_list(F.struct("k", exact.alias("q")))).alias("found"))
    kept = [c for c in bounds.columns if c not in (group, "n", "edges")]
    return bounds.join(F.broadcast(lists), F.col(group).eqNullSafe(F.col("_g1")), "left").select(group, F.array(*(F.col("found")[F.lit(k)] for k in range(len(at)))).alias("quantiles"), *kept)
