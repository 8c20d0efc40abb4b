"""Closures of links by pointer jumping: rounds grow with the logarithm of the longest chain, and every round is a few joins of written tables.

Both sides of a join grow with the links and there are joins in every round, so they are merged: none is sent to all tasks by way of the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import dropped, kept


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by way of no driver."""
    return df.hint("merge")


def one_link(links: DataFrame) -> DataFrame:
    """(id, next) with one link for each id, the least; links without an end are left out."""
    return links.where("id is not null and next is not null").groupBy("id").agg(F.min("next").alias("next"))


def _first(links: DataFrame) -> DataFrame:
    """(id, at, depth, done) of every id and end: done where at has no link onward."""
    ours = one_link(links)
    ends = ours.select(F.col("next").alias("end")).distinct()
    last = ends.join(merged(ours.select(F.col("id").alias("end"))), "end", "left_anti")
    moved = ours.join(merged(last.withColumn("stops", F.lit(True))), F.col("next") == F.col("end"), "left")
    rows = moved.select("id", F.col("next").alias("at"), F.lit(1).cast("long").alias("depth"), F.coalesce("stops", F.lit(False)).alias("done"))
    return rows.unionByName(last.select(F.col("end").alias("id"), F.col("end").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("done")))


def follow(links: DataFrame) -> DataFrame:
    """JN-18, JN-23, WN-13, SRC-10: (id, root, depth, cyclic) of every id and end of links (id, next).

    root is where the chain of links ends, depth how many links it takes. An id on a circle of links, or whose chain leads into one, is cyclic and has no
    root. Of several links of one id the least counts. In each round a pointer takes the place of its target's pointer, so a chain of n links takes log2(n)
    rounds; pointers that jumped as far as there are links and still have no end are cyclic. What has its end is not joined again as a source.
    """
    now = kept(_first(links), "follow")
    most, reach = now.count(), 1
    while True:
        open_ = now.where("not done")
        if reach > most or not open_.limit(1).count():
            break
        target = now.select(F.col("id").alias("there"), F.col("at").alias("onward"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        moved = open_.join(merged(target), F.col("at") == F.col("there")).select("id", F.col("onward").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done"))
        last, now = now, kept(now.where("done").unionByName(moved), "follow")
        dropped(last)
        reach *= 2
    return now.select("id", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), (~F.col("done")).alias("cyclic"))


def chains(links: DataFrame, starts: DataFrame) -> DataFrame:
    """JN-23: (start, id, place) of every id on the chain of each start, the start at 0; an id that a circle comes back to is there once, at its first place."""
    now = kept(one_link(links), "jumps")
    rows = kept(starts.select(F.col("id").alias("start")).distinct().select("start", F.col("start").alias("id"), F.lit(0).cast("long").alias("place")), "chains")
    most, reach = now.count(), 1
    while now.limit(1).count():
        step = rows.join(merged(now), "id").select("start", F.col("next").alias("id"), (F.col("place") + reach).alias("place"))
        last, rows = rows, kept(rows.unionByName(step).groupBy("start", "id").agg(F.min("place").alias("place")), "chains")
        jump = now.alias("a").join(merged(now.alias("b")), F.col("a.next") == F.col("b.id")).select("a.id", "b.next")
        before, now, reach = now, kept(jump, "jumps"), reach * 2
        dropped(last, before)
        if reach > most:
            break
    dropped(now)
    return rows


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of links (id, next) in both directions, component being the least id reachable.

    Every round each node takes the least grandparent among its neighbours and its own, and hands it to its parent too; minima are combined before they are
    shuffled, so a node with very many links gathers none. The rounds end when one changes nothing.
    """
    ours = links.where("id is not null and next is not null").select("id", "next")
    edges = kept(ours.unionByName(ours.select(F.col("next").alias("id"), F.col("id").alias("next"))).distinct(), "edges")
    now = kept(edges.select("id").distinct().select("id", F.col("id").alias("f")), "components")
    while True:
        grand = kept(now.alias("a").join(merged(now.alias("b")), F.col("a.f") == F.col("b.id")).select("a.id", "a.f", F.col("b.f").alias("g")), "grand")
        least = edges.join(merged(grand.select(F.col("id").alias("next"), "g")), "next").groupBy("id").agg(F.min("g").alias("m"))
        met = grand.join(merged(least), "id")
        offers = met.select("id", F.least("f", "g", "m").alias("f")).unionByName(met.select(F.col("f").alias("id"), F.col("m").alias("f")))
        new = kept(offers.groupBy("id").agg(F.min("f").alias("f")), "components")
        changed = new.join(merged(now), ["id", "f"], "left_anti").limit(1).count()
        dropped(now, grand)
        now = new
        if not changed:
            break
    dropped(edges)
    return now.withColumnRenamed("f", "component")


def excluded(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """JN-11: (id) of the seeds and all that links join to one of them, over any number of links in both directions. Null seeds are none."""
    seeds = seeds.select("id").where("id is not null").distinct()
    found = components(links)
    hit = found.join(merged(seeds), "id", "left_semi").select("component").distinct()
    return found.join(merged(hit), "component", "left_semi").select("id").unionByName(seeds).distinct()
