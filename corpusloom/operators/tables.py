"""Logs, upserts, snapshots and pools: small tables that are kept from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_normalised(rows: DataFrame, folder: str, source_sha: str) -> str:
    """SNK-01: accepted rows as JSON Lines in a folder named by the first 16 hex digits of their source's hash."""
    path = f"{folder}/{source_sha[:16]}"
    rows.write.mode("overwrite").json(path)
    return path


def append_log(rows: DataFrame, path: str) -> None:
    """SNK-03: rows appended to a JSON Lines log."""
    rows.write.mode("append").json(path)


def front_matter(meta: str = "meta", text: str = "text") -> F.Column:
    """SNK-02: the text of a front-matter document: sorted `key: value` lines between fences, the body, one line end."""
    pairs = F.array_sort(F.transform(F.map_entries(F.col(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(pairs, "\n"), F.lit("\n---\n\n"), F.rtrim(F.col(text), F.lit("\n")), F.lit("\n"))


def upsert_performance(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-04: rows of (run, cid) with a new address, date and snapshot taken in: the address if one is given, the date if none was, the snapshot at the end."""
    named = new.select("run", "cid", *(F.col(c).alias(f"new_{c}") for c in ("url", "posted_at", "snapshot")))
    joined = old.join(named, ["run", "cid"], "full_outer")
    snapshots = F.concat(F.coalesce("snapshots", F.array().cast(old.schema["snapshots"].dataType)), F.when(F.col("new_snapshot").isNull(), F.array().cast(old.schema["snapshots"].dataType)).otherwise(F.array("new_snapshot")))
    return joined.select("run", "cid", F.coalesce("new_url", "url").alias("url"), F.coalesce("posted_at", "new_posted_at").alias("posted_at"), snapshots.alias("snapshots"))


def upsert_newest(old: DataFrame, new: DataFrame, key: str, order: str, kinds: tuple[str, ...], value: str) -> DataFrame:
    """SNK-04: of each key of new, the newest row of old whose kind is among kinds gets the value; a key without one is appended."""
    newest = F.row_number().over(Window.partitionBy(key, F.col("kind").isin(*kinds)).orderBy(F.desc(order))) == 1
    marked = old.withColumn("newest", newest & F.col("kind").isin(*kinds))
    named = new.select(F.col(key).alias("new_key"), F.col(value).alias("new_value"))
    updated = marked.join(named, F.col("newest") & (F.col(key) == F.col("new_key")), "left").withColumn(value, F.coalesce("new_value", value))
    absent = new.join(marked.where("newest").select(key), key, "left_anti")
    return updated.select(old.columns).unionByName(absent, allowMissingColumns=True).select(old.columns)


def snapshot(history: DataFrame, now: DataFrame, key: str = "scope") -> DataFrame:
    """SNK-07: the history of (key, content, version) with a new version where the content differs from the newest; old versions stay."""
    newest = history.groupBy(key).agg(F.max_by("content", "version").alias("last"), F.max("version").alias("v"))
    fresh = now.join(newest, key, "left").where(~F.col("content").eqNullSafe(F.col("last")) | F.col("v").isNull())
    return history.select(key, "content", "version").unionByName(fresh.select(key, "content", (F.coalesce("v", F.lit(0)) + 1).cast(history.schema["version"].dataType).alias("version")))


def fresh_only(artefacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """FLT-09: artefacts (key, modified) that are not older than the newest of their inputs."""
    newest = inputs.groupBy("key").agg(F.max("modified").alias("newest"))
    return artefacts.join(newest, "key", "left").where("newest is null or modified >= newest").drop("newest")


def lineup_pool(posts: DataFrame, least: int = 24, per_platform: int = 6) -> DataFrame:
    """FLT-10: (platform, pool): train while the corpus is small or a platform has no held-out post, else heldout."""
    by = posts.groupBy("platform").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "heldout").alias("held"))
    total = F.sum("train").over(Window.partitionBy(F.lit(1)))
    small = (total < least) | ((F.col("train") > 0) & (F.col("train") < per_platform))
    return by.select("platform", F.when(small | (F.col("held") == 0), "train").otherwise("heldout").alias("pool"))


def voice_samples(posts: DataFrame, wanted: DataFrame, n: int = 3, least: int = 3, seed: str = "0") -> DataFrame:
    """JN-22: for each wanted (cid, platform) n posts in a seeded order, those of its platform first: own ones if there are enough, else train ones.

    Only the first n posts of each platform and the first 2n of all are looked at, which is all that n places can take.
    """
    own = posts.agg((F.count_if(F.col("split") == "self") >= least).alias("enough"))
    pool = posts.join(F.broadcast(own), F.col("split") == F.when(F.col("enough"), "self").otherwise("train"))
    pool = pool.select(F.sha2(F.concat_ws("|", F.lit(seed), F.col("post_id").cast("string")), 256).alias("order"), F.col("post_id").alias("sample"), F.col("platform").alias("of"))
    place = F.row_number().over(Window.partitionBy("of").orderBy("order"))
    near = pool.withColumn("k", place).where(F.col("k") <= n).groupBy("of").agg(F.collect_list(F.struct("order", "sample", "of")).alias("near"))
    every = pool.orderBy("order").limit(2 * n).agg(F.collect_list(F.struct("order", "sample", "of")).alias("every"))
    met = wanted.join(near, F.col("platform") == F.col("of"), "left").drop("of").crossJoin(F.broadcast(every))  # one row
    rank = lambda x: F.struct((x["of"] != F.col("platform")).alias("far"), x["order"].alias("order"), x["sample"].alias("sample"))
    chosen = F.slice(F.array_sort(F.array_distinct(F.transform(F.concat(F.coalesce("near", F.slice("every", 1, 0)), F.col("every")), rank))), 1, n)
    return met.select("cid", F.posexplode(chosen).alias("at", "x")).select("cid", F.col("x.sample").alias("sample"), (F.col("at") + 1).alias("k"))


def reinforce(old: DataFrame, new: DataFrame) -> DataFrame:
    """ST-04: lessons (lesson, count, evidence, date, retired) with new support: counts add, evidence is united, a retired lesson comes back."""
    named = new.select("lesson", F.col("count").alias("more"), F.col("evidence").alias("also"), F.col("date").alias("on"))
    empty = F.array().cast(old.schema["evidence"].dataType)
    joined = old.join(named, "lesson", "full_outer")
    return joined.select("lesson", (F.coalesce("count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("count"), F.array_sort(F.array_union(F.coalesce("evidence", empty), F.coalesce("also", empty))).alias("evidence"), F.greatest("date", "on").alias("date"), F.when(F.col("more").isNull(), F.col("retired")).alias("retired"))


def retire(lessons: DataFrame, today: str, days: int = 90) -> DataFrame:
    """ST-04: lessons not supported for so many days are retired."""
    old = F.col("date") < F.date_sub(F.lit(today).cast("date"), days)
    return lessons.withColumn("retired", F.when(F.col("retired").isNull() & old, F.lit(today).cast("date")).otherwise(F.col("retired")))
