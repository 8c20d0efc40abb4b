"""Queries over chains of links, with SQL that walks them one link after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure
from ..sources.tables import table


def exclusion_closure(spark, sf_dir):
    """JN-11: parts that are linked, in either direction, to a part of size 1."""
    part = table(spark, sf_dir, "part")
    links = part.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("next"))
    out = closure.excluded(part.where("p_size = 1").select(F.col("p_partkey").alias("id")), links)
    return part.select(F.col("p_partkey").alias("id")).join(closure.merged(out.withColumn("excluded", F.lit(True))), "id", "left").select("id", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def aliases(spark, sf_dir):
    """JN-18: customers merged into the one before, some in a circle, with the one that is left."""
    key = F.col("c_custkey")
    merged = F.when(key % 100 == 21, key + 2).when(key % 4 != 0, key - 1)
    found = closure.follow(table(spark, sf_dir, "customer").select(key.alias("id"), merged.alias("next")))
    return found.where("not cyclic").select("id", F.col("root").alias("canonical"), "depth")


def rewrite_chain(spark, sf_dir):
    """JN-23: every turn with the first one of its chain of rewrites (the turn two before of the same role), how many lie between, and what takes its place."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("id"))
    before = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), "role", F.col("id").alias("next"))
    links = turns.join(closure.merged(before), ["conv_id", "turn", "role"], "left").select("id", "next")
    found = closure.follow(links).select("id", F.col("root.turn").alias("first_turn"), "depth")
    after = links.where("next is not null").select(F.col("next").alias("id"), F.col("id.turn").alias("superseded_by"))
    rest = turns.join(closure.merged(found), "id", "left").join(closure.merged(after), "id", "left")
    return rest.select("conv_id", "turn", "role", F.coalesce("first_turn", "turn").alias("first_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "superseded_by")


QUERIES = {f.__name__: f for f in (exclusion_closure, aliases, rewrite_chain)}

ORACLES = {
    "exclusion_closure": """with recursive links as (select p_partkey as a, p_partkey // 3 as b from part where p_partkey % 5 != 0),
up as (select p_partkey as id, p_partkey as node from part union all select u.id, l.b from up u join links l on u.node = l.a),
roots as (select id, min(node) as root from up group by id)
select r.id, r.root in (select r2.root from roots r2 join part p on p.p_partkey = r2.id where p.p_size = 1) as excluded from roots r""",
    "aliases": """with recursive e as (select c_custkey as id, case when c_custkey % 100 = 21 then c_custkey + 2 when c_custkey % 4 != 0 then c_custkey - 1 end as next from customer),
n as (select id from e where next is not null union select next from e where next is not null),
w as (
    select id, id as node, 0 as depth from n
    union all
    select w.id, e.next, w.depth + 1 from w join e on w.node = e.id where e.next is not null and w.depth < 10)
select w.id, w.node as canonical, w.depth::bigint as depth from w left join e on w.node = e.id where e.next is null""",
    "rewrite_chain": """with recursive l as (
    select a.conv_id, a.turn, a.role, b.turn as before, c.turn as after from conversations a
    left join conversations b on a.conv_id = b.conv_id and a.role = b.role and b.turn = a.turn - 2
    left join conversations c on a.conv_id = c.conv_id and a.role = c.role and c.turn = a.turn + 2),
w as (
    select conv_id, turn, turn as node, 0 as depth from l
    union all
    select w.conv_id, w.turn, l.before, w.depth + 1 from w join l on w.conv_id = l.conv_id and w.node = l.turn where l.before is not null)
select l.conv_id, l.turn, l.role, w.node as first_turn, w.depth::bigint as depth, l.after as superseded_by
from l join (select conv_id, turn, min(node) as node, max(depth) as depth from w group by conv_id, turn) w on l.conv_id = w.conv_id and l.turn = w.turn""",
}
