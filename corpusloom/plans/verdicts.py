"""Queries over check rows, judge rows and rounds, which the tables of orders and events stand in for; their SQL says the rules again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verdict
from ..sources.tables import table

IDS = ("P1_length", "P8_opener", "O3_skeleton", "P14_dashes", "P17_lists", "O1_ngram", "P6_emoji")


def merged_verdicts(spark, sf_dir):
    """AG-18, FLT-07: the verdict on every order: its lines are checks, eight events each are judge rows, its priority a comparison."""
    # Dealt by order at once, for all that follows. The aggregates are of booleans alone, as one of strings would have all lines sorted: c is the greatest letter.
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "cid", "l_linenumber": "place"}).repartition("cid").groupBy("cid", "place")
    letter = lambda c: F.coalesce(F.bool_or(F.col("l_returnflag") == c) & ~F.bool_or(F.col("l_returnflag") > c), F.lit(False))
    check = F.element_at(F.array(*map(F.lit, IDS)), (F.col("place") % 7 + 1).cast("int"))
    class_ = F.when((check == "O3_skeleton") | letter("R"), "flag").when(letter("A"), "hard").otherwise("soft")
    checks = lines.agg(class_.alias("class"), (F.min("l_quantity") > 12).alias("pass"), (F.max("l_discount") > 0.08).alias("flag"), (F.min("l_tax") < 0.01).alias("waived"))
    checks = checks.withColumns({"check_id": check, "jury_override_allowed": F.when(F.col("place") % 7 == 4, F.col("cid") % 2 == 0)})
    events, e = table(spark, sf_dir, "events"), F.col("event_id")
    jury = F.col("user_id") % 3 > 0
    dimension = F.when(jury & (e % 5 == 0), "P8_opener").when(jury & (e % 5 == 1), "O3_skeleton").otherwise(F.col("event_type"))
    outcome = F.when(e % 11 == 0, "rejected").when(e % 11 == 1, "na").otherwise("scored")
    judged = events.select(F.expr("event_id div 8 + 1").alias("cid"), dimension.alias("dimension"), jury.alias("jury"), (F.col("user_id") % 7 == 0).alias("rerun"), e.alias("place"), outcome.alias("outcome"), (1 + e % 5).cast("int").alias("score"), (e % 13 == 0).alias("confirm"))
    kinds = events.select(F.col("event_type").alias("dimension")).distinct()
    limits = kinds.select("dimension", F.when(F.col("dimension") == "view", "hard").when(F.col("dimension") == "click", "soft").otherwise("advisory").alias("class"), F.lit(4.0).alias("threshold"), (F.col("dimension") == "click").alias("may_be_na"))
    orders = table(spark, sf_dir, "orders")
    compared = orders.select(F.col("o_orderkey").alias("cid"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("kind"), (F.col("o_totalprice") % 10 < 1).alias("fail"), F.when(F.col("o_orderkey") % 4 < 2, F.col("o_orderkey") % 4 == 0).alias("same_post"))
    found = verdict.merge(checks, judged, limits, compared)
    text = [F.array_join(c, ",").alias(c) for c in ("hard_fails", "soft_fails", "flags", "advisory", "waiting_on", "unscored")]
    return found.select("cid", "status", *text, "not_available", "splits")


def stop_reasons(spark, sf_dir):
    """2.11.3: why customers' orders stop: orders are rounds, their lines gates."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cid"), F.row_number().over(verdict.Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("round"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"))
    ids = F.element_at(F.array(*map(F.lit, IDS)), (F.col("n") % 7 + 1).cast("int"))
    fix = F.when(F.max("l_shipdate") > F.lit("1995-06-01").cast("timestamp"), "Cut the second line").otherwise("Add a line, keep it short")
    rows = lines.agg((F.col("n") % 2).alias("tier"), F.when(F.max("l_returnflag") == "N", "soft").otherwise("hard").alias("class"), F.when(F.min("l_quantity") > 15, "pass").otherwise("fail").alias("result"), (F.max("l_tax") > 0.07).alias("pending"), (F.max("l_discount") < 0.01).alias("overridden"), (F.min("l_discount") > 0.09).alias("cleared"), fix.alias("fix"))
    gates = rows.withColumns({"id": ids, "contradicts": F.lit(False)}).join(orders, "o_orderkey").drop("o_orderkey", "n")
    found = verdict.stops(gates)
    return found.select("cid", "round", "reason", "drop", F.array_join("gates", ",").alias("gates"), "revert_round")


QUERIES = {f.__name__: f for f in (merged_verdicts, stop_reasons)}

_NAME = "list_extract(['P1_length', 'P8_opener', 'O3_skeleton', 'P14_dashes', 'P17_lists', 'O1_ngram', 'P6_emoji'], ({} % 7 + 1)::int)"

ORACLES = {
    "merged_verdicts": f"""with c0 as (
    select l_orderkey as cid, l_linenumber as place, {_NAME.format("l_linenumber")} as id, max(l_returnflag) as letter, min(l_quantity) > 12 as ok, max(l_discount) > 0.08 as up, min(l_tax) < 0.01 as waived
    from lineitem group by l_orderkey, l_linenumber),
c1 as (select *, case when id = 'O3_skeleton' or letter = 'R' then 'flag' when letter = 'A' then 'hard' else 'soft' end as class from c0),
c2 as (select *, ok and up as raised, case when place % 7 = 4 then cid % 2 = 0 else true end as allowed from c1 where not ok or (class = 'flag' and up)),
j as (
    select event_id // 8 + 1 as cid, user_id % 3 > 0 as jury, user_id % 7 = 0 as rerun, event_id as place, 1 + event_id % 5 as score, event_id % 13 = 0 as confirm,
        case when user_id % 3 > 0 and event_id % 5 = 0 then 'P8_opener' when user_id % 3 > 0 and event_id % 5 = 1 then 'O3_skeleton' else event_type end as dim,
        case when event_id % 11 = 0 then 'rejected' when event_id % 11 = 1 then 'na' else 'scored' end as outcome from events),
v as (select cid, dim, count(*) as files, coalesce(list(score order by place) filter (outcome = 'scored'), []) as votes from j where jury group by cid, dim),
s as (select o_orderkey as cid, case when o_orderkey % 4 < 2 then o_orderkey % 4 = 0 end as same from orders),
c3 as (
    select c2.*, same, coalesce(files, 0) as files, coalesce(votes, [])[1:3] as votes,
        case when id = 'O3_skeleton' then same is null and class = 'flag' else id in ('P8_opener', 'P10_contrast_flip', 'P12_closer', 'P17_lists') and allowed and not raised end as jury
    from c2 left join v on v.cid = c2.cid and v.dim = c2.id left join s on s.cid = c2.cid),
c4 as (
    select *, jury and files < 3 as unmet, case when jury and files >= 3 and len(votes) > 0 and list_max(votes) - list_min(votes) >= 2 then 1 else 0 end as split,
        (jury and files >= 3 and len(votes) > 0 and list_median(votes) >= 4) or (id = 'O3_skeleton' and coalesce(not same, false)) or (waived and class in ('flag', 'soft')) as settled from c3),
t0 as (
    select cid, coalesce(list(id order by place) filter (not settled and class = 'hard'), []) as h, coalesce(list(id order by place) filter (not settled and class = 'soft'), []) as s,
        coalesce(list(id order by place) filter (not settled and class = 'flag'), []) as f, coalesce(list('jury:' || id) filter (unmet), []) as w, sum(split) as splits from c4 group by cid),
base as (select cid, coalesce(h, []) as h, coalesce(s, []) as s, coalesce(f, []) as f, coalesce(w, []) as w, coalesce(splits, 0) as splits from (select distinct l_orderkey as cid from lineitem) left join t0 using (cid)),
dims as (select distinct event_type as dim, case event_type when 'view' then 'hard' when 'click' then 'soft' else 'advisory' end as class from events),
asked as (select cid, dim, class from base, dims where len(h) = 0 or cid in (select cid from j)),
e as (
    select j.cid, j.dim, j.outcome, j.score, j.confirm, a.class, row_number() over (partition by j.cid, j.dim order by j.rerun, j.place) as k,
        j.outcome = 'scored' or (j.outcome = 'na' and a.class != 'hard') as usable from j join asked a on a.cid = j.cid and a.dim = j.dim where not j.jury),
f as (select cid, dim, min(k) filter (usable) as k, count(*) as n from e group by cid, dim),
r as (
    select a.cid, a.dim, a.class, e.outcome, case when e.outcome = 'scored' then e.score end as score, coalesce(e.confirm, false) as confirm, case when f.k is not null then f.k - 1 else coalesce(f.n, 0) end as rejected,
        coalesce(v.files, 0) as files, coalesce(v.votes, []) as votes
    from asked a left join f on f.cid = a.cid and f.dim = a.dim left join e on e.cid = a.cid and e.dim = a.dim and e.k = f.k left join v on v.cid = a.cid and v.dim = a.dim),
r1 as (select *, outcome is null and rejected >= 2 as out, outcome is null and rejected >= 2 and class = 'hard' as hold from r),
r2 as (select *, case when hold then 3 else 2 end as fresh, hold or coalesce(class in ('hard', 'soft') and score = 3, false) as triggered from r1),
r3 as (select *, triggered and files >= fresh and len(votes) > 0 as decided, case when hold then votes[1:3] else list_prepend(score, votes[1:2]) end as ballot from r2),
r4 as (select *, case when decided then list_median(ballot) else score end as mark from r3),
t1 as (
    select cid, coalesce(list(dim order by dim) filter (class = 'hard' and mark < 4), []) as h, coalesce(list(dim order by dim) filter (class = 'soft' and mark < 4), []) as s,
        coalesce(list(dim) filter ((triggered and files < fresh) or (outcome is null and rejected < 2 and class in ('hard', 'soft'))), []) as w,
        coalesce(list(dim order by dim) filter (hold and files >= fresh and not decided), []) as unscored,
        count(*) filter ((outcome = 'na' and class != 'soft') or (out and not hold)) as gone, count(*) filter (decided and list_max(ballot) - list_min(ballot) >= 2) as splits from r4 group by cid),
t2 as (select o_orderkey as cid, [lower(substr(o_orderpriority, 3, 20))] as h from orders where o_totalprice % 10 < 1),
m as (
    select b.cid, b.h as h0, b.s as s0, b.f as f0, coalesce(t1.h, []) as h1, coalesce(t1.s, []) as s1, coalesce(t2.h, []) as h2, list_sort(list_distinct(list_concat(b.w, coalesce(t1.w, [])))) as w,
        coalesce(unscored, []) as unscored, coalesce(gone, 0) as gone, b.splits + coalesce(t1.splits, 0) as splits
    from base b left join t1 on t1.cid = b.cid left join t2 on t2.cid = b.cid),
n as (select *, list_concat(list_concat(list_concat(h0, s0), list_concat(f0, h1)), list_concat(s1, h2)) as fails from m),
p as (select *, list_distinct(fails) = ['P14_dashes'] as alone from n),
q as (
    select *, list_concat(case when alone then [] else h0 end, list_concat(h1, h2)) as h, list_concat(case when alone then [] else s0 end, s1) as s, case when alone then [] else f0 end as f,
        case when alone then fails else [] end as adv from p)
select cid, case when len(w) > 0 then 'hold' when len(unscored) > 0 or gone >= 2 then 'needs_your_call' when len(h) + len(s) + len(f) = 0 then 'pass' else 'fail' end as status,
    array_to_string(h, ',') as hard_fails, array_to_string(s, ',') as soft_fails, array_to_string(f, ',') as flags, array_to_string(adv, ',') as advisory, array_to_string(w, ',') as waiting_on,
    array_to_string(unscored, ',') as unscored, gone as not_available, splits from q""",
    "stop_reasons": f"""with o as (select o_orderkey, o_custkey as cid, row_number() over (partition by o_custkey order by o_orderkey) as k from orders),
g as (
    select o.cid, o.k, l_linenumber % 2 as tier, {_NAME.format("l_linenumber")} as id, max(l_returnflag) != 'N' as hard, min(l_quantity) <= 15 as failed, max(l_tax) > 0.07 as pending, max(l_discount) < 0.01 as overridden,
        min(l_discount) > 0.09 as cleared, max(l_shipdate) > timestamp '1995-06-01' as cuts
    from lineitem join o on l_orderkey = o_orderkey group by o.cid, o.k, l_linenumber),
rounds as (select cid, k, lag(k) over (partition by cid order by k) as past from (select distinct cid, k from g)),
x as (
    select g.*, rounds.past, p.hard and not p.failed and not p.overridden as was_good, p.failed and p.cuts != g.cuts as turned
    from g join rounds on rounds.cid = g.cid and rounds.k = g.k left join g p on p.cid = g.cid and p.k = rounds.past and p.id = g.id),
y as (
    select cid, k, any_value(past) as past, coalesce(list(id order by id) filter (hard and failed and not pending and not cleared and was_good), []) as flips,
        bool_or(tier = 1 and failed and not pending and coalesce(turned, false)) as turned, coalesce(bool_or(failed and not cleared) filter (id = 'O1_ngram'), false) as ov from x group by cid, k),
z as (
    select *, sum(len(flips)) over (partition by cid order by k) as events, count(*) filter (ov) over (partition by cid order by k rows between 2 preceding and current row) = 3 as persistent from y),
w as (select *, case when events >= 2 and past is not null then 'regression' when persistent then 'overlap_persistent' when turned then 'oscillation' when len(flips) > 0 then 'spent_gate' end as reason from z)
select cid, k as round, reason, reason in ('regression', 'overlap_persistent') as "drop", case when reason = 'spent_gate' then array_to_string(flips, ',') end as gates, case when reason = 'spent_gate' then past end as revert_round
from w where reason is not null""",
}
