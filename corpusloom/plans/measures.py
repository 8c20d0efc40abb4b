"""Aggregations, windows and rankings (AG, WN, TK operators) on rows derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fillers as filling
from ..operators import quantiles as exact
from ..sources.tables import table
from .dialect import both

POSTS = "posts as (select doc_id as id, source as author, lang, case when n_chars <= 280 then 'x' else 'linkedin' end as platform, n_chars, text, @sha(text) as sha, case when doc_id % 10 = 0 then 'self' when doc_id % 4 = 0 then 'heldout' else 'train' end as split, @size(@words(text)) as n_words from documents where text is not null)"
# Judge rows: a run, round, candidate, dimension, lens and whole score from each event.
JUDGED = "judged as (select user_id as run, event_id % 20 as cid, 1 + event_id % 3 as round, event_type as dimension, @idiv(event_id, 7) % 3 as lens, 1 + @big(floor(abs(value) * 100)) % 5 as score, event_id from events where value is not null)"
# Calibration rows: a rating, a verdict, tags and a rubric version from each label.
RATED = "rated as (select l.doc_id as id, 1 + (l.doc_id * 7 + l.quality * 3) % 5 as user_score, case when l.quality = 1 then 'pass' when l.doc_id % 5 = 0 then 'hold' else 'fail' end as verdict, l.quality, l.toxic, case when l.toxic = 1 then 'harsh' when l.doc_id % 3 = 0 then 'dull' else 'fine' end as tag, 1 + l.doc_id % 4 as version, 1 + (l.doc_id * 13) % 5 as dim_score, d.source, d.lang from labels l join documents d on l.doc_id = d.doc_id)"
# Performance: snapshots of each order from its lines.
SNAPS = "snaps as (select l_orderkey as id, l_shipdate as day, l_linenumber as hours, @big(l_quantity * 10) as views, @big(l_quantity) % 7 as comments from lineitem)"

PLANS = {
    # AG-01, AG-02: statistics of features over overlapping scopes (corpus, self, platform, author).
    "scope_stats": f"""with {POSTS},
s as (select id, @real(n_chars) as n_chars, @real(n_words) as n_words, @list('corpus', case when split = 'self' then 'self' end, 'platform:' || platform, case when split != 'self' then 'author:' || author end) as scopes from posts),
e as (select id, scope, n_chars, n_words from s @explode(scopes, scope) where scope is not null),
f as (select scope, 'n_chars' as path, n_chars as v from e union all select scope, 'n_words', n_words from e)
select scope, path, count(v) as n, round(@quantile(v, 0.5), 4) as median, round(@quantile(v, 0.25), 4) as q1, round(@quantile(v, 0.75), 4) as q3, min(v) as lowest, max(v) as highest from f group by scope, path having count(v) >= 6""",
    # AG-01, FN-12: distance of each vector to the centroid of its label, and the greatest of each.
    "centroid_distance": """with e as (select label, pos, @real(v) as v from (select label, i as pos, @at(embedding, i) as v from embeddings @explode(@steps(1, 64), i)) q),
c as (select label, pos, avg(v) as m from e group by label, pos),
n as (select x.vec_id, x.label, i as pos, @real(@at(x.embedding, i)) as v from embeddings x @explode(@steps(1, 64), i)),
d as (select n.vec_id, n.label, sum(n.v * c.m) / (sqrt(sum(n.v * n.v)) * sqrt(sum(c.m * c.m))) as cosine from n join c on n.label = c.label and n.pos = c.pos group by n.vec_id, n.label)
select label, count(*) as n, round(max(1 - cosine), 6) as furthest, round(avg(1 - cosine), 6) as mean from d group by label""",
    # AG-03: how often checks fail on the corpus.
    "base_rates": """select lang, count(*) as n, round(avg(case when @hit(text, '[\\u2013\\u2014]') then 1.0 else 0.0 end), 6) as dashes, round(avg(case when @count_hits(text, '!') > 2 then 1.0 else 0.0 end), 6) as shouts, round(avg(case when @hit(text, '#[A-Za-z]') then 1.0 else 0.0 end), 6) as hashtags, round(avg(case when @size(@words(text)) < 8 then 1.0 else 0.0 end), 6) as min_words from documents group by lang""".replace("\\u2013", "–").replace("\\u2014", "—"),
    # AG-04: counts by split, platform and both.
    "corpus_counts": f"with {POSTS} select coalesce(split, 'all') as split, coalesce(platform, 'all') as platform, count(*) as n from posts group by cube (split, platform)",
    # AG-05: is the corpus small, as a whole or for a platform.
    "small_corpus": f"with {POSTS}, n as (select platform, count(*) as n from posts where split = 'train' group by platform) select sum(n) as n_train, sum(n) < 24 or count_if(n > 0 and n < 6) > 0 as small from n",
    # AG-06: one fingerprint of the corpus, from its content hashes.
    "corpus_hash": f"with {POSTS} select split, @sha(@join(@gather(sha), chr(10))) as corpus_sha from posts group by split",
    # AG-07: scoreboard of tags by mean rating.
    "scoreboard": f"with {RATED} select tag, source, round(avg(user_score), 2) as mean, count(*) as n, max(id) as latest from rated group by tag, source",
    # AG-08, WN-06, JN-16: the latest snapshot of each row, then groups of three or more with their best.
    "engagement": f"""with {SNAPS}, l as (select id, views, comments from (select *, row_number() over (partition by id order by day desc, hours desc, views desc, comments desc) as k from snaps) q where k = 1),
p as (select o_orderpriority as grp, o.o_orderkey as id, l.views, l.comments from orders o left join l on o.o_orderkey = l.id)
select grp, count(*) as n, round(avg(views), 6) as views, round(avg(comments), 6) as comments, max_by(id, coalesce(views, -1) * 1000000000 + id) as best from p group by grp having count(views) >= 3""",
    # AG-09: Cohen's kappa of ratings of four and more against a passing verdict, withheld on few rows.
    "kappa": f"""with {RATED}, t as (select count_if(user_score >= 4 and verdict = 'pass') as a, count_if(user_score >= 4 and verdict != 'pass') as b, count_if(user_score < 4 and verdict = 'pass') as c, count_if(user_score < 4 and verdict != 'pass') as d from rated),
k as (select *, @real(a + b + c + d) as n, @real(a + d) / (a + b + c + d) as po, (@real(a + b) * (a + c) + @real(c + d) * (b + d)) / (@real(a + b + c + d) * (a + b + c + d)) as pe from t)
select @big(n) as n, b + d as system_fails, case when n >= 30 and b + d >= 8 and pe < 0.999999 then round((po - pe) / (1 - pe), 4) end as kappa from k""",
    # AG-10: Spearman's rho with average ranks, null where a side does not vary.
    "spearman": f"""with {RATED}, r as (select source, @real(rank() over (partition by source order by user_score)) + (count(*) over (partition by source, user_score) - 1) / 2.0 as rx, @real(rank() over (partition by source order by dim_score)) + (count(*) over (partition by source, dim_score) - 1) / 2.0 as ry from rated),
m as (select source, count(*) as n, avg(rx) as mx, avg(ry) as my, avg(rx * ry) as mxy, avg(rx * rx) as mxx, avg(ry * ry) as myy from r group by source)
select source, n, case when n >= 3 and mxx - mx * mx > 1e-9 and myy - my * my > 1e-9 then round((mxy - mx * my) / sqrt((mxx - mx * mx) * (myy - my * my)), 6) end as rho from m""",
    # AG-11: per tag, how often the system missed what the rater saw; rows without evidence are not counted.
    "tag_misses": f"""with {RATED}, e as (select tag, case when verdict = 'hold' then null else verdict = 'fail' end as flagged from rated)
select tag, count(flagged) as evaluable, count_if(not flagged) as misses, round(@real(count_if(not flagged)) / count(flagged), 3) as rate from e group by tag having count(flagged) > 0""",
    # AG-12: tags on three rated rows or more.
    "tag_clusters": f"with {RATED} select tag, lang, count(*) as n, @gather(id) as refs, count(distinct source) as runs from rated group by tag, lang having count(*) >= 3",
    # AG-13: votes on thresholds; both ways means the anchors need words.
    "threshold_proposals": f"""with {RATED}, v as (select version as dimension, case when user_score >= 4 and dim_score < 3 then -1 when user_score <= 2 and dim_score >= 4 then 1 end as vote from rated)
select dimension, count_if(vote = 1) as up, count_if(vote = -1) as down, case when count_if(vote = 1) >= 2 and count_if(vote = -1) >= 2 then 'anchor_text' when count_if(vote = 1) >= 3 then 'raise' when count_if(vote = -1) >= 3 then 'lower' end as proposal from v group by dimension""",
    # AG-14: groups far from the overall mean, over three keys.
    "performance_proposals": """with p as (select 'priority' as key, o_orderpriority as value, o_totalprice as y from orders union all select 'status', o_orderstatus, o_totalprice from orders union all select 'month', substring(@text(o_orderdate), 1, 7), o_totalprice from orders),
m as (select avg(o_totalprice) as mean, count(*) as n from orders)
select key, value, round(avg(y), 4) as mean, case when avg(y) >= 1.5 * max(m.mean) then 'prefer' when avg(y) <= 0.5 * max(m.mean) then 'avoid' else 'keep' end as proposal from p cross join m where m.n >= 20 group by key, value""",
    # AG-15: median and split of up to three votes in file order.
    "jury": f"""with {JUDGED}, r as (select *, row_number() over (partition by run, cid, dimension order by event_id) as k from judged)
select run, cid, dimension, count(*) as votes, @quantile(@real(score), 0.5) as median, max(score) - min(score) as split, @quantile(@real(score), 0.5) >= 3 as pass from r where k <= 3 group by run, cid, dimension""",
    # AG-16: picks of the candidate in a line-up.
    "lineup": f"""with {JUDGED} select run, cid, count(*) as judges, count_if(score = 1 and lens >= 1) as strong, case when count_if(score = 1 and lens >= 1) >= 2 or (count(*) >= 3 and count_if(score = 1) = count(*)) then 'fail' when count(*) = 1 and count_if(score = 1) = 1 then 'flag' else 'pass' end as result from judged group by run, cid""",
    # AG-17: both orders must agree for a win.
    "pairwise": f"""with {JUDGED}, o as (select run, cid, lens, max(case when round = 1 then case when score >= 3 then 1 else 0 end end) as ab, max(case when round = 2 then case when score >= 3 then 1 else 0 end end) as ba from judged group by run, cid, lens),
t as (select *, case when ab is null or ba is null then 'none' when ab = 1 and ba = 1 then 'win' when ab = 0 and ba = 0 then 'loss' else 'tie' end as outcome from o)
select run, cid, count_if(outcome = 'win') as wins, count_if(outcome = 'tie') as ties, count_if(outcome = 'loss') as losses, count_if(outcome in ('win', 'tie')) > 0 as pass from t group by run, cid""",
    # AG-18 (part), FLT-03: the verdict of every candidate's newest round, by precedence.
    "verdicts": f"""with {JUDGED}, m as (select run, cid, round, dimension, @quantile(@real(score), 0.5) as score, count(*) as n from judged group by run, cid, round, dimension),
v as (select run, cid, round, count_if(score < 2) as hard, count_if(score >= 2 and score < 3) as soft, count_if(n = 1) as na, @gather(case when score < 3 then dimension end) as failing from m group by run, cid, round),
r as (select *, row_number() over (partition by run, cid order by round desc) as k from v)
select run, cid, round, hard, soft, na, case when na >= 4 then 'hold' when na >= 2 and hard = 0 then 'needs_your_call' when hard = 0 and soft = 0 then 'pass' else 'fail' end as status from r where k = 1""".replace(", @gather(case when score < 3 then dimension end) as failing", ""),
    # AG-19, AG-20: flags, and clusters of rule hits over tiers.
    "rule_clusters": """with h as (select doc_id, @count_hits(lower(text), '\\\\b(delve|tapestry|landscape|the)\\\\b') as t1, @count_hits(lower(text), '\\\\b(moreover|furthermore|of)\\\\b') as t2, @count_hits(lower(text), '\\\\b(leverage|robust|and)\\\\b') as t3 from documents where text is not null)
select doc_id, t1, t2, t3, t1 >= 3 or t1 + t2 + t3 >= 5 as fails from h""",
    # AG-21, AG-22: gates of a health run.
    "health_gates": f"""with {RATED}, a as (select source, count(*) as n, avg(case when verdict = 'pass' then 1.0 else 0.0 end) as pass_rate, avg(case when dim_score = 1 then 1.0 else 0.0 end) as pick_rate, count_if(verdict = 'fail') as fails from rated group by source)
select source, n, round(pass_rate, 6) as pass_rate, pass_rate >= 0.9 or (n < 10 and fails <= 1) as oracle_ok, pick_rate between 0.10 and 0.45 as lineup_ok from a""",
    # AG-23: authors recognised by two of three lenses.
    "recognition": f"with {JUDGED} select cid, count(distinct case when score = 5 then lens end) as lenses, count(distinct case when score = 5 then lens end) >= 2 as retired from judged group by cid",
    # AG-24: one read of the prompt and nothing blocked in each call.
    "judge_sanity": "select user_id as call_id, count_if(event_type = 'view') as reads, count_if(value > 90) as blocked, count_if(event_type = 'view') = 1 and count_if(value > 90) = 0 as ok from events group by user_id",
    # AG-25: calls and span of a run.
    "run_span": "select user_id as run, count(*) as calls, max(@seconds(ts)) - min(@seconds(ts)) as wall_s from events group by user_id",
    # AG-26: dashboard of what is late.
    "dashboard": "select o_orderstatus as status, count(*) as n, count_if(@days(date '1998-08-02', o_orderdate) > 700) as late, max(@days(date '1998-08-02', o_orderdate)) as oldest from orders group by o_orderstatus",
    # AG-27: quantiles and means with zero for nothing.
    "quantiles": "select l_returnflag as flag, @quantile(l_extendedprice, 0.25) as q1, @quantile(l_extendedprice, 0.5) as median, @quantile(l_extendedprice, 0.75) as q3, coalesce(round(avg(l_discount), 6), 0) as mean from lineitem group by l_returnflag",
    # WN-01, WN-02: medians by version, and how far they moved.
    "drift": f"""with {RATED}, m as (select lang, version, @quantile(@real(dim_score), 0.5) as median from rated group by lang, version)
select lang, version, median, median - lag(median) over (partition by lang order by version) as delta, abs(median - lag(median) over (partition by lang order by version)) >= 1.0 as red from m""",
    # WN-03: streaks of flagged rounds by gaps and islands.
    "streaks": """with f as (select user_id as run, event_id as round, value > 50 as flag from events where value is not null), g as (select *, sum(case when flag then 0 else 1 end) over (partition by run order by round rows between unbounded preceding and current row) as island from f)
select run, max(streak) as longest, count_if(streak = 3) as stops from (select run, count_if(flag) over (partition by run, island order by round rows between unbounded preceding and current row) as streak from g) q group by run""",
    # WN-04: passes that turned into failures.
    "regressions": f"""with {JUDGED}, r as (select run, cid, round, min(score) >= 2 as pass from judged group by run, cid, round), e as (select *, coalesce(lag(pass) over (partition by run, cid order by round) and not pass, false) as event from r)
select run, cid, count_if(event) as events, min(case when event then round end) as spent_gate, count_if(event) >= 2 as dropped from e group by run, cid""",
    # WN-05: the same dimension fails in two rounds in a row and the fixes pull apart.
    "oscillation": f"""with {JUDGED}, r as (select run, cid, dimension, round, min(score) as score, max(lens) as fix from judged group by run, cid, dimension, round), l as (select *, lag(score) over (partition by run, cid, dimension order by round) as before, lag(fix) over (partition by run, cid, dimension order by round) as fix_before from r)
select run, cid, count(*) as n from l where score < 3 and before < 3 and fix != fix_before group by run, cid""",
    # WN-08: longest run of one-line paragraphs, folded.
    "paragraph_runs": """with p as (select doc_id, @keep(@split(text, '\\\\n\\\\n+'), trim(_x) != '') as parts from documents where text is not null),
s as (select doc_id, @size(parts) as paragraphs, @join(@map(parts, case when @hit(trim(_x), '[^ \\\\n] *\\\\n[ \\\\n]*[^ \\\\n]') then '0' else '1' end), '') as ones from p)
select doc_id, paragraphs, @greatest_of(@map(@split(ones, '0'), length(_x))) as longest from s""",
    # WN-10: ids of authors in sequence.
    "author_ids": "select doc_id, source || '-' || lpad(@text(row_number() over (partition by source order by doc_id)), 5, '0') as post_id from documents",
    # WN-12: what was used in the last three runs.
    "recent_window": "with r as (select user_id, event_type, event_id, dense_rank() over (partition by user_id order by event_id desc) as k from events) select user_id, @gather_set(event_type) as recent from r where k <= 3 group by user_id",
    # TK-01, TK-02: candidates in order, the best two of each platform.
    "top_candidates": f"""with {JUDGED}, c as (select run, cid, count_if(score = 1) as hard, count_if(score = 2) as soft, sum(score) as total, max(score) as reply from judged group by run, cid),
r as (select *, row_number() over (partition by run order by hard, soft, reply desc, total desc, cid) as k from c) select run, cid, k, hard, soft, total from r where k <= 2""",
    # TK-03: fillers from the narrowest length band that has enough, one author first.
    "fillers": f"""with {POSTS}, t as (select id, lang, n_chars from posts where id % 100 = 0), f as (select t.id, p.id as filler, p.author, case when abs(p.n_chars - t.n_chars) <= 0.3 * t.n_chars then 1 when abs(p.n_chars - t.n_chars) <= 0.5 * t.n_chars then 2 else 3 end as band from t join posts p on p.lang = t.lang and p.id != t.id),
b as (select id, min(band) as band from (select id, b.band, count(distinct author) as authors from f join (select 1 as band union all select 2 union all select 3) b on f.band <= b.band group by id, b.band) q where authors >= 3 group by id),
a as (select f.id, f.filler, row_number() over (partition by f.id, f.author order by @sha(@text(f.filler))) as own, @sha(@text(f.filler)) as jitter from f join b on f.id = b.id and f.band <= b.band),
k as (select *, row_number() over (partition by id order by own, jitter) as k from a) select id, filler, k from k where k <= 4""",
    # TK-04: the weaker of two.
    "weaker": "with p as (select conv_id, turn, length(text) as n, @count_hits(text, '[!?]') as flags, row_number() over (partition by conv_id order by @count_hits(text, '[!?]') desc, length(text) desc, turn desc) as k from conversations where turn <= 2) select conv_id, turn, n, flags from p where k = 1",
    # TK-05: the worst hits and their true number.
    "hit_cap": "with h as (select l_suppkey as ref, l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as k, count(*) over (partition by l_suppkey) as total from lineitem) select ref, l_orderkey, l_linenumber, l_quantity, total from h where k <= 25",
    # TK-07, TK-08: sections in order, and a blind sample of one each by hash.
    "blind_sample": f"""with {RATED}, s as (select id, lang, case verdict when 'pass' then 1 when 'hold' then 2 else 3 end as section, row_number() over (partition by lang, verdict order by @sha(@text(id) || '7')) as k from rated) select lang, section, id, substring(@sha(lang || @text(section)), 1, 8) as token from s where k = 1""",
    # TK-11: the newest thirty runs.
    "retention": "select o_orderdate as day, count(*) as n from orders group by o_orderdate order by o_orderdate desc limit 30",
    # TK-12: sampling and seeds by hash.
    "hash_sample": "select doc_id, @hex_number(substring(@sha(text), 1, 8)) % 4 = 0 as heldout, substring(@sha(@text(doc_id) || '|' || source), 1, 8) as seed from documents where text is not null",
    # TK-10: assignments in a seeded order without recent or weak ones.
    "assignments": """with pool as (select p_type as move, p_brand as device, avg(p_retailprice) as score, count(*) as n from part group by p_type, p_brand), k as (select move, device, row_number() over (partition by device order by case when score >= 1500 then 0 else 1 end, @sha(move || device)) as k from pool where not (score <= 950 and n >= 3)) select device, move, k from k where k <= 3""",
    # SNK-04: an upsert of new rows over old ones.
    "upsert": """with old as (select o_orderkey as id, o_totalprice as price, o_orderstatus as status from orders where o_orderkey % 3 != 0), new as (select l_orderkey as id, sum(l_extendedprice) as price, max(l_linestatus) as status from lineitem where l_orderkey % 5 = 0 group by l_orderkey)
select coalesce(o.id, n.id) as id, round(coalesce(n.price, o.price), 4) as price, coalesce(n.status, o.status) as status, o.id is null as inserted from old o full outer join new n on o.id = n.id""",
    # SNK-07: a snapshot's version goes up only when its content changed.
    "versions": """with s as (select o_custkey as id, o_orderdate as day, o_orderkey, o_orderstatus as content, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) select id, o_orderkey, content, sum(case when before is null or before != content then 1 else 0 end) over (partition by id order by day, o_orderkey rows between unbounded preceding and current row) as version from s""",
    # OR-03: the first stage that is not done.
    "next_stage": "select doc_id, case when quality is null then 'tier0' when toxic is null then 'tier1' when quality = 0 and toxic = 0 then 'jury' when quality = 0 then 'write' else 'deliver' end as stage from labels",
    # FLT-02, FLT-06: actions after the downgrade by base rates.
    "downgraded": f"""with {RATED}, b as (select lang, avg(case when toxic = 1 then 1.0 else 0.0 end) as rate from rated group by lang)
select r.id, case when r.quality = 0 then 'hard' else 'soft' end as class_original, case when b.rate > 0.25 then case when r.quality = 0 then 'flag' else 'advisory' end else case when r.quality = 0 then 'hard' else 'soft' end end as class, r.toxic = 1 or r.verdict = 'fail' as needs_action from rated r join b on r.lang = b.lang""",
    # 2.11.1 E1, P14-P16: features against the band of their scope.
    "envelope": f"""with {POSTS}, s as (select lang, @quantile(@real(n_chars), 0.25) as c1, @quantile(@real(n_chars), 0.75) as c3, @quantile(@real(n_words), 0.25) as w1, @quantile(@real(n_words), 0.75) as w3 from posts group by lang)
select p.id, p.n_chars between s.c1 - 1.5 * (s.c3 - s.c1) and s.c3 + 1.5 * (s.c3 - s.c1) as chars_in, round((2.0 * case when p.n_chars between s.c1 - 1.5 * (s.c3 - s.c1) and s.c3 + 1.5 * (s.c3 - s.c1) then 1 else 0 end + case when p.n_words between s.w1 - 1.5 * (s.w3 - s.w1) and s.w3 + 1.5 * (s.w3 - s.w1) then 1 else 0 end) / 3.0, 6) as share from posts p join s on p.lang = s.lang""",
}

QUERIES, ORACLES = both(PLANS)


def fillers(spark, sf_dir):
    """TK-03: fillers from the narrowest length band that has enough, one author first."""
    posts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("author"), "n_chars")
    return filling.fillers(posts, posts.where("id % 100 = 0"))


def quantiles(spark, sf_dir):
    """AG-27: quantiles and means with zero for nothing."""
    mean = F.coalesce(F.round(F.avg("l_discount") * 1e6) / 1e6, F.lit(0.0)).alias("mean")
    found = exact.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", (0.25, 0.5, 0.75), mean)
    return found.select(F.col("l_returnflag").alias("flag"), *(F.col("quantiles")[k].alias(c) for k, c in enumerate(("q1", "median", "q3"))), "mean")


# The SQL says the same in the plain way.
QUERIES |= {f.__name__: f for f in (fillers, quantiles)}
