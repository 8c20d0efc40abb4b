"""Copies, near copies, leaks and overlaps (JN and ST operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar
from .dialect import both, spark_query

POSTS = "posts as (select doc_id as id, source as author, lang, case when n_chars <= 280 and not @hit(text, '\\n') then 'x' else 'linkedin' end as platform, text, @sha(@norm(text)) as sha, @words(text) as w from documents where text is not null)"
FIRST = "firsts as (select min(id) as id, lang, sha from posts group by lang, sha)"
JACCARD = "round(@real({0}) / ({1} + {2} - {0}), 6)"

PLANS = {
    # JN-09: copies by hash and author; another platform's first copy is the cross-post.
    "exact_duplicates": f"""with {POSTS},
r as (select id, author, platform, row_number() over (partition by sha, author, platform order by id) as k,
  first_value(id) over (partition by sha, author order by id) as first_id, first_value(platform) over (partition by sha, author order by id) as first_platform from posts)
select id, author, platform, k > 1 as duplicate, case when k = 1 and first_platform != platform then first_id end as crosspost_of from r""",
    # JN-10: of every text the nearest earlier one of its language with an 8-gram Jaccard of 0.8 or more. Of a
    # text whose grams are shared to four fifths, only the rarest shared ones are joined, so common lines meet nobody.
    "near_duplicates": f"""with {POSTS}, {FIRST},
s as (select id, lang, gram from posts @explode(@grams(w, 8), gram) where id in (select id from firsts)),
z as (select id, count(*) as n from s group by id),
f as (select lang, gram, count(*) as df from s group by lang, gram having count(*) > 1),
r as (select s.id, s.lang, s.gram, row_number() over (partition by s.id order by f.df desc, s.gram) as k from s join f on s.gram = f.gram and s.lang = f.lang),
h as (select r.id, r.lang, max(r.k) as shared, max(z.n) as n from r join z on r.id = z.id group by r.id, r.lang having max(r.k) >= 0.8 * max(z.n)),
pre as (select r.id, r.lang, r.gram from r join h on r.id = h.id where r.k > ceil(0.8 * h.n) - 1),
cand as (select distinct a.id as id, b.id as other from pre a join pre b on a.gram = b.gram and a.lang = b.lang and b.id < a.id),
pairs as (select c.id, c.other, count(*) as c from cand c join s a on c.id = a.id join s b on c.other = b.id and a.gram = b.gram group by c.id, c.other),
j as (select p.id, p.other, {JACCARD.format("p.c", "x.n", "y.n")} as j from pairs p join z x on p.id = x.id join z y on p.other = y.id where @real(p.c) / (x.n + y.n - p.c) >= 0.8),
k as (select *, row_number() over (partition by id order by j desc, other) as k from j)
select id, other as variant_of, j as jaccard from k where k = 1""",
    # JN-13, JN-01: documents that share 6-grams with held-out benchmark items, by an inverted index.
    "heldout_leaks": f"""with {POSTS},
b0 as (select item_id, @words(text) as w from benchmark),
b as (select distinct item_id, gram from b0 @explode(@grams(w, 6), gram)),
d as (select distinct id, gram from posts @explode(@grams(w, 6), gram) where gram in (select gram from b))
select d.id, b.item_id, count(*) as grams from d join b on d.gram = b.gram group by d.id, b.item_id""",
    # JN-02: all maximal shared word runs of 6 or more, as islands on the diagonals of gram positions.
    "shared_runs": f"""with {POSTS},
d as (select id, g.at as i, g.gram as gram from posts @explode(@placed_grams(w, 6), g)),
b0 as (select item_id, @words(text) as w from benchmark),
b as (select item_id, g.at as j, g.gram as gram from b0 @explode(@placed_grams(w, 6), g)),
m as (select d.id, b.item_id, d.i, d.i - b.j as diagonal from d join b on d.gram = b.gram),
r as (select *, i - row_number() over (partition by id, item_id, diagonal order by i) as island from m)
select id, item_id, min(i) as start_word, count(*) + 5 as n_words from r group by id, item_id, diagonal, island""",
    # JN-05, JN-04: the level of overlap from the longest run.
    "overlap_levels": f"""with {POSTS},
d as (select id, g.at as i, g.gram as gram from posts @explode(@placed_grams(w, 6), g)),
b0 as (select item_id, @words(text) as w from benchmark),
b as (select item_id, g.at as j, g.gram as gram from b0 @explode(@placed_grams(w, 6), g)),
m as (select d.id, b.item_id, d.i, d.i - b.j as diagonal from d join b on d.gram = b.gram),
r as (select *, i - row_number() over (partition by id, item_id, diagonal order by i) as island from m),
s as (select id, item_id, count(*) + 5 as n from r group by id, item_id, diagonal, island)
select id, max(n) as longest, count(distinct item_id) as n_refs, case when max(n) >= 8 then 'fail' else 'flag' end as level from s group by id""",
    # JN-07 (part): a 3-gram Jaccard of 0.15 or more with a benchmark item.
    "skeletons": f"""with {POSTS},
d1 as (select id, gram from posts @explode(@grams(w, 3), gram)), d as (select id, gram, count(*) over (partition by id) as n from d1),
b0 as (select item_id, @words(text) as w from benchmark),
b1 as (select item_id, gram from b0 @explode(@grams(w, 3), gram)), b as (select item_id, gram, count(*) over (partition by item_id) as n from b1),
c as (select d.id, b.item_id, d.n as dn, b.n as bn, count(*) as c from d join b on d.gram = b.gram group by d.id, b.item_id, d.n, b.n)
select id, item_id, {JACCARD.format("c", "dn", "bn")} as jaccard from c where @real(c) / (dn + bn - c) >= 0.15""",
    # JN-08: siblings of one author and platform with a 3-gram Jaccard of 0.5 or more.
    "siblings": f"""with {POSTS},
d1 as (select id, author, platform, gram from posts @explode(@grams(w, 3), gram)), d as (select id, author, platform, gram, count(*) over (partition by id) as n from d1),
c as (select a.id as a_id, b.id as b_id, a.n as an, b.n as bn, count(*) as c from d a join d b on a.gram = b.gram and a.author = b.author and a.platform = b.platform and a.id < b.id group by a.id, b.id, a.n, b.n)
select a_id, b_id, {JACCARD.format("c", "an", "bn")} as jaccard from c where @real(c) / (an + bn - c) >= 0.5""",
    # JN-14: the nearest benchmark item of every short document, those of equal parity of id first, and the place after it.
    "nearest_reference": f"""with {POSTS},
d1 as (select id, gram from posts @explode(@grams(w, 3), gram)), d as (select id, gram, count(*) over (partition by id) as n from d1),
b0 as (select item_id, @words(text) as w from benchmark),
b1 as (select item_id, gram from b0 @explode(@grams(w, 3), gram)), b as (select item_id, gram, count(*) over (partition by item_id) as n from b1),
c as (select d.id, b.item_id, d.n as dn, b.n as bn, count(*) as c from d join b on d.gram = b.gram group by d.id, b.item_id, d.n, b.n),
r as (select id, item_id, {JACCARD.format("c", "dn", "bn")} as j, row_number() over (partition by id order by case when id % 2 = item_id % 2 then 0 else 1 end, {JACCARD.format("c", "dn", "bn")} desc, item_id) as k from c)
select id, item_id, j as jaccard, k from r where k <= 4""",
    # ST-01, ST-02: sizes of the n-gram sets and the Jaccard of a turn with the one before it; zero when both are empty.
    "turn_jaccard": """with t as (select conv_id, turn, @grams(@words(text), 2) as g, lag(@grams(@words(text), 2)) over (partition by conv_id order by turn) as p from conversations)
select conv_id, turn, @size(g) as n, case when @size(g) + @size(p) = 0 then 0.0 else round(@real(@common(g, p)) / (@size(g) + @size(p) - @common(g, p)), 6) end as jaccard from t where p is not null""",
    # ST-05: one reference set of three kinds.
    "reference_union": """select 'corpus' as ref_kind, doc_id as ref_id, @size(@words(text)) as n from documents where text is not null
union all select 'benchmark', item_id, @size(@words(text)) from benchmark
union all select 'turn', conv_id * 1000 + turn, @size(@words(text)) from conversations""",
    # JN-19: ids without a match, and fields out of range, as one table of problems.
    "referential_lint": """select o_orderkey as id, 'customer' as field, 'unknown id' as problem from orders o left join customer c on o.o_custkey = c.c_custkey where c.c_custkey is null
union all select doc_id, 'label', 'no such document' from labels where doc_id not in (select doc_id from documents where doc_id is not null)
union all select l_orderkey * 10 + l_linenumber, 'discount', 'out of range' from lineitem where l_discount > 0.09
union all select conv_id * 1000 + turn, 'role', 'not in the list' from conversations where role not in ('user', 'assistant', 'system')""",
    # JN-20: cited line ranges lie inside the document and are not reversed.
    "citation_ranges": """with d as (select doc_id, @size(@split(text, '\\n')) as n_lines, 1 + doc_id % 3 as lo, 1 + doc_id % 7 as hi from documents where text is not null)
select doc_id, lo, hi, n_lines, lo <= hi and hi <= n_lines as ok from d""",
    # JN-17, WN-07: ratings with the score of the newest round.
    "newest_round": """with s as (select user_id as run, event_id % 50 as cid, event_id % 5 as round, event_id, value as score from events),
r as (select *, row_number() over (partition by run, cid order by round desc, event_id desc) as k from s)
select l.doc_id, r.run, r.round, round(r.score, 6) as score from labels l join r on r.cid = l.doc_id % 50 and r.run = l.doc_id % 100 where r.k = 1""",
    # JN-12, JN-24: delivery rows with what may be there.
    "delivery": """select o.o_orderkey as id, coalesce(c.c_name, 'none') as name, n.n_name as nation, coalesce(l.n, 0) as lines, coalesce(l.flagged, 0) as flagged
from orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey
left join (select l_orderkey, count(*) as n, count_if(l_returnflag = 'R') as flagged from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey""",
    # FLT-04, FLT-05: fillers that are not excluded, and rows that nobody asked for.
    "contamination_filter": """select s.doc_id, s.quality from labels s where exists (select 1 from documents d where d.doc_id = s.doc_id and d.lang = 'en') and not exists (select 1 from benchmark b where b.item_id = s.doc_id)""",
}

QUERIES, ORACLES = both(PLANS)

_posts = spark_query(f"with {POSTS} select id, author, lang, platform, @join(w, ' ') as norm from posts where id is not null")


def _rounded() -> F.Column:
    """As dialect has it."""
    return F.round(similar.jaccard() * 1e6) / 1e6


def near_duplicates(spark, sf_dir):
    """JN-10: the rows of its SQL, by a join of hashed grams; of equal texts of a language the first stands for all."""
    posts = _posts(spark, sf_dir)
    firsts = posts.join(similar.copies(posts, ["lang"]), "id", "left_anti")
    found = similar.similar(firsts, ["lang"], 8, 0.8).withColumn("j", _rounded())
    best = found.groupBy("b").agg(F.min(F.struct((-F.col("j")).alias("less"), "a")).alias("best"))
    return best.select(F.col("b").alias("id"), F.col("best.a").alias("variant_of"), (-F.col("best.less")).alias("jaccard"))


def siblings(spark, sf_dir):
    """JN-08: the rows of its SQL. Equal texts are compared as one and put in the pairs' places."""
    posts, keys = _posts(spark, sf_dir), ["author", "platform"]
    same = similar.copies(posts, keys)
    found = similar.similar(posts.join(same, "id", "left_anti"), keys, 3, 0.5).select("a", "b", _rounded().alias("jaccard"))
    own = posts.where("author is not null and size(split(norm, ' ')) >= 3").join(same, "id").select("id", "first")
    classes = own.select("first", "id").unionByName(own.select("first", F.col("first").alias("id")).distinct())
    members = lambda x: classes.select(F.col("first").alias(x), F.col("id").alias(f"{x}_of"))
    of = [F.coalesce(f"{x}_of", x) for x in "ab"]
    apart = found.join(members("a"), "a", "left").join(members("b"), "b", "left").select(F.least(*of).alias("a_id"), F.greatest(*of).alias("b_id"), "jaccard")
    within = classes.alias("x").join(classes.alias("y"), F.expr("x.first = y.first and x.id < y.id")).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), F.lit(1.0).alias("jaccard"))
    return apart.unionByName(within)


QUERIES |= {f.__name__: f for f in (near_duplicates, siblings)}
