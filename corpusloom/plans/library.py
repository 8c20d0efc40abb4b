"""Queries that apply the operators of the library to the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..operators import checks, compare, features, materialise, rows, spans, tables
from ..sources.store import kept, shared_path
from ..sources.tables import table

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    platform = F.when((F.length("text") <= 280) & ~F.contains("text", F.lit("\n")), "x").otherwise("linkedin")
    return docs.select(F.col("doc_id").alias("post_id"), F.sha2("text", 256).alias("sha"), platform.alias("platform"), F.col("source").alias("author"), (F.col("doc_id") % 10 == 0).alias("own"), F.when(F.col("doc_id") % 7 == 3, F.col("doc_id") - 1).alias("link"), "text")


def canonical_text(spark, sf_dir):
    """FN-01, FN-02: hashes of canonical forms."""
    return _texts(spark, sf_dir).select("doc_id", F.sha2(canon.normalize_text("text"), 256).alias("sha"), F.length(canon.fold_punct("text")).alias("folded"))


def x_lengths(spark, sf_dir):
    """FN-07: weighted lengths of sentences with an address."""
    return table(spark, sf_dir, "pages").select("page_id", canon.x_length(F.concat(F.lit("see "), "url", F.lit("). ok"))).alias("n"))


def folds(spark, sf_dir):
    """FN-18: what shows above the fold."""
    return _texts(spark, sf_dir).select("doc_id", canon.above_fold("text").alias("f")).select("doc_id", "f.cut_index", "f.cut_by")


def author_slugs(spark, sf_dir):
    """PRJ-04: slugs of names."""
    return table(spark, sf_dir, "customer").select("c_custkey", canon.slugify(F.concat(F.lit("@"), "c_name", F.lit(" É."))).alias("slug"))


def normal_rows(spark, sf_dir):
    """PRJ-01, PRJ-02, PRJ-03: raw rows under other headers, mapped, cleaned, with inferred platforms."""
    page = F.concat(F.lit("https://www."), F.when(F.col("doc_id") % 3 == 0, "linkedin.com/p/").when(F.col("doc_id") % 3 == 1, "x.com/p/").otherwise("example.org/p/"), F.col("doc_id"))
    raw = _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("Notes"), F.col("source").alias("Poster"), F.concat(F.lit("\r\n"), "text", F.lit(" \n")).alias("Post_Text"), page.alias("permalink"), F.concat(F.col("n_chars") / 10, F.lit("k")).alias("Reactions"), F.lit(" ").alias("Replies"), F.lit("a.png; b.png\n").alias("Images"))
    found = rows.normalise_rows(raw)
    return found.select("author", "url", "platform", F.col("engagement.likes").alias("likes"), F.col("engagement.comments").alias("comments"), F.size("media").alias("media"), F.length("text").alias("n"))


def media_states(spark, sf_dir):
    """PRJ-07: what may be fetched."""
    return table(spark, sf_dir, "pages").select("page_id", rows.media_status(F.col("url"), False, ("example.com",), ("example.org",)).alias("state"))


def problem_rows(spark, sf_dir):
    """FLT-01: rows that lack a required field."""
    posts = _texts(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("author"), F.when(F.col("doc_id") % 11 > 0, F.lit(" ")).alias("platform"), "text")
    return rows.row_problems(posts).select("doc_id", F.array_join("problems", ",").alias("problems"))


def inherited_splits(spark, sf_dir):
    """WN-13: splits along links, topped up."""
    return rows.assign_splits(_posts(spark, sf_dir).drop("text"), never=("src3",)).select("post_id", "split")


def feature_store(spark, sf_dir):
    """SNK-06: features after a second run in which some texts have changed: only those are computed again."""
    posts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("post_id"), F.lit("train").alias("split"), "text")
    changed = posts.withColumn("text", F.when(F.col("post_id") % 7 == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    path = shared_path(spark, "features")
    for batch in (posts, changed):
        materialise.update_features(batch, path, lambda df: df.withColumn("n_words", words))
    return materialise.current_features(changed, path).select("post_id", "n_words", "batch")


def fragment_triples(spark, sf_dir):
    """WN-09: triples of short sentences."""
    words = F.transform(F.split("text", r"[.!?]\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    return _texts(spark, sf_dir).select("doc_id", spans.triples(words, 3).alias("n"))


def common_strings(spark, sf_dir):
    """JN-03: the longest common string of 40 characters or more of each document and benchmark item, copies included."""
    bench = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("ref"), F.lower("text").alias("ref_text"))
    texts = _texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return compare.common_strings(texts, bench).select("id", "ref", "length")


def published_edits(spark, sf_dir):
    """FN-20, JN-21: edits between a turn and the next of its role."""
    turns = table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", "role", (F.col("turn") - 2).alias("turn"), F.col("text").alias("live"))
    pairs = turns.withColumnRenamed("text", "draft").join(later, ["conv_id", "role", "turn"])
    return compare.edits(pairs).select("conv_id", "turn", F.array_join("edits", ",").alias("edits"))


def lessons(spark, sf_dir):
    """ST-03: items of near-equal words merged in order."""
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("section"), F.when(F.col("turn") < 2, "early").otherwise("late").alias("tag"), F.coalesce("text", F.lit("")).alias("instruction"))
    return compare.consolidate(items).select("id", "merged_into")


def exemplars(spark, sf_dir):
    """JN-15: the two closest exemplars of each candidate."""
    side = lambda name, key: table(spark, sf_dir, name).where("text is not null").select(F.col(key).alias("id"), (F.col(key) % 50).alias("archetype"), (F.col(key) % 31).alias("hook"), (F.col(key) % 40).alias("ending"), F.split(F.lower("text"), r"\s+").alias("words"))
    return compare.closest(side("benchmark", "item_id"), side("documents", "doc_id"))


def voices(spark, sf_dir):
    """JN-22: voice samples of benchmark items."""
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cid"), F.when(F.col("item_id") % 2 == 0, "x").otherwise("linkedin").alias("platform"))
    return tables.voice_samples(_posts(spark, sf_dir).withColumn("split", F.when(F.col("own"), "self").otherwise("train")), wanted)


def pools(spark, sf_dir):
    """FLT-10: the pool of a line-up for each platform."""
    posts = _posts(spark, sf_dir).withColumn("split", F.when(F.col("post_id") % 4 == 0, "heldout").otherwise("train"))
    return tables.lineup_pool(posts)


def profile_versions(spark, sf_dir):
    """SNK-07: a second snapshot beside the first: new versions of what changed."""
    nation = table(spark, sf_dir, "nation")
    history = nation.select(F.col("n_name").alias("scope"), F.col("n_regionkey").cast("string").alias("content"), F.lit(1).alias("version"))
    now = nation.select(F.col("n_name").alias("scope"), F.when(F.col("n_nationkey") % 3 == 0, "new").otherwise(F.col("n_regionkey").cast("string")).alias("content"))
    return tables.snapshot(history, now)


def performance_log(spark, sf_dir):
    """SNK-04: snapshots taken into the performance log."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("cid"), F.lit("old").alias("url"), F.lit(None).cast("date").alias("posted_at"), F.array(F.col("o_totalprice")).alias("snapshots"))
    new = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("cid"), F.when(F.col("o_orderkey") % 5 == 0, "new").alias("url"), F.col("o_orderdate").cast("date").alias("posted_at"), (F.col("o_totalprice") + 1).alias("snapshot"))
    out = tables.upsert_performance(old, new)
    return out.select("cid", "url", F.col("posted_at").cast("string").alias("posted_at"), F.size("snapshots").alias("n"), F.round(F.element_at("snapshots", -1), 2).alias("last"))


def calibration_log(spark, sf_dir):
    """SNK-04: a score on the newest generated row of each reference, else a new row."""
    events = table(spark, sf_dir, "events")
    old = events.select(F.col("user_id").alias("ref"), "event_id", F.col("event_type").alias("kind"), F.lit(None).cast("int").alias("score"))
    new = table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("ref"), F.lit(None).cast("bigint").alias("event_id"), F.lit("rated").alias("kind"), F.col("quality").cast("int").alias("score"))
    return tables.upsert_newest(old, new, "ref", "event_id", ("view", "click"), "score").where("score is not null").select("ref", "event_id", "kind", "score")


CHECK_RULES = {"P7_bait": [{"phrase": "comment below"}], "P8_opener": [{"pattern": r"\b(the|is)\b"}], "P9_residue": [{"phrase": "as an ai"}], "P10_contrast_flip": [{"pattern": r"not (just|only) .{1,40} but"}], "P12_closer": [{"phrase": "let that sink in"}], "P19_clickbait": [{"phrase": "you won't believe"}], "t1": [{"pattern": r"\bdelv\w+"}], "t2": [{"phrase": "moreover"}], "t3": [{"phrase": "robust"}], "P17_lists": [{"pattern": r"\w+, \w+, and \w+"}], "P18_hedges": [{"phrase": "perhaps"}, {"phrase": "maybe"}], "P20_misc": [{"pattern": r"!{3,}"}]}


def _candidates(spark, sf_dir):
    return _posts(spark, sf_dir).select(F.col("post_id").alias("cid"), "platform", "text", (F.col("post_id") % 3 == 0).alias("media"))


def feature_groups(spark, sf_dir):
    """2.11.2: features of every document."""
    found = features.features(_texts(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "size.*", F.col("line_words.median").alias("line_median"), F.col("line_words.max_run_single_line_paras").alias("single_run"), F.col("sent_words.mean").alias("sent_mean"), F.col("sent_words.cv").alias("sent_cv"), F.col("hook.line1_words").alias("line1_words"), F.col("pov.dominant").alias("pov"), F.col("punct_per_1k.comma").alias("commas"), F.col("lexicon.ttr").alias("ttr"), F.col("letter_case.pct_allcaps_tokens").alias("caps"), F.col("other.pct_single_sentence_paras").alias("single"))


def check_rows(spark, sf_dir):
    """ST-07: the checks of every document as a long table."""
    return checks.check_table(_candidates(spark, sf_dir), CHECK_RULES)


def check_summaries(spark, sf_dir):
    """FLT-02, FLT-03, FLT-06, FLT-07: what asks for action, after the downgrade by the corpus's own rates."""
    found = kept(checks.check_table(_candidates(spark, sf_dir), CHECK_RULES), "checks")  # read twice, scanned once
    rates = found.groupBy("check_id").agg(F.round(F.avg((~F.col("pass")).cast("double")), 6).alias("base_rate"))
    low = checks.downgraded(found, rates, ("P6_emoji", "P8_opener", "P10_contrast_flip", "P17_lists"), ("P0_schema",))
    out = checks.summary(low)
    return out.select("cid", *(F.array_join(c, ",").alias(c) for c in ("hard", "soft", "flag", "advisory")))


QUERIES = {f.__name__: f for f in (canonical_text, x_lengths, folds, author_slugs, normal_rows, media_states, problem_rows, inherited_splits, feature_store, fragment_triples, common_strings, published_edits, lessons, exemplars, voices, pools, profile_versions, performance_log, calibration_log, feature_groups, check_rows, check_summaries)}

_PLAIN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '“', '\"'), '”', '\"'), '„', '\"'), '‘', ''''), '’', ''''), '‚', ''''), '—', '-'), '–', '-'), '―', '-'), '…', '...'), chr(160), ' ')"

ORACLES = {
    "canonical_text": rf"""with f as (select doc_id, {_PLAIN} as t from documents where text is not null)
select doc_id, sha256(trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(t), '(https?://[^\s]+|www\.[^\s]+)', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '''', ''), '\s+', ' ', 'g'))) as sha, length(t) as folded from f""",
    "x_lengths": "select page_id, 4 + case when regexp_matches(url, '^https?://') then 23 else length(url) end + 5 as n from pages",
    "folds": """with t as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null), h as (select *, array_to_string(l[1:3], chr(10)) as head from t)
select doc_id, case when length(head) > 140 then 140 when len(l) > 3 then length(head) else length(text) end as cut_index, case when length(head) > 140 then 'chars' when len(l) > 3 then 'lines' end as cut_by from h""",
    "author_slugs": "select c_custkey, trim(regexp_replace(lower(c_name || ' e'), '[^a-z0-9]+', '-', 'g'), '-') as slug from customer",
    "normal_rows": """with t as (select doc_id, source, n_chars, rtrim(regexp_replace(text, '^\n+', ''), ' ' || chr(10) || chr(9)) as t from documents where text is not null)
select source as author, 'https://www.' || case doc_id % 3 when 0 then 'linkedin.com/p/' when 1 then 'x.com/p/' else 'example.org/p/' end || doc_id as url,
case when doc_id % 3 = 0 then 'linkedin' when doc_id % 3 = 1 then 'x' when length(t) <= 280 and not contains(t, chr(10)) then 'x' end as platform, n_chars * 100 as likes, null::bigint as comments, 2 as media, length(nullif(t, '')) as n from t""",
    "media_states": "with h as (select page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages) select page_id, case when not regexp_matches(url, '^https?://') then 'local' when host = 'example.com' or ends_with(host, '.example.com') then 'refused' when host = 'example.org' or ends_with(host, '.example.org') then 'not_fetched' else 'listed' end as state from h",
    "problem_rows": "select doc_id, array_to_string(list_filter([case when trim(text) = '' then 'text' end, case when doc_id % 9 = 0 then 'author' end, 'platform'], lambda x: x is not null), ',') as problems from documents where text is not null",
    "inherited_splits": r"""with recursive p as (select doc_id as id, sha256(text) as sha, case when length(text) <= 280 and not contains(text, chr(10)) then 'x' else 'linkedin' end as platform, source as author, doc_id % 10 = 0 as own, case when doc_id % 7 = 3 then doc_id - 1 end as link from documents where text is not null),
f as (select *, case when own then 'self' when author = 'src3' then 'train' when ('0x' || substr(sha, 1, 8))::bigint % 4 = 0 then 'heldout' else 'train' end as first from p),
w as (select id, case when not own then link end as at, first as split from f union all select w.id, case when not f.own then f.link end, f.first from w join f on w.at = f.id),
s as (select f.*, (select arg_min(w.split, coalesce(w.at, -1)) from w where w.id = f.id) as split from f),
c as (select *, split = 'train' and link is null and author != 'src3' as free, count(*) filter (split = 'heldout') over (partition by platform) as held from s),
k as (select *, row_number() over (partition by platform, free order by sha, id) as k from c)
select id as post_id, case when free and k <= 4 - held then 'heldout' else split end as split from k""",
    "feature_store": """select doc_id as post_id, len(list_filter(string_split(text, ' '), lambda w: w != '')) + (doc_id % 7 = 3)::int as n_words, 1 + (doc_id % 7 = 3)::int as batch
from documents where text is not null""",
    "pools": """with b as (select case when length(text) <= 280 and not contains(text, chr(10)) then 'x' else 'linkedin' end as platform, count(*) filter (doc_id % 4 != 0) as train, count(*) filter (doc_id % 4 = 0) as held from documents where text is not null group by 1)
select platform, case when (select sum(train) from b) < 24 or train between 1 and 5 or held = 0 then 'train' else 'heldout' end as pool from b""",
    "profile_versions": "select n_name as scope, n_regionkey::varchar as content, 1 as version from nation union all select n_name, 'new', 2 from nation where n_nationkey % 3 = 0",
    "performance_log": "select o_orderkey as cid, case when o_orderkey % 15 = 0 then 'new' when o_orderkey % 2 = 0 then 'old' end as url, case when o_orderkey % 3 = 0 then o_orderdate::date::varchar end as posted_at, (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int as n, round(case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end, 2) as last from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0",
    "calibration_log": """with k as (select user_id as ref, event_id, event_type as kind, row_number() over (partition by user_id order by event_id desc) as k from events where event_type in ('view', 'click'))
select l.doc_id * 3 as ref, k.event_id, coalesce(k.kind, 'rated') as kind, l.quality as score from labels l left join k on k.ref = l.doc_id * 3 and k.k = 1""",
}
