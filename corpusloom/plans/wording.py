"""Queries over phrases, rules and quotes in texts, with SQL that takes the plain way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phrases, scan
from ..sources.tables import table


def plain(text) -> F.Column:
    """Words of ASCII letters and digits in lower case, joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def fuzzy_phrases(spark, sf_dir):
    """JN-06, O2: the phrases of the benchmark (its texts between full stops and commas) in all documents, a few edits apart."""
    parts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), F.explode(F.split("text", "[.,]")).alias("phrase"))
    ours = parts.withColumn("norm", plain(F.col("phrase")))
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), plain(F.col("text")).alias("text"))
    found = phrases.fuzzy_phrases(docs, ours)
    return found.select(F.col("id").alias("doc_id"), "ref", F.col("n").alias("n_words"), "allowed", "distance", (F.col("start") + 1).alias("place"), "window")


def rules(spark, sf_dir):
    """The first two words of every item of the benchmark as phrases, by tier, and patterns in scopes."""
    words = F.regexp_extract("text", r"^\s*([A-Za-z]+)\s+([A-Za-z]+)", 0)
    tier = F.element_at(F.array(*map(F.lit, ("t1", "t2", "t3", "claude"))), (F.col("item_id") % 4 + 1).cast("int"))
    told = table(spark, sf_dir, "benchmark").select(F.concat_ws(".", tier, F.col("item_id")).alias("id"), F.lower(F.trim(words)).alias("phrase")).where("phrase != ''")
    fixed = [
        {"id": "P17.triple", "pattern": r"\b\w+, \w+,? and \w+", "rank": 1},
        {"id": "P8.the", "pattern": r"^(the|a)\b", "scope": "line1", "rank": 0},
        {"id": "P12.end", "phrase": "in the", "scope": "tail2"},
    ]
    return scan.filled(scan.rules_table(spark, fixed)).unionByName(scan.filled(told))


def rule_counts(spark, sf_dir):
    """FN-14, FN-15: how often each phrase stands in each document, and where it first and last does."""
    ours = rules(spark, sf_dir).where("scope = 'text' and phrase is not null")
    hits = scan.rule_hits(texts(spark, sf_dir).select("doc_id", "text"), ours).select("doc_id", F.explode("hits").alias("h"))
    return hits.groupBy("doc_id", F.col("h.id").alias("rule")).agg(F.count("*").alias("n_hits"), F.min("h.start").alias("first_start"), F.max("h.stop").alias("last_stop"))


def rule_spans(spark, sf_dir):
    """FN-15, WN-11, AG-20: hits of all rules that don't overlap, and the tiers' counts and cluster."""
    hits = scan.rule_hits(texts(spark, sf_dir).select("doc_id", "text"), rules(spark, sf_dir))
    kept = hits.select("doc_id", F.size("hits").alias("n_hits"), scan.leftmost("hits").alias("kept"), scan.tiers("hits").alias("tiers"))
    spans = F.array_join(F.transform("kept", lambda h: F.concat_ws(":", h["id"], h["start"].cast("string"), h["stop"].cast("string"))), ",")
    return kept.select("doc_id", "n_hits", F.size("kept").alias("n_kept"), F.sha2(spans, 256).alias("sha"), "tiers.t1", "tiers.t2", "tiers.t3", "tiers.claude", "tiers.cluster")


QUERIES = {f.__name__: f for f in (fuzzy_phrases, rule_counts, rule_spans)}

_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

ORACLES = {
    "fuzzy_phrases": f"""with parts as (select item_id as ref, unnest(regexp_split_to_array(text, '[.,]')) as phrase from benchmark),
ours as (
    select norm, min(ref) as ref, len(string_split(norm, ' ')) as n, case when length(norm) < 8 then 0 else least(2, length(norm) // 8) end as allowed
    from (select ref, {_PLAIN.format("phrase")} as norm from parts) q where regexp_matches(norm, '[a-z]') group by norm),
docs as (select doc_id, string_split({_PLAIN.format("text")}, ' ') as w from documents where text is not null),
short as (
    select doc_id, n, place, array_to_string(w[place:place + n - 1], ' ') as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as place from docs, (select distinct n from ours where n <= 3) s where len(w) >= n) q),
starts as (
    select distinct t.doc_id, p.norm, t.at - p.at + moved + 1 as place
    from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as at from docs) t
    join (select norm, unnest(string_split(norm, ' ')) as word, generate_subscripts(string_split(norm, ' '), 1) as at from ours where n > 3) p on t.word = p.word, range(-1, 2) as m(moved)),
windows as (
    select s.doc_id, s.norm, place, array_to_string(w[place:place + n - 1], ' ') as win from starts s join docs d on s.doc_id = d.doc_id join ours o on s.norm = o.norm
    where place >= 1 and place + n - 1 <= len(w)
    union all
    select doc_id, norm, place, win from short s join ours o on s.n = o.n and length(win) between length(norm) - allowed and length(norm) + allowed),
near as (
    select doc_id, ref, n, allowed, levenshtein(win, v.norm) as distance, place, win, v.norm
    from windows v join ours o on v.norm = o.norm where abs(length(win) - length(v.norm)) <= allowed),
good as (
    select * from near where distance = 0 or (distance <= allowed
        and list_filter(string_split(win, ' '), lambda x: regexp_matches(x, '[0-9]')) = list_filter(string_split(norm, ' '), lambda x: regexp_matches(x, '[0-9]'))))
select doc_id, ref, n as n_words, allowed, distance, place, win as window
from (select *, row_number() over (partition by doc_id, norm order by distance, place) as k from good) q where k = 1""",
    # The gaps between matches give their places: the first begins where the first gap ends, the last ends where the last gap begins.
    "rule_counts": r"""with rules as (
    select list_extract(['t1', 't2', 't3', 'claude'], (item_id % 4 + 1)::int) || '.' || item_id as rule,
        '(?i)\b' || regexp_replace(trim(regexp_extract(text, '^\s*([A-Za-z]+)\s+([A-Za-z]+)')), '\s+', '\\s+', 'g') || '\b' as pattern
    from benchmark where regexp_matches(text, '^\s*[A-Za-z]+\s+[A-Za-z]+')),
hits as (
    select doc_id, rule, len(regexp_extract_all(text, pattern)) as n_hits, regexp_split_to_array(text, pattern) as gaps, length(text) as size
    from documents, rules where text is not null)
select doc_id, rule, n_hits, length(gaps[1]) as first_start, size - length(gaps[-1]) as last_stop from hits where n_hits > 0""",
}
