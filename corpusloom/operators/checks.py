"""Checks of candidates as a long table, their downgrade by base rates, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import WORD, sentences
from .verdict import needs_action

# The checks in their order with their classes.
CLASSES = {
    "P0_schema": "hard", "P1_length": "hard", "P2_fold": "hard", "P_min_words": "hard", "P3_hashtags": "hard", "P4_links": "hard", "P5_markup": "hard", "P6_emoji": "hard",
    "P7_bait": "hard", "P8_opener": "hard", "P9_residue": "hard", "P10_contrast_flip": "hard", "P11_cluster": "hard", "P12_closer": "hard", "P13_specifics": "hard", "P14_dashes": "soft",
    "P15_burstiness": "soft", "P16_broetry": "soft", "P17_lists": "hard", "P18_hedges": "soft", "P19_clickbait": "soft", "P20_misc": "soft",
    "O1_ngram": "hard", "O2_phrases": "hard", "O3_skeleton": "flag", "O4_sibling": "flag", "O5_published": "hard", "E1_envelope": "soft",
}
LIMITS = {"linkedin": {"chars": 3000, "words": 8, "hashtags": 3, "emoji": 3, "floor": 40}, "x": {"chars": 280, "words": 2, "hashtags": 0, "emoji": 1, "floor": 20}}
MARKUP = (r"\*\*[^*\n]+\*\*", r"(?m)^#{1,6}\s", r"`[^`\n]+`", r"\[[^\]\n]+\]\([^)\n]+\)", r"(?m)^\s*>\s", r"(?m)^\s*---+\s*$", r"<[a-z][^>\n]*>", r"~~[^~\n]+~~", r"(?m)^\s*\|.*\|\s*$", r"__[^_\n]+__")
SPECIFIC = r"\d|[$€£%]|(?<=[a-z,] )[A-Z][a-z]+|`[^`\n]+`"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
#: Checks that fail on any hit of their rules, with the part of the text that is scanned.
SCANNED = {"P7_bait": "text", "P8_opener": "line1", "P9_residue": "text", "P10_contrast_flip": "text", "P12_closer": "tail2", "P19_clickbait": "text"}
#: Checks that never gate alone.
NOT_ALONE = ("P14_dashes",)


def _check(check: str, ok: Column, flag: Column | None = None, class_: Column | None = None) -> Column:
    """One row of the table: passes, asks for attention (flag), and of which class."""
    return F.struct(F.lit(check).alias("check_id"), F.coalesce(ok, F.lit(True)).alias("pass"), F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"), (class_ if class_ is not None else F.lit(CLASSES[check])).alias("class"))


def _limit(platform: Column, name: str) -> Column:
    return F.when(platform == "x", LIMITS["x"][name]).otherwise(LIMITS["linkedin"][name])


def _hits(scope: Column, rules: list[dict]) -> Column:
    """How many matches of the rules' patterns a part of the text has."""
    patterns = ["(?i)" + (r["pattern"] if "pattern" in r else r"\b" + r["phrase"].replace(" ", r"\s+") + r"\b") for r in rules]
    return sum((F.regexp_count(scope, F.lit(p)) for p in patterns), F.lit(0))


def check_table(candidates: DataFrame, rules: dict[str, list[dict]]) -> DataFrame:
    """ST-07: a row for each candidate (cid, platform, text, media) and check, in the fixed order: check_id, pass, flag, class.

    rules gives the rules of the scanned checks, of P11 by tier (`t1`, `t2`, `t3`), P17, P18 and P20. Checks against other
    tables (overlaps, envelope) come from there; they are not made up here. Null texts fail the schema.
    """
    t, platform = F.coalesce(F.col("text"), F.lit("")), F.col("platform")
    df = candidates.select("cid", platform.alias("platform"), "media", F.col("text").isNotNull().alias("given"), t.alias("text"))
    t = F.col("text")
    # What several checks look at is a column of its own: an expression inside an exploded array is computed at each of its places.
    df = df.withColumns({"lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), "paras": F.filter(F.split(t, r"\n\s*\n"), lambda p: F.trim(p) != ""), "head": F.substring(F.array_join(F.slice(F.split(t, "\n"), 1, 3), "\n"), 1, 140)})
    lines, paras, head = F.col("lines"), F.col("paras"), F.col("head")
    line1 = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    tail2 = F.when(F.size(lines) >= 2, F.array_join(F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2)), "\n")).otherwise(line1)
    scopes = {"text": t, "line1": line1, "tail2": tail2}
    found = {
        "n_words": F.regexp_count(t, F.lit(WORD)),
        "n_tags": F.regexp_count(t, F.lit(r"(?<![\w&])#[A-Za-z]\w*")),
        "n_links": F.regexp_count(t, F.lit(r"(?i)https?://\S+|www\.\S+")),
        "tag_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(#[A-Za-z]\w*\s*)+$"))),
        "in_comments": t.rlike(r"(?i)\blink\b.{0,20}\bcomments?\b"),
        "folded": (F.length(head) < F.length(t)) & ~head.rlike(r"[.!?…:;,](\s|$)|\n"),
        "overrun": F.length(F.regexp_extract(F.substring(t, 141, 1_000_000_000), r"(?s)\A(.*?)([.!?…:;,](?=\s|\z)|\n|\z)", 1)),
        "specific": F.regexp_count(t, F.lit(SPECIFIC)),
        "lists": _hits(t, rules.get("P17_lists", [])),
        "misc": _hits(t, rules.get("P20_misc", [])),
        "hedges": _hits(t, rules.get("P18_hedges", [])),
        "single": F.size(F.filter(paras, lambda p: F.size(sentences(p)) == 1)),
        "markup": F.greatest(*(t.rlike(p) for p in MARKUP)),
        "emoji": F.regexp_count(t, F.lit(EMOJI)),
        **{f"tier_{k}": _hits(t, rules.get(k, [])) for k in ("t1", "t2", "t3")},
        **{f"rule_{c}": _hits(scopes[s], rules.get(c, [])) for c, s in SCANNED.items()},
    }
    df = df.select("cid", "platform", "media", "given", F.length(t).alias("size"), F.size(paras).alias("n_paras"), *(e.alias(k) for k, e in found.items()))
    n_words, tags, links, tag_lines, in_comments, folded, overrun, specific, lists = (F.col(k) for k in ("n_words", "n_tags", "n_links", "tag_lines", "in_comments", "folded", "overrun", "specific", "lists"))
    floor = _limit(platform, "floor")
    rows = [
        _check("P0_schema", F.col("cid").isNotNull() & platform.isin(*LIMITS) & F.col("given")),
        _check("P1_length", F.col("size") <= _limit(platform, "chars")),
        _check("P2_fold", (platform == "x") | ~(folded & (overrun > 140)), (platform != "x") & folded & (overrun <= 140), F.when(folded & (overrun <= 140), "flag").otherwise("hard")),
        _check("P_min_words", n_words >= F.when(F.col("media"), 1).otherwise(_limit(platform, "words"))),
        _check("P3_hashtags", (tags <= _limit(platform, "hashtags")) & (tag_lines < 2)),
        _check("P4_links", ~in_comments & ~((platform == "x") & (links > 0)), class_=F.when(~in_comments & (platform != "x") & (links == 1), "advisory").otherwise("hard")),
        _check("P5_markup", ~F.col("markup")),
        _check("P6_emoji", F.col("emoji") <= _limit(platform, "emoji")),
        *(_check(c, F.col(f"rule_{c}") == 0, class_=F.when(platform == "x", "hard").otherwise("soft") if c == "P19_clickbait" else None) for c in SCANNED),
        _check("P11_cluster", ~((F.col("tier_t1") >= 3) | (F.col("tier_t1") + F.col("tier_t2") + F.col("tier_t3") >= 5))),
        _check("P13_specifics", (n_words > 0) & ((n_words <= floor * 1.25) | (specific > 0)), (n_words > floor) & (n_words <= floor * 1.25) & (specific == 0), F.when((n_words > floor) & (n_words <= floor * 1.25), "flag").otherwise("hard")),
        _check("P16_broetry", ~((F.col("single") > 0.8 * F.col("n_paras")) & (F.col("n_paras") >= 4))),
        _check("P17_lists", lists == 0, class_=F.when(lists == 1, "soft").otherwise("hard")),
        _check("P18_hedges", F.col("hedges") < 3),
        _check("P20_misc", F.col("misc") == 0, F.col("misc") > 0),
    ]
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("check_id"))
    return df.select("cid", F.explode(F.array(*rows)).alias("c")).select("cid", "c.*").withColumn("place", order)


def downgraded(checks: DataFrame, base_rates: DataFrame, applies: tuple[str, ...], never: tuple[str, ...] = (), limit: float = 0.25) -> DataFrame:
    """FLT-06: checks whose base rate in the corpus is strictly over the limit: hard becomes flag, soft advisory. A check that has a class_original is done already."""
    checks = checks if "class_original" in checks.columns else checks.withColumn("class_original", F.lit(None).cast("string"))
    joined = checks.drop("base_rate").join(base_rates.groupBy("check_id").agg(F.max("base_rate").alias("base_rate")), "check_id", "left")
    goes = F.col("check_id").isin(*applies) & ~F.col("check_id").isin(*never, "") & (F.col("base_rate") > limit) & F.col("class_original").isNull()
    lower = F.when(F.col("class") == "hard", "flag").when(F.col("class") == "soft", "advisory").otherwise(F.col("class"))
    out = joined.withColumn("goes", F.coalesce(goes, F.lit(False))).withColumn("class_original", F.when(F.col("goes"), F.col("class")).otherwise(F.col("class_original")))
    out = out.withColumn("flag", F.col("flag") | (F.col("goes") & (F.col("class") == "hard") & ~F.col("pass")))
    return out.withColumn("class", F.when(F.col("goes"), lower).otherwise(F.col("class"))).drop("goes")


def summary(checks: DataFrame) -> DataFrame:
    """FLT-03, FLT-07: per candidate the checks that ask for action, by class. Checks that never gate alone are advisory where no other check gates (verdict.merge() looks at all tiers)."""
    acts = needs_action(F.col("pass"), F.col("class"), F.col("flag"))
    of = lambda c: F.array_sort(F.collect_list(F.when(acts & (F.col("class") == c), F.struct("place", "check_id"))))
    lists = checks.groupBy("cid").agg(*(of(c).alias(c) for c in ("hard", "soft", "flag", "advisory")))
    named = lists.select("cid", *(F.transform(c, lambda x: x["check_id"]).alias(c) for c in ("hard", "soft", "flag", "advisory")))
    gating = F.concat("hard", "soft", "flag")
    alone = (F.size(gating) > 0) & (F.size(F.array_except(gating, F.array(*map(F.lit, NOT_ALONE)))) == 0)
    empty = F.array().cast("array<string>")
    return named.select("cid", F.when(alone, empty).otherwise(F.col("hard")).alias("hard"), F.when(alone, empty).otherwise(F.col("soft")).alias("soft"), F.when(alone, empty).otherwise(F.col("flag")).alias("flag"), F.when(alone, F.concat("advisory", gating)).otherwise(F.col("advisory")).alias("advisory"))
