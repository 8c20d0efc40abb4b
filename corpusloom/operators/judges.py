"""Judge files as rows: every dimension accepted or rejected with its reason, quotes matched with the text, reruns planned."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import fold_punct

# Fixed values.
SCHEMA_SUFFIX = ".judge/1"
LENSES = ("reader", "voice", "comedy", "persona", "media", "lineup", "pairwise")
CLAIM_STATUSES = ("user_provided", "brief", "opinion", "joke", "needs_check", "verified", "plausible", "unverifiable", "wrong")
MEDIA_RESULTS = ("alt_text_alone", "does_work", "slop_screen", "executable", "factual", "capture_direction")
ROTATION = {"reader": "voice", "voice": "comedy", "comedy": "reader", "persona": "voice", "media": "media", "lineup": "lineup", "pairwise": "pairwise"}
FALSE_POSITIVE_CHECKS = ("P8_opener", "P10_contrast_flip", "P12_closer", "P17_lists", "O3_skeleton")

RATIO = 0.9
SHIFTS = (-2, -1, 0, 1, 2)
WHOLE = "*"


# ---------------------------------------------------------------- quotes


def match_form(text: str) -> str:
    """A folded text without case and with single blanks."""
    return " ".join(text.split()).casefold()


def window_ratio(quote: str, text: str, least: float = RATIO) -> float:
    """The best ratio of a quote and a window of its length that begins where a block that both share would have it begin, two to either side.

    Windows whose letters can't reach the best so far, or least, are not compared; a result below least only says that none reaches it.
    """
    n = len(quote)
    if not n or not text:
        return 0.0
    whole = SequenceMatcher(None, text, quote, autojunk=False)
    if n >= len(text):
        return SequenceMatcher(None, quote, text, autojunk=False).ratio()
    starts = {b.a - b.b + s for b in whole.get_matching_blocks() if b.size for s in SHIFTS}
    starts = {s for s in starts if 0 <= s <= len(text) - n} or {0}
    # the window is the sequence that is kept, so the quote's own table is made once
    best, near = 0.0, SequenceMatcher(None, "", "", autojunk=False)
    for s in sorted(starts):
        near.set_seqs(quote, text[s : s + n])
        if near.quick_ratio() >= max(best, least):
            best = max(best, near.ratio())
    return best


def quote_match(quote: Column | str, text: Column | str, ratio: float = RATIO) -> Column:
    """FN-19: struct<match, ratio>: exact if the quote is in the text, fuzzy if a window comes near, else none (with no ratio). Null for a null quote or text."""

    @F.pandas_udf("match string, ratio double")
    def each(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for q, t in zip(quotes, texts, strict=True):
            if not isinstance(q, str) or not isinstance(t, str):
                out.append((None, None))
                continue
            q, t = match_form(q), match_form(t)
            if q and q in t:
                out.append(("exact", 1.0))
                continue
            r = window_ratio(q, t, ratio)
            out.append(("fuzzy", round(r, 4)) if r >= ratio else ("none", None))
        return pd.DataFrame(out, columns=["match", "ratio"])

    return each(fold_punct(quote), fold_punct(text))


def _evidence(evidence: Column, text: Column, ratio: float) -> Column:
    """struct<quotes, matched> of a JSON list of quotes (strings, or objects with a quote)."""

    @F.pandas_udf("quotes int, matched boolean")
    def each(lists: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for raw, t in zip(lists, texts, strict=True):
            items = json.loads(raw) if isinstance(raw, str) else []
            items = items if isinstance(items, list) else []
            quotes = [x if isinstance(x, str) else x.get("quote") for x in items if isinstance(x, (str, dict))]
            quotes = [match_form(q) for q in quotes if isinstance(q, str)]
            form = match_form(t) if isinstance(t, str) else None
            out.append((len(quotes), any(form is None or (q and (q in form or window_ratio(q, form, ratio) >= ratio)) for q in quotes)))
        return pd.DataFrame(out, columns=["quotes", "matched"])

    return each(fold_punct(evidence), fold_punct(text))


# ---------------------------------------------------------------- files


def _get(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), path, kind)


def _kind(value: str, path: str) -> Column:
    """The type of what is at a path: STRING, BIGINT, OBJECT<...> and so on; VOID for null, null if it is absent."""
    return F.schema_of_variant(F.try_variant_get(F.col(value), path, "variant"))


def _reasons(ratio: float) -> Column:
    """Why a dimension (a variant `d` of a file) is rejected, the first reason that holds; null if it is accepted."""
    score, score_kind = _get("d", "$.score", "double"), _kind("d", "$.score")
    whole_number = score_kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (score == F.floor(score)) & score.between(1, 5)
    told = (_kind("d", "$.pre_step") == "STRING") & (F.trim(_get("d", "$.pre_step", "string")) != "")
    claims = _get("d", "$.claims", "array<struct<text:string,status:string>>")
    media = F.coalesce(_get("d", "$.sub_results", "map<string,variant>"), _get("d", "$.results", "map<string,variant>"))
    media_kind = F.coalesce(_kind("d", "$.sub_results"), _kind("d", "$.results"))
    confirm = _kind("d", "$.needs_confirmation")
    evidence = _evidence(F.to_json(F.try_variant_get("d", "$.evidence", "variant")), F.col("text"), ratio)
    is_claims, is_media = F.col("dimension") == "claims", F.col("dimension") == "media"
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(F.col("allowed")), "not a dimension of the lens")
        .when(no(_kind("d", "$").startswith("OBJECT")), "not an object")
        .when(F.col("na") & no(told), "na without a reason")
        .when(is_claims & ~F.col("na") & (no(_kind("d", "$.claims").startswith("ARRAY")) | claims.isNull()), "claims must be a list")
        .when(is_claims & ~F.col("na") & F.exists(claims, lambda c: c["text"].isNull()), "a claim without a text")
        .when(is_claims & ~F.col("na") & F.exists(claims, lambda c: ~F.coalesce(c["status"].isin(*CLAIM_STATUSES), F.lit(False))), "unknown claim status")
        .when(is_media & ~F.col("na") & media_kind.isNotNull() & ~media_kind.rlike("^(OBJECT|VOID)"), "media needs sub_results")
        .when(is_media & ~F.col("na") & F.exists(F.map_keys(media), lambda k: ~k.isin(*MEDIA_RESULTS)), "unknown media result")
        .when(is_media & ~F.col("na") & _kind("d", "$.pass").isNotNull() & (_kind("d", "$.pass") != "BOOLEAN"), "media pass must be boolean")
        .when(is_claims | is_media | F.col("na"), None)
        .when(no(whole_number), "score must be an integer 1-5")
        .when(evidence["quotes"] == 0, "no evidence quote")
        .when(~evidence["matched"], "no quote is in the text")
        .when(confirm.isNotNull() & ~confirm.rlike("^(VOID|ARRAY<(VOID|OBJECT))"), "needs_confirmation must be a list of objects")
    )


def judge_rows(files: DataFrame, thresholds: DataFrame, rubric_version: str, ratio: float = RATIO) -> DataFrame:
    """OR-01: (cid, file, place, lens, scoring_lens, dimension, jury, rerun, outcome, score, confirm, reason, whole) of judge files.

    files: cid, file, place, body (the file's JSON), text (of the candidate; null: quotes are not looked for). thresholds: dimension, lens. outcome is
    scored, na or rejected, with a reason. A file that is no JSON object, or of another schema, rubric or unknown lens, or without dimensions is rejected
    whole: a row for each dimension of its lens, or one for `*` if the lens has none. Dimensions that a first file of the lens does not have are rejected
    too; jury and rerun files hold but those they were asked for. Rows can be given to verdict.merge() as they are.
    """
    v = files.withColumn("v", F.try_parse_json("body"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    lens = _get("v", "$.lens", "string")
    rerun_for = F.nullif(_get("v", "$.rerun_for", "string"), F.lit(""))
    schema_ = _get("v", "$.schema", "string")
    dims = _get("v", "$.dimensions", "map<string,variant>")
    why = (
        F.when(~is_object, "not a JSON object")
        .when(schema_.isNotNull() & (~schema_.endswith(SCHEMA_SUFFIX)), "another schema")
        .when(~F.coalesce(_get("v", "$.rubric_version", "string") == rubric_version, F.lit(False)), "another rubric version")
        .when(~F.coalesce(lens.isin(*LENSES), F.lit(False)), "unknown lens")
        .when(F.coalesce(F.size(dims), F.lit(0)) <= 0, "no dimensions")
    )
    head = v.select("cid", "file", "place", "text", lens.alias("lens"), F.coalesce(rerun_for, lens).alias("scoring_lens"), F.coalesce(_get("v", "$.jury", "boolean"), F.lit(False)).alias("jury"), rerun_for.isNotNull().alias("rerun"), why.alias("why"), dims.alias("dims"))
    known = thresholds.select("dimension", F.col("lens").alias("own_lens")).distinct()
    by_lens = known.groupBy(F.col("own_lens").alias("scoring_lens")).agg(F.array_sort(F.collect_set("dimension")).alias("expected"))
    head = head.join(by_lens, "scoring_lens", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    keys = ("cid", "file", "place", "lens", "scoring_lens", "jury", "rerun")

    good = head.where("why is null")
    rows = good.select(*keys, "text", "expected", F.explode("dims").alias("dimension", "d")).join(known, "dimension", "left")
    jury_may = F.col("own_lens").isNotNull() | F.col("dimension").isin(*FALSE_POSITIVE_CHECKS)
    may = F.when(F.col("jury"), jury_may).when(F.size("expected") == 0, F.col("own_lens").isNotNull()).otherwise(F.array_contains("expected", F.col("dimension")))
    rows = rows.withColumn("allowed", may).withColumn("na", F.coalesce(_get("d", "$.na", "boolean"), F.lit(False))).withColumn("reason", _reasons(ratio))
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("na"), "na").otherwise("scored")
    confirm = F.coalesce(F.size(_get("d", "$.needs_confirmation", "array<variant>")) > 0, F.lit(False))
    score = F.when(outcome == "scored", _get("d", "$.score", "double").cast("int"))
    found = rows.select(*keys, "dimension", outcome.alias("outcome"), score.alias("score"), confirm.alias("confirm"), "reason", F.lit(False).alias("whole"))

    lost = lambda df, names, why_, whole: df.select(*keys, F.explode(names).alias("dimension"), F.lit("rejected").alias("outcome"), F.lit(None).cast("int").alias("score"), F.lit(False).alias("confirm"), why_.alias("reason"), F.lit(whole).alias("whole"))
    absent = lost(good.where("not jury and not rerun"), F.array_except("expected", F.map_keys("dims")), F.lit("missing"), False)
    whole = lost(head.where("why is not null"), F.when(F.size("expected") > 0, F.col("expected")).otherwise(F.array(F.lit(WHOLE))), F.col("why"), True)
    return found.unionByName(absent).unionByName(whole)


def rerun_plan(rows: DataFrame, rotation: dict[str, str] | None = None) -> DataFrame:
    """OR-02: (cid, file, lens, rerun_lens, dimensions, whole, reasons) of the files with rejections: the lens that takes over and what it is asked for."""
    turn = F.create_map(*(F.lit(x) for pair in (ROTATION | (rotation or {})).items() for x in pair))
    lost = rows.where("outcome = 'rejected'").groupBy("cid", "file", F.col("scoring_lens").alias("lens"))
    plan = lost.agg(F.array_sort(F.collect_set(F.when(F.col("dimension") != WHOLE, F.col("dimension")))).alias("dimensions"), F.max("whole").alias("whole"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return plan.select("cid", "file", "lens", F.coalesce(F.try_element_at(turn, F.col("lens")), F.col("lens")).alias("rerun_lens"), "dimensions", "whole", "reasons")
