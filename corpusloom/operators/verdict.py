"""AG-18, 2.11.3: the verdict on candidates from check rows, judge rows and comparisons, and why their rewriting stops."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """What a rubric fixes: juries, reruns, and the checks that are treated apart."""

    jury_size: int = 3
    hard_trigger: int = 3
    override_threshold: float = 4.0
    false_positive_checks: tuple[str, ...] = ("P8_opener", "P10_contrast_flip", "P12_closer", "P17_lists")
    skeleton_check: str = "O3_skeleton"
    skeleton_jury: bool = True
    never_alone: tuple[str, ...] = ("P14_dashes",)
    rejections: int = 2  # of a dimension before it is not available, or a hold
    not_available: int = 2  # dimensions before the user is asked
    split_logged_at: int = 2
    persona: str = "persona_fit"
    regressions: int = 2
    overlap_checks: tuple[str, ...] = ("O1_ngram", "O5_published")
    overlap_rewrites: int = 2


GATING = ("hard", "soft", "flag")
# Words that pull a text in opposite directions.
OPPOSITE = (
    (r"\bshort(?:er|en|ened|ening)?\b|\btighten\b|\btrim\b", r"\blong(?:er)?\b|\blengthen\b|\bexpand\b|\bextend\b"),
    (r"\bcut(?:s|ting)?\b|\bdelete\b|\bdrop\b", r"\badd(?:s|ed|ing)?\b|\binsert\b"),
    (r"\bremov(?:e|es|ed|ing)\b|\bstrip\b", r"\bkeep(?:s|ing)?\b|\bretain\b|\bleave\b"),
    (r"\bmore\b", r"\bless\b|\bfewer\b"),
)


def needs_action(passed: Column, class_: Column, flag: Column) -> Column:
    """FLT-02: it fails, or it is a flag that is up."""
    return ~F.coalesce(passed, F.lit(True)) | (F.coalesce(class_ == "flag", F.lit(False)) & F.coalesce(flag, F.lit(False)))


def median(votes: Column) -> Column:
    """Of an array of numbers; null of none."""
    v, n = F.array_sort(votes), F.size(votes)
    return F.when(n > 0, (F.try_element_at(v, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(v, F.floor(n / 2 + 1).cast("int"))) / 2)


def spread(votes: Column) -> Column:
    return F.coalesce(F.array_max(votes) - F.array_min(votes), F.lit(0))


def by_dimension(judgements: DataFrame) -> DataFrame:
    """(cid, dimension, n_files, votes, entries): the number of the jury's rows, the scores that they accepted, in order, and the judge's rows. Dimensions may be checks."""
    vote = F.when(F.col("jury") & (F.col("outcome") == "scored"), F.struct("place", "score"))
    entry = F.when(~F.col("jury"), F.struct("rerun", "place", "outcome", "score", F.coalesce("confirm", F.lit(False)).alias("confirm")))
    # Dealt by candidate at once, all that follows is grouped and joined where it lies.
    rows = judgements.repartition("cid").groupBy("cid", "dimension")
    rows = rows.agg(F.count_if("jury").alias("n_files"), F.array_sort(F.collect_list(vote)).alias("v"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select("cid", "dimension", "n_files", F.transform("v", lambda x: x["score"].cast("double")).alias("votes"), "entries")


def acting(policy: Policy) -> Column:
    """Of a check row what tier0 needs, null if it asks for no action."""
    raised = F.coalesce(F.col("pass"), F.lit(True)) & F.coalesce(F.col("flag"), F.lit(False))
    fields = F.col("place"), F.col("check_id"), F.coalesce("class", F.lit("advisory")).alias("class"), raised.alias("raised")
    allowed, waived = F.coalesce(F.col("jury_override_allowed"), F.lit(True)), F.coalesce("waived", F.lit(False))
    return F.when(needs_action(F.col("pass"), F.col("class"), F.col("flag")), F.struct(*fields, allowed.alias("allowed"), waived.alias("waived")))


def tier0(acts: Column, juries: Column, same_post: Column, policy: Policy) -> Column:
    """A candidate's check rows that ask for action, with unmet (a jury is waited for), split, and list: hard, soft, flag or advisory; null where a jury, a comparison or a waiver has settled it."""

    def of(x: Column) -> Column:
        check, class_ = x["check_id"], x["class"]
        jury = F.try_element_at(F.filter(juries, lambda j: j["dimension"] == check), F.lit(1))
        told = (check == policy.skeleton_check) & same_post.isNotNull()
        skeleton = (check == policy.skeleton_check) & (class_ == "flag")
        needs = (check.isin(*policy.false_positive_checks) & x["allowed"] & class_.isin(*GATING) & ~x["raised"]) | (skeleton & F.lit(policy.skeleton_jury))
        needs &= ~told
        votes = F.slice(F.coalesce(jury["votes"], F.array().cast("array<double>")), 1, policy.jury_size)
        met = F.coalesce(jury["n_files"], F.lit(0)) >= policy.jury_size
        cleared = (needs & met & (F.size(votes) > 0) & (median(votes) >= policy.override_threshold)) | (told & ~F.coalesce(same_post, F.lit(True)))
        waived = x["waived"] & class_.isin("flag", "soft")
        where = F.when(~F.coalesce(cleared, F.lit(False)) & ~waived, F.when(class_.isin(*GATING), class_).otherwise("advisory"))
        return F.struct(check.alias("check_id"), where.alias("list"), (needs & ~met).alias("unmet"), F.when(needs & met, spread(votes)).otherwise(0.0).alias("split"))

    return F.transform(acts, of)


def tier1(judged: DataFrame, dims: DataFrame, policy: Policy) -> DataFrame:
    """(cid, dimension, n_files, votes, class, result, score, pending, declared, rejected_out, split, confirm) of what by_dimension gives for candidates, with their expected_na and lens_free; class and result are null of what is no dimension.

    Of the judge's rows, first those of no rerun, the first acceptable one counts; rejections before it are counted, and so is a hard dimension that is
    not available unasked. A hard score at the trigger, a soft one just below its threshold and a hold call a jury, whose median decides.
    """
    rows = judged.join(F.broadcast(dims), "dimension", "left")
    expected = F.coalesce(F.array_contains("expected_na", F.col("dimension")), F.lit(False))
    usable = lambda e: (e["outcome"] == "scored") | ((e["outcome"] == "na") & ((F.col("class") != "hard") | expected))
    rows = rows.withColumn("taken", F.try_element_at(F.filter("entries", usable), F.lit(1)))
    before = F.filter("entries", lambda e: ~usable(e) & (F.col("taken").isNull() | (F.struct(e["rerun"], e["place"]) < F.struct(F.col("taken.rerun"), F.col("taken.place")))))
    rows = rows.withColumn("n_rejected", F.size(before))
    gating, score, special = F.col("class").isin("hard", "soft"), F.when(F.col("taken.outcome") == "scored", F.col("taken.score")), F.col("class") == "special"
    out_by_rejection = F.col("taken").isNull() & (F.col("n_rejected") >= policy.rejections)
    hold = out_by_rejection & (F.col("class") == "hard")
    trigger = hold | ((F.col("class") == "hard") & (score == policy.hard_trigger)) | ((F.col("class") == "soft") & (score == F.col("threshold") - 1))
    excused = F.col("lens_free") & F.col("lens_free_na") & ~special & F.coalesce((F.col("taken.outcome") == "scored") | (F.col("taken").isNull() & (F.col("n_rejected") == 0)), F.lit(False))
    trigger = F.coalesce(trigger, F.lit(False)) & ~special & ~excused
    fresh = F.when(hold, policy.jury_size).otherwise(policy.jury_size - 1)
    met = F.col("n_files") >= fresh
    ballot = F.slice("votes", F.lit(1), fresh)
    full = F.when(hold, ballot).otherwise(F.concat(F.array(score.cast("double")), ballot))
    decided = trigger & met & (F.size(ballot) > 0)
    mark = F.when(decided, median(full)).otherwise(score.cast("double"))
    result = (
        F.when(special, F.when(F.col("taken.outcome") == "na", "na").otherwise("claims"))
        .when(excused | (F.col("taken.outcome") == "na"), "na")
        .when(hold & ~met, "hold")
        .when(hold & ~decided, "unscored")
        .when(mark >= F.col("threshold"), "pass")
        .when(mark < F.col("threshold"), "fail")
        .when(out_by_rejection, "na")
        .otherwise("unscored")
    )
    waits = (trigger & ~met) | (F.col("taken").isNull() & (F.col("n_rejected") < policy.rejections) & gating & ~excused)
    declared = (F.col("taken.outcome") == "na") & ~expected & (special | ~F.col("may_be_na"))
    asked = lambda c: F.when(F.col("asked"), c)
    return rows.select(
        "cid",
        "dimension",
        "n_files",
        "votes",
        "class",
        asked(result).alias("result"),
        asked(mark).alias("score"),
        asked(waits & ~special).alias("pending"),
        asked(F.coalesce(declared, F.lit(False))).alias("declared"),
        asked(out_by_rejection & ~hold & ~special).alias("rejected_out"),
        asked(hold & met & ~decided).alias("without_evidence"),
        asked(F.when(decided, spread(full)).otherwise(0.0)).alias("split"),
        asked(F.coalesce("taken.confirm", F.lit(False))).alias("confirm"),
    )


def merge(checks: DataFrame, judgements: DataFrame, thresholds: DataFrame, tier2: DataFrame, candidates: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """AG-18, FLT-07: (cid, status, hard_fails, soft_fails, flags, advisory, waiting_on, unscored, not_available, splits).

    checks: cid, place, check_id, class, pass, flag, jury_override_allowed (null: yes), waived. judgements: cid, dimension (or check), jury, rerun, place
    (its order), outcome (scored, na or rejected), score, confirm (asks the user something). thresholds: dimension, class (hard, soft, advisory or
    special), threshold, may_be_na, and lens_free_na if some dimensions don't apply to candidates without a lens. tier2: cid, kind, fail, same_post. candidates:
    cid, expected_na (array) and perhaps lens_free; by default those of checks, with none expected.

    Status, the first that holds: hold (a jury, a judge or a rerun is waited for), needs_your_call (a hold that the jury could not settle, or two dimensions
    not available), pass (nothing fails and no flag is up), needs_your_call (the persona alone fails and something is to be confirmed), fail. A candidate
    with a hard check failing and no judge row is not judged at all. Where nothing but checks that never gate alone is left over all tiers, they are advice.

    Each input is read once and brought to one row for a candidate; no row is made for a dimension that a candidate has no judge row of.
    """
    none = F.array().cast("array<string>")
    judged = by_dimension(judgements)
    base = checks.groupBy("cid").agg(F.array_sort(F.collect_list(acting(policy))).alias("acts"))
    if candidates is None:
        base, judged = (x.withColumns({"expected_na": none, "lens_free": F.lit(False)}) for x in (base, judged))
    else:
        free = F.coalesce("lens_free", F.lit(False)) if "lens_free" in candidates.columns else F.lit(False)
        candidates = candidates.select("cid", "expected_na", free.alias("lens_free"))
        base, judged = candidates.join(base, "cid", "left"), judged.join(candidates, "cid")
    lens_free_na = F.coalesce("lens_free_na", F.lit(False)) if "lens_free_na" in thresholds.columns else F.lit(False)
    dims = thresholds.select("dimension", "class", F.col("threshold").cast("double").alias("threshold"), F.coalesce("may_be_na", F.lit(False)).alias("may_be_na"), lens_free_na.alias("lens_free_na"), F.lit(True).alias("asked"))
    gates = F.col("class").isin("hard", "soft")
    awaited = dims.agg(F.collect_set(F.when(gates, F.col("dimension"))).alias("awaited"), F.collect_set(F.when(gates & ~F.col("lens_free_na"), F.col("dimension"))).alias("awaited_free"))

    told = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("dimension"))))
    fails, jurors = F.col("result") == "fail", F.struct("dimension", "n_files", "votes")
    second = tier1(judged, dims, policy).groupBy("cid").agg(
        F.collect_set("dimension").alias("seen"),
        F.collect_list(F.when(F.col("dimension").isin(*policy.false_positive_checks, policy.skeleton_check), jurors)).alias("juries"),
        told(fails & (F.col("class") == "hard")).alias("t1_hard"),
        told(fails & (F.col("class") == "soft")).alias("t1_soft"),
        told(F.col("pending")).alias("t1_waits"),
        told(F.col("without_evidence")).alias("unscored"),
        F.count_if(F.col("declared") | F.col("rejected_out")).alias("not_available"),
        F.count_if(F.col("split") >= policy.split_logged_at).alias("t1_splits"),
        F.max("confirm").alias("confirm"),
    )
    third = tier2.where(F.col("fail") | F.col("same_post").isNotNull()).groupBy("cid").agg(F.max("same_post").alias("same_post"), F.array_sort(F.collect_set(F.when(F.col("fail"), F.col("kind")))).alias("t2_hard"))

    rows = base.join(second, "cid", "left").join(third, "cid", "left").crossJoin(F.broadcast(awaited))
    # Like the joins, nothing holds of a candidate without an id.
    rows = rows.withColumn("t0", F.when(F.col("cid").isNotNull(), tier0(F.col("acts"), F.col("juries"), F.col("same_post"), policy)))
    in_list = lambda name: F.transform(F.filter("t0", lambda x: x["list"] == name), lambda x: x["check_id"])
    rows = rows.withColumns({f"t0_{c}": in_list(c) for c in (*GATING, "advisory")})
    skipped = F.col("cid").isNull() | (F.col("seen").isNull() & (F.coalesce(F.size("t0_hard"), F.lit(0)) > 0))
    missing = F.array_except(F.when(F.col("lens_free"), F.col("awaited_free")).otherwise(F.col("awaited")), F.coalesce("seen", none))
    rows = rows.withColumns(
        {
            "t0_waits": F.transform(F.filter("t0", lambda x: x["unmet"]), lambda x: F.concat(F.lit("jury:"), x["check_id"])),
            "t0_splits": F.size(F.filter("t0", lambda x: x["split"] >= policy.split_logged_at)),
            "t1_waits": F.when(~skipped, F.concat(F.coalesce("t1_waits", none), missing)),
        }
    )
    lists = ("t0_hard", "t0_soft", "t0_flag", "t0_advisory", "t0_waits", "t1_hard", "t1_soft", "t1_waits", "unscored", "t2_hard")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in lists} | {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("t0_splits", "t1_splits", "not_available")})
    gating = F.concat("t0_hard", "t0_soft", "t0_flag", "t1_hard", "t1_soft", "t2_hard")
    alone = (F.size(gating) > 0) & (F.size(F.array_except(gating, F.array(*map(F.lit, policy.never_alone)))) == 0)
    rows = rows.withColumn("alone", alone)
    cut = lambda c: F.when(F.col("alone"), none).otherwise(F.col(c))
    rows = rows.withColumns(
        {
            "hard_fails": F.concat(cut("t0_hard"), "t1_hard", "t2_hard"),
            "soft_fails": F.concat(cut("t0_soft"), "t1_soft"),
            "flags": cut("t0_flag"),
            "advisory": F.when(F.col("alone"), F.concat("t0_advisory", "t0_hard", "t0_soft", "t0_flag")).otherwise(F.col("t0_advisory")),
            "waiting_on": F.array_sort(F.array_distinct(F.concat("t0_waits", "t1_waits"))),
        }
    )
    all_ = F.concat("hard_fails", "soft_fails", "flags")
    persona = F.array_contains("hard_fails", policy.persona) & (F.size(F.array_remove(all_, policy.persona)) == 0) & F.coalesce("confirm", F.lit(False))
    status = (
        F.when(F.size("waiting_on") > 0, "hold")
        .when((F.size("unscored") > 0) | (F.col("not_available") >= policy.not_available), "needs_your_call")
        .when(F.size(all_) == 0, "pass")
        .when(persona, "needs_your_call")
        .otherwise("fail")
    )
    return rows.select("cid", status.alias("status"), "hard_fails", "soft_fails", "flags", "advisory", "waiting_on", "unscored", "not_available", (F.col("t0_splits") + F.col("t1_splits")).alias("splits"))


def fixes_conflict(one: Column, two: Column) -> Column:
    """Whether two fixes pull in opposite directions: each holds one word of a pair, and the later one not both."""
    has = lambda c, p: F.lower(c).rlike(p)
    either = [(has(one, x) & has(two, y) & ~has(two, x)) | (has(one, y) & has(two, x) & ~has(two, y)) for x, y in OPPOSITE]
    return F.coalesce(reduce(Column.__or__, either), F.lit(False))


def stops(gates: DataFrame, resolved: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """2.11.3, step 8: (cid, round, reason, drop, gates, revert_round) of the rounds in which a candidate's rewriting stops, for the first reason of its order.

    gates: cid, round, id, tier (0 or 1), class, result (pass, fail or another), pending (its jury has not voted), overridden (a jury let it pass), cleared
    (waived or addressed), fix, contradicts. A hard gate that failed after it passed in the round before is an event. Two events so far are a regression,
    one now is a spent gate, with the gates and the round to go back to. An overlap check that failed in three rounds in a row is persistent. A dimension
    that failed twice in a row with opposite fixes is an oscillation, unless resolved (cid, round) has an answer. Regression and overlap drop the candidate.
    """
    rounds = gates.select("cid", "round").distinct().withColumn("before", F.lag("round").over(Window.partitionBy("cid").orderBy("round")))
    last = gates.select(*(F.col(c).alias(f"last_{c}") if c not in ("cid", "id") else c for c in ("cid", "round", "id", "class", "result", "overridden", "fix")))
    rows = gates.join(rounds, ["cid", "round"]).join(last.withColumnRenamed("last_round", "before"), ["cid", "before", "id"], "left")
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    failed = (F.col("result") == "fail") & ~truth("pending")
    flip = (F.col("class") == "hard") & failed & ~truth("cleared") & (F.col("last_class") == "hard") & (F.col("last_result") == "pass") & ~truth("last_overridden")
    turned = (F.col("tier") == 1) & failed & (F.col("last_result") == "fail") & (truth("contradicts") | fixes_conflict(F.col("last_fix"), F.col("fix")))
    overlap = lambda name: F.max(F.when(F.col("id") == name, (F.col("result") == "fail") & ~truth("cleared")))
    streaks = {f"overlap{k}": F.coalesce(overlap(name), F.lit(False)).alias(f"overlap{k}") for k, name in enumerate(policy.overlap_checks)}
    told = rows.groupBy("cid", "round").agg(F.max("before").alias("before"), F.array_sort(F.collect_set(F.when(flip, F.col("id")))).alias("flips"), F.max(F.coalesce(turned, F.lit(False))).alias("turned"), *streaks.values())
    if resolved is not None:
        told = told.join(resolved.select("cid", "round").distinct().withColumn("answered", F.lit(True)), ["cid", "round"], "left").withColumn("turned", F.col("turned") & F.col("answered").isNull()).drop("answered")
    by = Window.partitionBy("cid").orderBy("round")
    needed = policy.overlap_rewrites + 1
    told = told.withColumn("events", F.sum(F.size("flips")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    recent = by.rowsBetween(-(needed - 1), 0)
    persistent = reduce(Column.__or__, [(F.count_if(c).over(recent) == needed) for c in streaks], F.lit(False))
    told = told.withColumn("persistent", persistent)
    reason = F.when((F.col("events") >= policy.regressions) & F.col("before").isNotNull(), "regression").when(F.col("persistent"), "overlap_persistent").when(F.col("turned"), "oscillation").when(F.size("flips") > 0, "spent_gate")
    spent = F.col("reason") == "spent_gate"
    out = told.withColumn("reason", reason).where("reason is not null")
    return out.select("cid", "round", "reason", F.col("reason").isin("regression", "overlap_persistent").alias("drop"), F.when(spent, F.col("flips")).alias("gates"), F.when(spent, F.col("before")).alias("revert_round"))
