"""Verdicts and stops on hand-made rows, one for each rule."""

import random

import duckdb
import pytest

from corpusloom.operators import verdict
from corpusloom.plans import catalog

CHECK = "cid string, place int, check_id string, class string, pass boolean, flag boolean, jury_override_allowed boolean, waived boolean"
JUDGE = "cid string, dimension string, jury boolean, rerun boolean, place long, outcome string, score int, confirm boolean"
LIMITS = [("voice", "hard", 4.0, False, False), ("persona_fit", "hard", 4.0, False, False), ("humor", "soft", 4.0, True, False), ("depth", "soft", 4.0, False, True), ("taste", "advisory", 4.0, False, False), ("claims", "special", None, False, False)]
GOOD = {"voice": 5, "persona_fit": 5, "humor": 4, "depth": 5, "taste": 2, "claims": 5}


def row(check, class_, ok=False, flag=False, allowed=None, waived=None):
    return check, class_, ok, flag, allowed, waived


@pytest.fixture(scope="module")
def cases():
    """name -> (checks, judge rows (dimension, outcome or score, jury, rerun, confirm), tier 2, expected na, lens free, what comes out)."""
    good = [(d, s) for d, s in GOOD.items()]
    less = lambda *names: [x for x in good if x[0] not in names]
    jury = lambda d, *votes: [(d, v, True) for v in votes]
    return {
        "pass": ([row("P1_length", "hard", True)], good, [], [], False, ("pass", [], [], [])),
        "flag blocks": ([row("O4_sibling", "flag")], good, [], [], False, ("fail", [], [], ["O4_sibling"])),
        "raised flag": ([row("P2_fold", "flag", True, True)], good, [], [], False, ("fail", [], [], ["P2_fold"])),
        "raised soft passes": ([row("P2_fold", "soft", True, True)], good, [], [], False, ("pass", [], [], [])),
        "waived flag": ([row("O4_sibling", "flag", waived=True)], good, [], [], False, ("pass", [], [], [])),
        "waived hard stands": ([row("P1_length", "hard", waived=True)], good, [], [], False, ("fail", ["P1_length"], [], [])),
        "soft below threshold": ([], [*less("humor"), ("humor", 3)], [], [], False, ("hold", [], ["humor"], [])),
        "soft far below": ([], [*less("humor"), ("humor", 2)], [], [], False, ("fail", [], ["humor"], [])),
        "jury clears": ([], [*less("humor"), ("humor", 3), *jury("humor", 4, 5)], [], [], False, ("pass", [], [], [])),
        "jury confirms": ([], [*less("humor"), ("humor", 3), *jury("humor", 3, 5, 5)], [], [], False, ("fail", [], ["humor"], [])),
        "jury without votes": ([], [*less("humor"), ("humor", 3), *jury("humor", "na", "rejected")], [], [], False, ("fail", [], ["humor"], [])),
        "vote of its own no reason": ([], [*good, *jury("voice", 1, 1)], [], [], False, ("pass", [], [], [])),
        "hard three": ([], [*less("voice"), ("voice", 3)], [], [], False, ("hold", ["voice"], [], [])),
        "hard two": ([], [*less("voice"), ("voice", 2)], [], [], False, ("fail", ["voice"], [], [])),
        "pending": ([], less("voice"), [], [], False, ("hold", [], [], [])),
        "advisory not awaited": ([], less("taste"), [], [], False, ("pass", [], [], [])),
        "rerun pending": ([], [*less("voice"), ("voice", "rejected")], [], [], False, ("hold", [], [], [])),
        "rerun counts": ([], [*less("voice"), ("voice", 5, False, True), ("voice", "rejected")], [], [], False, ("pass", [], [], [])),
        "hard hold": ([], [*less("voice"), ("voice", "rejected"), ("voice", "rejected", False, True)], [], [], False, ("hold", [], [], [])),
        "hold settled": ([], [*less("voice"), ("voice", "rejected"), ("voice", "na", False, True), *jury("voice", 5, 4, 4)], [], [], False, ("pass", [], [], [])),
        "hold lost": ([], [*less("voice"), ("voice", "na"), ("voice", "na", False, True), *jury("voice", 5, 3, 3)], [], [], False, ("fail", ["voice"], [], [])),
        "hold without evidence": ([], [*less("voice"), ("voice", "rejected"), ("voice", "rejected"), *jury("voice", "na", "na", "na")], [], [], False, ("needs_your_call", [], [], [])),
        "one soft gone": ([], [*less("depth"), ("depth", "rejected"), ("depth", "rejected")], [], [], False, ("pass", [], [], [])),
        "two gone": ([], [*less("depth", "taste"), ("depth", "rejected"), ("depth", "rejected"), ("taste", "na")], [], [], False, ("needs_your_call", [], [], [])),
        "na that may be": ([], [*less("humor", "depth"), ("humor", "na"), ("depth", "na")], [], [], False, ("pass", [], [], [])),
        "expected na": ([], [*less("voice", "depth", "taste"), ("voice", "na"), ("depth", "na"), ("taste", "na")], [], ["voice", "depth", "taste"], False, ("pass", [], [], [])),
        "lens free": ([], [*less("depth"), ("depth", 1)], [], [], True, ("pass", [], [], [])),
        "hard check unjudged": ([row("P1_length", "hard")], [], [], [], False, ("fail", ["P1_length"], [], [])),
        "soft check unjudged": ([row("P6_emoji", "soft")], [], [], [], False, ("hold", [], ["P6_emoji"], [])),
        "override": ([row("P8_opener", "hard")], [*good, *jury("P8_opener", 5, 4, 1)], [], [], False, ("pass", [], [], [])),
        "override waits": ([row("P8_opener", "hard")], [*good, *jury("P8_opener", 5, 4)], [], [], False, ("hold", ["P8_opener"], [], [])),
        "override refused": ([row("P8_opener", "hard", allowed=False)], good, [], [], False, ("fail", ["P8_opener"], [], [])),
        "override lost": ([row("P8_opener", "hard")], [*good, *jury("P8_opener", 3, 4, 1)], [], [], False, ("fail", ["P8_opener"], [], [])),
        "skeleton waits": ([row("O3_skeleton", "flag")], good, [], [], False, ("hold", [], [], ["O3_skeleton"])),
        "skeleton cleared": ([row("O3_skeleton", "flag")], good, [("pairwise", False, False)], [], False, ("pass", [], [], [])),
        "skeleton confirmed": ([row("O3_skeleton", "flag")], good, [("paraphrase", True, True)], [], False, ("fail", ["paraphrase"], [], ["O3_skeleton"])),
        "dashes alone": ([row("P14_dashes", "soft")], good, [], [], False, ("pass", [], [], [])),
        "dashes beside a flag": ([row("P14_dashes", "soft"), row("O4_sibling", "flag")], good, [], [], False, ("fail", [], ["P14_dashes"], ["O4_sibling"])),
        "dashes beside a judge": ([row("P14_dashes", "soft")], [*less("humor"), ("humor", 1)], [], [], False, ("fail", [], ["P14_dashes", "humor"], [])),
        "dashes beside a line-up": ([row("P14_dashes", "soft")], good, [("lineup", True, None)], [], False, ("fail", ["lineup"], ["P14_dashes"], [])),
        "persona to confirm": ([], [*less("persona_fit"), ("persona_fit", 1, False, False, True)], [], [], False, ("needs_your_call", ["persona_fit"], [], [])),
        "persona not alone": ([], [*less("persona_fit", "humor"), ("persona_fit", 1, False, False, True), ("humor", 1)], [], [], False, ("fail", ["persona_fit"], ["humor"], [])),
        "persona with nothing to confirm": ([], [*less("persona_fit"), ("persona_fit", 1)], [], [], False, ("fail", ["persona_fit"], [], [])),
        "claims": ([], good, [("claims", True, None)], [], False, ("fail", ["claims"], [], [])),
    }


def test_every_status(spark, cases):
    checks, judged, compared, people = [], [], [], []
    for cid, (c, j, t, na, free, _) in cases.items():
        checks += [(cid, k, *x[:4], *x[4:]) for k, x in enumerate(c)]
        for k, (dim, mark, *rest) in enumerate(j):
            is_jury, rerun, confirm = (*rest, False, False, False)[:3] if len(rest) < 3 else rest
            judged.append((cid, dim, is_jury, rerun, k, mark if isinstance(mark, str) else "scored", mark if isinstance(mark, int) else None, confirm))
        compared += [(cid, *x) for x in t]
        people.append((cid, na, free))
    found = verdict.merge(
        spark.createDataFrame(checks, CHECK),
        spark.createDataFrame(judged, JUDGE),
        spark.createDataFrame(LIMITS, "dimension string, class string, threshold double, may_be_na boolean, lens_free_na boolean"),
        spark.createDataFrame(compared, "cid string, kind string, fail boolean, same_post boolean"),
        spark.createDataFrame(people, "cid string, expected_na array<string>, lens_free boolean"),
    )
    got = {r.cid: (r.status, r.hard_fails, r.soft_fails, r.flags) for r in found.collect()}
    assert got == {cid: x[5] for cid, x in cases.items()}
    extra = {r.cid: (r.advisory, r.waiting_on, r.splits) for r in found.collect()}
    assert extra["dashes alone"][0] == ["P14_dashes"] and extra["override waits"][1] == ["jury:P8_opener"] and extra["hold lost"][2] == 1 and extra["jury clears"][2] == 1


def test_many_dimensions_are_all_asked(spark):
    limits = spark.createDataFrame([(f"d{k:04}", "soft", 4.0, False, False) for k in range(1500)], "dimension string, class string, threshold double, may_be_na boolean, lens_free_na boolean")
    judged = spark.createDataFrame([("a", f"d{k:04}", False, False, k, "scored", 1 if k == 1499 else 5, False) for k in range(1500)], JUDGE)
    none = spark.createDataFrame([], "cid string, kind string, fail boolean, same_post boolean")
    out = verdict.merge(spark.createDataFrame([("a", 0, "P1_length", "hard", True, False, None, None)], CHECK), judged, limits, none).first()
    assert (out.status, out.soft_fails) == ("fail", ["d1499"])


def gate(cid, k, id_, result, class_="hard", tier=0, **more):
    return cid, k, id_, tier, class_, result, more.get("pending"), more.get("overridden"), more.get("cleared"), more.get("fix"), more.get("contradicts")


def test_stops(spark):
    rows = [
        gate("spent", 1, "P1", "pass"), gate("spent", 2, "P1", "fail"), gate("spent", 3, "P1", "fail"),
        gate("again", 1, "P1", "pass"), gate("again", 2, "P1", "fail"), gate("again", 3, "P1", "pass"), gate("again", 4, "P1", "fail"),
        gate("two", 1, "P1", "pass"), gate("two", 1, "v", "pass", tier=1), gate("two", 3, "P1", "fail"), gate("two", 3, "v", "fail", tier=1),
        gate("soft", 1, "P6", "pass", "soft"), gate("soft", 2, "P6", "fail", "soft"), gate("waits", 1, "v", "pass", tier=1), gate("waits", 2, "v", "fail", tier=1, pending=True),
        gate("over", 1, "P8", "pass", overridden=True), gate("over", 2, "P8", "fail"), gate("new", 1, "P1", "pass"), gate("new", 2, "P2", "fail"),
        *(gate("overlap", k, "O1_ngram", "fail", "flag") for k in (1, 2, 3)), *(gate("short", k, "O1_ngram", "fail", "flag") for k in (1, 2)),
        *(gate("broken", k, "O5_published", "fail", "flag", cleared=k == 2) for k in (1, 2, 3)),
        gate("turn", 1, "humor", "fail", "soft", 1, fix="Make it shorter"), gate("turn", 2, "humor", "fail", "soft", 1, fix="Expand the middle"),
        gate("same", 1, "humor", "fail", "soft", 1, fix="Cut a line"), gate("same", 2, "humor", "fail", "soft", 1, fix="cut or add a line"),
        gate("said", 1, "humor", "fail", "soft", 1), gate("said", 2, "humor", "fail", "soft", 1, contradicts=True), gate("said", 3, "humor", "pass", "soft", 1),
    ]
    df = spark.createDataFrame(rows, "cid string, round int, id string, tier int, class string, result string, pending boolean, overridden boolean, cleared boolean, fix string, contradicts boolean")
    found = {(r.cid, r["round"]): (r.reason, r.drop, r.gates, r.revert_round) for r in verdict.stops(df).collect()}
    assert found == {
        ("spent", 2): ("spent_gate", False, ["P1"], 1),
        ("again", 2): ("spent_gate", False, ["P1"], 1),
        ("again", 4): ("regression", True, None, None),
        ("two", 3): ("regression", True, None, None),
        ("overlap", 3): ("overlap_persistent", True, None, None),
        ("turn", 2): ("oscillation", False, None, None),
        ("said", 2): ("oscillation", False, None, None),
    }
    answered = spark.createDataFrame([("turn", 2), ("overlap", 3)], "cid string, round int")
    assert {k for k in found} - {(r.cid, r["round"]) for r in verdict.stops(df, answered).collect()} == {("turn", 2)}


def test_merge_reads_each_table_once(spark):
    """Lines, events and orders are each dealt by candidate once, the large ones are not read again, and no row is made for each candidate and dimension."""
    run = catalog.queries()["merged_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    tables = [x for x in run.optimizedPlan().toString().splitlines() if "Relation [" in x]
    assert {c: sum(c in x for x in tables) for c in ("l_orderkey", "o_orderkey")} == {"l_orderkey": 1, "o_orderkey": 1} and sum("event_id" in x for x in tables) <= 3
    plan = run.executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cid") == 3 and "Generate" not in plan and "SortAggregate" not in plan


def test_merged_verdicts_of_odd_rows(spark, tmp_path):
    """The query against its SQL on other letters and none, lines of one number, orders without lines and lines without orders."""
    r = random.Random(6)
    lines = [(k, n, r.choice([*"ANRZBa", None]), r.choice([5.0, 12.0, 13.0, 40.0]), r.choice([0.0, 0.08, 0.1]), r.choice([0.0, 0.01, 0.05])) for k in range(1, 400) if k % 9 for n in range(1, r.randint(2, 8)) for _ in range(r.choice([1, 1, 2]))]
    orders = [(k, r.random() * 100, r.choice(["1-URGENT", "5-LOW"])) for k in range(1, 400) if k % 7]
    events = [(k, r.randint(0, 50), r.choice(["view", "click", "error"])) for k in range(2500)]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double, l_tax double"),
        ("orders", orders, "o_orderkey long, o_totalprice double, o_orderpriority string"),
        ("events", events, "event_id long, user_id long, event_type string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    for name in ("lineitem", "orders", "events"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.execute(catalog.oracle_sql()["merged_verdicts"]).fetchall()
    found = catalog.queries()["merged_verdicts"](spark, str(tmp_path)).collect()
    assert len(found) > 300 and sorted(map(tuple, found)) == sorted(want)


def test_dimensions_without_judge_rows(spark):
    """They are awaited where they gate, unless the candidate needs no lens; a row without a side counts for nothing, and nothing holds of a candidate without an id."""
    limits = spark.createDataFrame(LIMITS, "dimension string, class string, threshold double, may_be_na boolean, lens_free_na boolean")
    judged = [(c, d, False, False, 0, "scored", s, False) for c in ("free", "bound", "sideless") for d, s in GOOD.items() if d != "depth"] + [("sideless", "depth", None, False, 1, "scored", 5, False)]
    people = [("free", [], True), ("bound", [], False), ("sideless", None, False), ("alone", [], True), (None, [], False)]
    checks = [("free", 0, "P6_emoji", "soft", True, False, None, None), (None, 0, "P1_length", "hard", False, False, None, None)]
    none = spark.createDataFrame([], "cid string, kind string, fail boolean, same_post boolean")
    found = verdict.merge(spark.createDataFrame(checks, CHECK), spark.createDataFrame(judged, JUDGE), limits, none, spark.createDataFrame(people, "cid string, expected_na array<string>, lens_free boolean"))
    got = {x.cid: (x.status, x.waiting_on, x.hard_fails) for x in found.collect()}
    assert got == {"free": ("pass", [], []), "bound": ("hold", ["depth"], []), "sideless": ("hold", ["depth"], []), "alone": ("hold", ["humor", "persona_fit", "voice"], []), None: ("pass", [], [])}
