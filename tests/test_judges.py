"""Judge files with one fault each, and quotes against difflib's own windows."""

import json
import random
from difflib import SequenceMatcher

from corpusloom.operators import judges, verdict

TEXT = "We cut the build time by 40% in March. Then we wrote it down, “for the others” to read."
LIMITS = [("voice", "voice"), ("tone", "voice"), ("humor", "comedy"), ("claims", "reader"), ("media", "media")]


def good(**more):
    return {"score": 4, "evidence": [{"quote": "cut the build time", "why": "x"}]} | more


def file(dims, lens="voice", **more):
    return {"schema": "any.judge/1", "rubric_version": "v2", "lens": lens, "dimensions": dims} | more


def test_each_rejection(spark):
    two = lambda d, **more: file({"voice": d, "tone": good()}, **more)
    cases = {
        "fine": (two(good()), ("scored", 4, None)),
        "float": (two(good(score=4.0)), ("scored", 4, None)),
        "half": (two(good(score=4.5)), ("rejected", None, "score must be an integer 1-5")),
        "text": (two(good(score="4")), ("rejected", None, "score must be an integer 1-5")),
        "bool": (two(good(score=True)), ("rejected", None, "score must be an integer 1-5")),
        "six": (two(good(score=6)), ("rejected", None, "score must be an integer 1-5")),
        "none": (two({"evidence": ["cut"]}), ("rejected", None, "score must be an integer 1-5")),
        "na": (two({"na": True, "pre_step": "no lens"}), ("na", None, None)),
        "na bare": (two({"na": True, "pre_step": " "}), ("rejected", None, "na without a reason")),
        "no quote": (two(good(evidence=[])), ("rejected", None, "no evidence quote")),
        "not a list": (two(good(evidence="cut")), ("rejected", None, "no evidence quote")),
        "made up": (two(good(evidence=["we doubled our revenue in one year"])), ("rejected", None, "no quote is in the text")),
        "one of two": (two(good(evidence=["we doubled our revenue", "THEN  we wrote it down, \"for the others\""])), ("scored", 4, None)),
        "near": (two(good(evidence=["Then we wrot it down, for the others to read"])), ("scored", 4, None)),
        "confirm": (two(good(needs_confirmation=[{"claim": "x"}])), ("scored", 4, None)),
        "confirm bad": (two(good(needs_confirmation="x")), ("rejected", None, "needs_confirmation must be a list of objects")),
        "no object": (two(7), ("rejected", None, "not an object")),
        "absent": (file({"tone": good()}), ("rejected", None, "missing")),
        "schema": (two(good(), schema="other/2"), ("rejected", None, "another schema")),
        "rubric": (two(good(), rubric_version="v1"), ("rejected", None, "another rubric version")),
        "empty": (file({}), ("rejected", None, "no dimensions")),
    }
    others = {
        "lens": two(good(), lens="poet"),
        "no json": "{",
        "list": [1],
        "foreign": file({"voice": good(), "tone": good(), "humor": good()}),
        "jury": file({"P8_opener": good(), "voice": good(), "odd": good()}, lens="comedy", jury=True),
        "rerun": file({"voice": good()}, lens="comedy", rerun_for="voice"),
        "claims": file({"claims": {"claims": [{"text": "a", "status": "wrong"}]}}, lens="reader"),
        "claims status": file({"claims": {"claims": [{"text": "a", "status": "maybe"}]}}, lens="reader"),
        "claims text": file({"claims": {"claims": [{"status": "wrong"}]}}, lens="reader"),
        "claims list": file({"claims": {"claims": 3}}, lens="reader"),
        "media": file({"media": {"sub_results": {"does_work": "pass"}, "pass": True}}, lens="media"),
        "media key": file({"media": {"sub_results": {"odd": 1}}}, lens="media"),
        "media pass": file({"media": {"pass": "yes"}}, lens="media"),
    }
    bodies = {k: c[0] for k, c in cases.items()} | others
    rows = [(k, f"{k}.json", 0, b if isinstance(b, str) else json.dumps(b), TEXT, "x") for k, b in bodies.items()] + [("null", "n.json", 0, None, TEXT, "x")]
    files = spark.createDataFrame(rows, "cid string, file string, place long, body string, text string, outcome string")
    limits = spark.createDataFrame(LIMITS, "dimension string, lens string")
    found = judges.judge_rows(files, limits, "v2")
    got = {}
    for r in found.collect():
        got.setdefault(r.cid, {})[r.dimension] = (r.outcome, r.score, r.reason)
    assert {k: got[k]["voice"] for k in cases} == {k: c[1] for k, c in cases.items()}
    assert got["lens"] == {"*": ("rejected", None, "unknown lens")} and {k: got[k]["*"][2] for k in ("no json", "list", "null")} == dict.fromkeys(("no json", "list", "null"), "not a JSON object")
    assert got["schema"].keys() == {"voice", "tone"} and got["foreign"]["humor"][2] == "not a dimension of the lens"
    assert {k: v[0] for k, v in got["jury"].items()} == {"P8_opener": "scored", "voice": "scored", "odd": "rejected"} and got["rerun"] == {"voice": ("scored", 4, None)}
    assert got["claims"]["claims"] == ("scored", None, None) and [got[k]["claims"][2] for k in ("claims status", "claims text", "claims list")] == ["unknown claim status", "a claim without a text", "claims must be a list"]
    assert [got[k]["media"][2] for k in ("media", "media key", "media pass")] == [None, "unknown media result", "media pass must be boolean"]
    assert {r.cid for r in found.where("confirm").collect()} == {"confirm"}
    plan = {r.cid: (r.rerun_lens, r.dimensions, r.whole, r.reasons) for r in judges.rerun_plan(found).collect()}
    assert plan["half"] == ("comedy", ["voice"], False, ["score must be an integer 1-5"]) and plan["schema"] == ("comedy", ["tone", "voice"], True, ["another schema"]) and plan["lens"][:3] == ("poet", [], True) and "fine" not in plan
    checks = spark.createDataFrame([(k, 0, "P1", "hard", True, False, None, None) for k in ("fine", "half")], "cid string, place int, check_id string, class string, pass boolean, flag boolean, jury_override_allowed boolean, waived boolean")
    policy = spark.createDataFrame([(d, "hard", 4.0, False) for d in ("voice", "tone")], "dimension string, class string, threshold double, may_be_na boolean")
    none = spark.createDataFrame([], "cid string, kind string, fail boolean, same_post boolean")
    assert {r.cid: r.status for r in verdict.merge(checks, found, policy, none).collect()} == {"fine": "pass", "half": "hold"}
    assert judges.judge_rows(files.limit(0), limits, "v2").collect() == []


def windows(quote, text):
    """The best of all windows that begin at a shared block, shifted by two at most."""
    n, best = len(quote), 0.0
    if n >= len(text):
        return SequenceMatcher(None, quote, text, autojunk=False).ratio()
    blocks = [b for b in SequenceMatcher(None, text, quote, autojunk=False).get_matching_blocks() if b.size]
    starts = {b.a - b.b + s for b in blocks for s in range(-2, 3)}
    for s in sorted(s for s in starts if 0 <= s <= len(text) - n) or [0]:
        best = max(best, SequenceMatcher(None, quote, text[s : s + n], autojunk=False).ratio())
    return best


def test_quotes_as_difflib_has_them(spark):
    r = random.Random(2)
    rows = [("", TEXT), (None, TEXT), ("x", None), ("“for the others”", TEXT), ("the build  TIME by 40%", TEXT), ("nothing alike at all here", TEXT), (TEXT + " and more", TEXT)]
    for _ in range(150):
        text = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "we", "cut", "it"]) for _ in range(r.randint(1, 40)))
        at = r.randrange(len(text))
        quote = list(text[at : at + r.randint(5, 60)])
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(quote))
            quote[k : k + 1] = r.choice([[], ["z"], [quote[k], "q"]]) if len(quote) > 2 else quote[k : k + 1]
        rows.append(("".join(quote), text))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, q string, t string")
    found = {x.k: x.m for x in df.select("k", judges.quote_match("q", "t").alias("m")).collect()}
    assert found[1].match is None and found[2].match is None
    plain = lambda s: judges.match_form(s.replace("“", '"').replace("”", '"'))
    for k, (q, t) in enumerate(rows):
        if q is None or t is None:
            continue
        q, t = plain(q), plain(t)
        if q and q in t:
            assert tuple(found[k]) == ("exact", 1.0)
            continue
        best = windows(q, t) if q else 0.0
        assert tuple(found[k]) == (("fuzzy", round(best, 4)) if best >= 0.9 else ("none", None)), (q, t, best)
    assert {m.match for m in found.values()} == {"exact", "fuzzy", "none", None}
