"""The rule scan against one search for each rule."""

import random
import re

import pytest

from corpusloom.operators import scan, spans


def boundary(phrase):
    """The regular expression of a folded phrase."""
    body = r"\s+".join(map(re.escape, phrase.split()))
    return ("(?<![A-Za-z0-9])" if phrase.strip()[0].isalnum() else "") + body + ("(?![A-Za-z0-9])" if phrase.strip()[-1].isalnum() else "")


def brute(text, rules):
    """Hits by finditer in the folded text, with places mapped back."""
    t = scan.Text(text)
    lines, at = [], 0
    for line in t.folded.split("\n"):
        if line.strip():
            lines.append((at, at + len(line)))
        at += len(line) + 1
    out = []
    for r in rules:
        scope = r.get("scope", "text")
        if scope != "text" and not lines:
            continue
        low, high = {"text": (0, len(t.folded))}.get(scope) or (lines[0] if scope == "line1" else (lines[-2:][0][0], lines[-1][1]))
        rx = re.compile(r["pattern"] if r.get("pattern") else boundary("".join(scan.Text(r["phrase"]).folded)), re.I | re.M)
        if r.get("anchored"):
            while low < high and not t.folded[low].isalnum():
                low += 1
            found = [m for m in [rx.match(t.folded, low, high)] if m]
        else:
            found = rx.finditer(t.folded, low, high)
        for m in found:
            if m.end() > m.start():
                a, b = t.origin[m.start()], t.origin[m.end() - 1] + 1
                out.append((a, r.get("rank", 2), b, r["id"], text[a:b], r.get("group") or r["id"].split(".")[0], t.folded.count("\n", 0, m.start()) + 1))
    return sorted(out, key=lambda h: h[:4])


RULES = [
    {"id": "t1.a", "phrase": "in the end"}, {"id": "t1.b", "phrase": "the"}, {"id": "t2.c", "phrase": "it’s not", "rank": 1}, {"id": "t2.d", "phrase": "— so"},
    {"id": "t3.e", "phrase": "a a"}, {"id": "t3.f", "phrase": "End"}, {"id": "claude.g", "phrase": "the", "scope": "line1", "anchored": True, "rank": 0},
    {"id": "claude.h", "phrase": "in", "scope": "tail2"}, {"id": "P.i", "pattern": r"the \w+", "rank": 0}, {"id": "P.j", "pattern": r"^in\b.*$", "scope": "tail2"},
    {"id": "P.k", "pattern": r"x*"}, {"id": "P.l", "pattern": r"\w+", "scope": "line1", "anchored": True}, {"id": "Q", "phrase": "straße"}, {"id": "Q.2", "phrase": "ΣΑΣ"}, {"id": "t1.m", "phrase": "in the"},
]


def test_same_as_one_search_a_rule(spark):
    r = random.Random(4)
    words = ["In", "the", "THE", "end", "a", "it’s", "it's", "not", "—", "-", "so", "\n", "  ", " ", "ﬁn", "…", "“the”", "Straße", "STRASSE", "σας", "thex", "the_", "9the", "é", "\n\n", "xx"]
    texts = ["", None, "\n \n", "In the end, in  the\nend of the day", "a a a a", "🎉 The end"] + ["".join(r.choice(words) + r.choice([" ", " ", "", "\n"]) for _ in range(r.randint(1, 40))) for _ in range(500)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, text string, span string")
    table = scan.rules_table(spark, RULES)
    found = {x.id: x for x in scan.rule_hits(df, table).select("id", "hits", scan.leftmost("hits").alias("kept"), scan.tiers("hits").alias("tiers")).collect()}
    for k, t in enumerate(texts):
        want = brute(t, RULES) if t else []
        assert list(map(tuple, found[k].hits)) == want
        kept, end = [], -1
        for h in sorted(want, key=lambda h: (h[0], h[1], -h[2])):
            if h[0] >= end:
                kept.append(h)
                end = h[2]
        assert list(map(tuple, found[k].kept)) == kept
        n = [sum(h[5] == g for h in kept) for g in ("t1", "t2", "t3", "claude")]
        assert tuple(found[k].tiers) == (*n, n[0] >= 3 or sum(n[:3]) >= 5 or n[3] >= 2)
    assert sum(len(x.hits) for x in found.values()) > 2000


def test_sql_function_and_groups(spark):
    scan.register(spark, scan.rules_table(spark, RULES), "hits_of")
    text = "In the end the end"
    rows = spark.sql("select h.* from values ('In the end the end'), (null) as t(text), lateral hits_of(text) h").collect()
    assert sorted(map(tuple, rows)) == sorted(brute(text, RULES))
    apart = scan.rule_hits(spark.createDataFrame([(text,)], "text string"), scan.rules_table(spark, RULES), disjoint=True).first().hits
    assert [(h.id, h.start) for h in apart if h.group == "t1"] == [("t1.a", 0), ("t1.b", 11)] and sum(h.group == "P" for h in apart) == 1


def test_rules_that_cannot_be(spark, monkeypatch):
    with pytest.raises(ValueError, match="bad"):
        scan.Scanner((("bad", "g", 2, None, "(", "i", "text", False),))
    with pytest.raises(ValueError, match="no scope"):
        scan.Scanner((("bad", "g", 2, "a", None, "i", "page", False),))
    odd = scan.rules_table(spark, [{"id": None, "phrase": "a"}, {"id": "x"}, {"id": "y", "phrase": ""}])
    df = spark.createDataFrame([("a",)], "text string")
    assert scan.rule_hits(df, odd).first().hits == [] and scan.rule_hits(df.limit(0), odd).collect() == []
    monkeypatch.setattr(scan, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="every task"):
        scan.rule_hits(df, scan.rules_table(spark, RULES))


def test_many_hits_are_linear():
    scanner = scan.Scanner(tuple((f"r{k}", "g", 2, f"w{k} the", None, "i", "text", False) for k in range(600)) + (("t", "g", 2, "the", None, "i", "text", False),))
    text = " the" * 200_000
    hits = scanner.hits(text)
    assert len(hits) == 200_000 and len(scan.disjoint_hits(hits)) == 200_000


def test_waivers(spark):
    hits = scan.rule_hits(spark.createDataFrame([("In the end",)], "text string"), scan.rules_table(spark, RULES[:2]))
    assert hits.select(spans.waived("hits", ("t1.a", "t1.b")).alias("w")).first().w and not hits.select(spans.waived("hits", ("t1.a",)).alias("w")).first().w
