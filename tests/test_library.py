"""The library's operators and readers on hand-made rows."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import canon
from corpusloom.operators import compare, rows, spans, tables
from corpusloom.sources import readers


def column(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v string")
    return [r.x for r in df.select("k", f("v").alias("x")).orderBy("k").collect()]


def test_canonical_forms(spark):
    assert column(spark, canon.fold_punct, ["“a” — b…", "ﬁ\xa0x", None]) == ['"a" - b...', "fi x", None]
    assert column(spark, canon.normalize_text, ["It’s  HERE: https://a.b/c 🎉 né!", ""]) == ["its here né", ""]
    assert column(spark, canon.slugify, ["@José  Ñu", "3M", "!!"]) == ["jose-nu", "author-3m", "unknown"]
    assert column(spark, canon.x_length, ["a https://x.co/abc). b", "👍🏽", "🇩🇪漢", "…"]) == [2 + 23 + 2 + 2, 2, 4, 2]


def test_fold(spark):
    found = column(spark, canon.above_fold, ["short", "a\nb\nc\nd", "x" * 200, "One. " + "y" * 200, "🎉" * 80])
    assert [(f.cut_index, f.cut_by, f.boundary_within, f.mid_word) for f in found] == [(5, None, True, False), (5, "lines", True, False), (140, "chars", False, True), (140, "chars", True, True), (70, "chars", False, False)]


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Name;Content;Likes\nann;"two\nlines; quoted ""x""";1.2k\n;;\n bob ;one;3\n', encoding="utf-8")
    raw = readers.read_source(spark, str(path))
    assert raw.columns == ["Name", "Content", "Likes"] and raw.count() == 2
    found = {r.author: r for r in rows.normalise_rows(raw).collect()}
    assert found["ann"].text == 'two\nlines; quoted "x"' and found["ann"].engagement.likes == 1200 and found["ann"].platform is None
    assert found["bob"].platform == "x"
    with pytest.raises(ValueError, match="no reader"):
        readers.read_source(spark, "a.docx")


def test_json_files(spark, tmp_path):
    cases = {"w.json": '{"v": 1, "posts": [{"a": 1}, {"b": "x"}]}', "l.jsonl": '{"a": 1}\n{"a": 2, "b": "y"}\n', "one.json": '{"a": 5}', "arr.json": '[{"a": 1},\n {"a": 2}, {"a": 3}]'}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    count = lambda name: readers.read_records(spark, str(tmp_path / name)).count()
    assert [count(n) for n in cases] == [2, 2, 1, 3]
    assert set(readers.read_records(spark, str(tmp_path / "w.json")).columns) == {"a", "b"}
    (tmp_path / "log.jsonl").write_text('{"run": "a"}\nnot json\n{"run": "b"}\n')
    assert readers.read_log(spark, str(tmp_path / "log.jsonl"), "run string").count() == 2
    assert readers.read_log(spark, str(tmp_path / "absent.jsonl"), "run string").count() == 0


def test_markdown(spark, tmp_path):
    text = "---\nplatform: x\n---\nauthor: ann\nurl: https://x.com/1\n\nfirst: body\nline\n---\nNote: not known\nstill text\n"
    found = list(readers.markdown_blocks(text, frozenset({"author", "url"})))
    assert found == [({"platform": "x", "author": "ann", "url": "https://x.com/1"}, "first: body\nline"), ({"platform": "x"}, "Note: not known\nstill text")]
    for split in ("train", "heldout"):
        (tmp_path / split).mkdir()
        (tmp_path / split / "p1.md").write_text(f"---\npost_id: {split}-1\n---\n\nbody\n\n")
    docs = readers.read_documents(spark, str(tmp_path)).collect()
    assert [(r.split, r.meta["post_id"], r.text) for r in docs] == [("heldout", "heldout-1", "body"), ("train", "train-1", "body")]
    written = spark.createDataFrame([({"b": "2", "a": "1"}, "t\n\n")], "meta map<string,string>, text string").select(tables.front_matter()).first()[0]
    assert written == "---\na: 1\nb: 2\n---\n\nt\n" and readers.split_front_matter(written) == ({"a": "1", "b": "2"}, "t\n")
    assert readers.markdown_tables("x\n| A | B |\n|---|:-:|\n| 1 | 2 |\n\n| C |\n| 3 |") == [(["a", "b"], [["1", "2"]]), (["c"], [["3"]])]


def test_header_mapping_and_problems(spark):
    mapping, rest = rows.map_headers(["Post_Text", "NAME", "by", "Network", "Notes"], {"context": "Notes"})
    assert mapping == {"context": "Notes", "author": "NAME", "text": "Post_Text", "platform": "Network"} and rest == ["by"]
    df = spark.createDataFrame([("t", "a", "x"), ("", "b", None)], "text string, author string, platform string")
    assert [r.problems for r in rows.row_problems(df).orderBy("author").collect()] == [[], ["text", "platform"]]
    assert rows.accepted_batch(df).count() == 0 and rows.accepted_batch(df.where("author = 'a'")).count() == 1


def test_triples(spark):
    sizes = spark.createDataFrame([([1, 2, 3, 3, 2, 1, 1],), ([4, 1, 1],), ([],)], "s array<int>")
    assert [r.n for r in sizes.select(spans.triples("s").alias("n")).collect()] == [2, 0, 0]


def test_longest_common_strings(spark):
    shared = "the quick brown fox jumps over the lazy dog and runs"
    texts = spark.createDataFrame([(1, f"abc {shared} xyz"), (2, shared[:39]), (3, None)], "id long, text string")
    refs = spark.createDataFrame([("r", f"0 {shared}!")], "ref string, ref_text string")
    assert [tuple(r) for r in compare.common_strings(texts, refs).collect()] == [(1, "r", 3, 1, len(shared) + 1)]


def test_edits(spark):
    draft, live = "one line here\ncut me\nlast — words", "one line there\nlast words entirely new ending with more"
    assert compare.line_edits(draft, live) == ["changed_first_line", "cut_line", "changed_ending", "removed_em_dash", "lengthened"]
    assert compare.line_edits("a\nb", "a\nb") == [] and compare.line_edits("a b c", "a b c\nnew line of text") == ["added_line", "lengthened"]
    a, b = ["abcd", "abce"], ["abce", "zzzz"]
    assert compare.pair_lines(a, b) == {1: 0} and difflib.SequenceMatcher(None, a[1], b[0]).ratio() == 1
    assert spark.createDataFrame([(None, "x")], "draft string, live string").transform(compare.edits).first().edits == ["added_line"]


def test_logs_and_snapshots(spark):
    old = spark.createDataFrame([(1, 5, "view", None), (1, 9, "view", None), (1, 12, "other", None)], "ref long, event_id long, kind string, score int")
    new = spark.createDataFrame([(1, "rated", 4), (2, "rated", 3)], "ref long, kind string, score int")
    found = tables.upsert_newest(old, new.selectExpr("ref", "cast(null as long) event_id", "kind", "score"), "ref", "event_id", ("view",), "score").collect()
    assert sorted((r.ref, r.event_id or 0, r.score) for r in found if r.score) == [(1, 9, 4), (2, 0, 3)] and len(found) == 4
    lessons = spark.createDataFrame([("a", 2, ["x"], "2024-01-01", None), ("b", 1, ["y"], "2024-01-01", "2024-02-01")], "lesson string, count int, evidence array<string>, date string, retired string").selectExpr("lesson", "count", "evidence", "cast(date as date) date", "cast(retired as date) retired")
    more = spark.createDataFrame([("b", 2, ["y", "z"], "2024-06-01"), ("c", 3, ["w"], "2024-06-01")], "lesson string, count int, evidence array<string>, date string").selectExpr("lesson", "count", "evidence", "cast(date as date) date")
    united = {r.lesson: r for r in tables.reinforce(lessons, more).collect()}
    assert (united["b"]["count"], united["b"].evidence, united["b"].retired) == (3, ["y", "z"], None) and united["c"]["count"] == 3
    assert {r.lesson: str(r.retired) for r in tables.retire(tables.reinforce(lessons, more), "2024-06-02").collect()} == {"a": "2024-06-02", "b": "None", "c": "None"}
    dated = spark.createDataFrame([("k", 5), ("m", 1)], "key string, modified int")
    assert [r.key for r in tables.fresh_only(dated, spark.createDataFrame([("k", 4), ("m", 2)], "key string, modified int")).collect()] == ["k"]


def test_merged_lessons(spark):
    rows_ = [(1, "s", "t", "keep the opening short and plain"), (2, "s", "t", "keep the opening short and very plain"), (3, "s", "u", "keep the opening short and plain"), (4, "s", "t", "something else")]
    found = compare.consolidate(spark.createDataFrame(rows_, "id long, section string, tag string, instruction string"))
    assert {r.id: r.merged_into for r in found.collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_resolved_drafts(spark):
    drafts = spark.createDataFrame([("c1", "r1", "2024-01-01", "pricing page launch"), ("c2", "r2", "2024-01-02", "pricing notes"), ("c3", "r3", "2024-01-03", "other")], "cid string, run string, run_date string, title string")
    assert [(r.cid, r.score, r.ambiguous) for r in compare.resolve_draft(drafts, "pricing launch").collect()] == [("c1", 1.0, False)]
    assert [r.cid for r in compare.resolve_draft(drafts, "pric").collect()] == ["c2", "c1"]


def test_inherited_splits_follow_chains(spark):
    posts = [(k, f"{k:08x}ff", "x", "a", False, None) for k in (4, 1, 2, 3)] + [(10, "00000001", "x", "a", False, 4), (11, "00000002", "x", "a", False, 10), (12, "0", "x", "a", True, 1)]
    df = spark.createDataFrame(posts, "post_id long, sha string, platform string, author string, own boolean, link long")
    found = {r.post_id: r.split for r in rows.assign_splits(df, per_platform=4).collect()}
    assert found == {4: "heldout", 10: "heldout", 11: "heldout", 12: "self", 1: "heldout", 2: "train", 3: "train"}
    assert rows.assign_splits(df.where("false")).count() == 0
    assert {r.pool for r in tables.lineup_pool(df.select("platform", F.lit("train").alias("split"))).collect()} == {"train"}


def test_features(spark):
    from corpusloom.operators import features

    text = "I like it. You do?\n\nOne line\n\nTWO, three! Pi is 3.14... ok"
    r = features.features(spark.createDataFrame([(1, text), (2, None)], "k long, text string")).orderBy("k").collect()
    a, b = r
    assert (a["size"].n_lines, a["size"].n_blank, a["size"].n_sentences) == (3, 2, 6) and a.line_words.max_run_single_line_paras == 3
    assert a.line_words.rhythm == "2/1/3"
    assert (a.hook.line1_words, a.hook.is_question, a.hook.cut140_ends_sentence) == (5, True, True) and a.pov.dominant == "mixed"
    assert a.punct_per_1k.comma == round(1000 / len(text), 4) and a.punct_per_1k.ellipsis == round(1000 / len(text), 4)
    assert b["size"].n_words == 0 and b.lexicon.ttr == 0.0 and b.pov.dominant == "third"


def test_checks_and_verdicts(spark):
    from corpusloom.operators import checks

    good = "We cut 40% of the build time in March. Then we wrote it down for the others to read."
    rows_ = [("a", "linkedin", good, False), ("b", "x", "see https://x.co/a #tag", False), ("c", "linkedin", good + " **bold** link in the comments", False), ("d", "other", None, False)]
    table = checks.check_table(spark.createDataFrame(rows_, "cid string, platform string, text string, media boolean"), {})
    assert table.where("cid = 'a'").count() == table.select("check_id").distinct().count() and {r.check_id for r in table.collect()} <= set(checks.CLASSES)
    found = {r.cid: r for r in checks.summary(table).collect()}
    assert found["a"].hard == [] and found["b"].hard == ["P3_hashtags", "P4_links"] and found["c"].hard == ["P4_links", "P5_markup"] and "P0_schema" in found["d"].hard
    rates = spark.createDataFrame([("P5_markup", 0.3), ("P4_links", 0.25)], "check_id string, base_rate double")
    rates = rates.unionByName(spark.createDataFrame([(f"A{k}", 0.9) for k in range(200)], rates.schema))
    once = checks.downgraded(table, rates, ("P5_markup", "P4_links"))
    low = {r.cid: r for r in checks.summary(once).collect()}
    assert low["c"].hard == ["P4_links"] and low["c"].flag == ["P5_markup"]
    twice = checks.downgraded(once, rates, ("P5_markup", "P4_links"))
    assert sorted(map(str, twice.select(once.columns).collect())) == sorted(map(str, once.collect()))


def test_features_keep_columns_and_names(spark):
    from corpusloom.operators import features

    rows = [(1, "It's Ann's plan and we don't know. You and we.", 99, 98, 97, "mine"), (2, None, 99, 98, 97, "mine"), (3, "I, you.", 99, 98, 97, "mine")]
    found = features.features(spark.createDataFrame(rows, "ft int, text string, fw int, sw int, lw int, size string")).orderBy("ft").collect()
    assert [(r.ft, r.fw, r.sw, r.lw, r.text) for r in found] == [(r[0], 99, 98, 97, r[1]) for r in rows]
    assert found[0].lexicon.contraction_rate == 0.2 and found[0].pov.dominant == "first_plural" and found[2].pov.dominant == "mixed"
    assert found[1].lexicon.contraction_rate == found[1].pov.i_per100 == 0.0 and found[1].pov.dominant == "third" and found[1]["size"].n_words == 0


def test_lessons_merge_as_each_with_each_does(spark, monkeypatch):
    r, words = random.Random(3), [f"w{k}" for k in range(12)]
    rows_ = [(k, r.choice(["s", "t", None]), "a", " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for k in r.sample(range(1000), 300)]
    want = {}
    for section in ("s", "t", None):
        group = sorted((k, set(t.split())) for k, s, _, t in rows_ if s == section)
        for n, (k, one) in enumerate(group):
            want.setdefault(k, None)
            for j, two in group[n + 1 :]:
                if want[k] is None and want.get(j) is None and one | two and len(one & two) / len(one | two) >= 0.6:
                    want[j] = k
    monkeypatch.setattr(compare, "BLOCK", 40)
    found = compare.consolidate(spark.createDataFrame(rows_, "id long, section string, tag string, instruction string"))
    assert {x.id: x.merged_into for x in found.collect()} == want


def test_lessons_of_different_conversations_merge(spark, tmp_path):
    """No turn is left out for the number of its conversation: the query's pairs are those of all turns of one role, early or late."""
    from corpusloom.plans import library

    r, words = random.Random(5), [f"w{k}" for k in range(40)]
    turns = [(c, t, ("user", "assistant")[t % 2], " ".join(r.choices(words, k=r.randint(1, 7)))) for c in range(60) for t in range(4)]
    turns += [(61, 0, "user", "one two three four five"), (72, 0, "user", "one two three four six"), (83, 0, "assistant", "one two three four five"), (84, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, open_ = {c * 1000 + t: None for c, t, _, _ in turns}, [(c * 1000 + t, (role, t < 2), set((text or "").split())) for c, t, role, text in sorted(turns)]
    for n, (k, scope, one) in enumerate(open_):
        for j, other, two in open_[n + 1 :]:
            if scope == other and want[k] is None and want[j] is None and one | two and len(one & two) / len(one | two) >= 0.6:
                want[j] = k
    found = {x.id: x.merged_into for x in library.lessons(spark, str(tmp_path)).collect()}
    assert found == want and found[72_000] == 61_000 and any(j and k // 1000 % 10 != j // 1000 % 10 for k, j in found.items() if k < 61_000)


@pytest.mark.parametrize("block", [3, 4096])
def test_similar_sets_are_those_of_all_pairs(spark, monkeypatch, block):
    """Small and large sets, near copies, and a token that all have; by blocks of one token and without."""
    r, sets = random.Random(9), []
    for k in range(150):
        near = r.choice(sets)[2] if sets and r.random() < 0.5 else []
        tokens = {t for t in near if r.random() < 0.95} | {f"t{r.randint(0, 400)}" for _ in range(r.choice([0, 1, 3, 40]))} | {"all"}
        sets.append((k, r.choice([("a", None), (None, "a"), ("a", "b")]), sorted(tokens)))
    monkeypatch.setattr(compare, "BLOCK", block)
    df = spark.createDataFrame(sets, "id long, scope struct<section: string, tag: string>, tokens array<string>")
    want = {(i, j) for i, s, x in sets for j, u, y in sets if i < j and s == u and 5 * len({*x} & {*y}) >= 3 * len({*x} | {*y})}
    found = [tuple(x) for x in compare.similar_sets(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_lessons_are_not_gathered_by_group(spark):
    plan = compare.consolidate(spark.createDataFrame([(1, "s", "t", "one two"), (2, "s", "t", "one two")], "id long, section string, tag string, instruction string"))
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()


def test_mean_is_no_lambdas_own(spark):
    """The mean of the sentences is summed once for a text, not again for each sentence, and the words are lowered once."""
    from corpusloom.operators import features

    df = spark.createDataFrame([(1, "One two. Three you we. I."), (2, None)], "id long, text string")
    found = features.features(df).select("id", "sent_words.*", "pov.*")
    plan = found._jdf.queryExecution().analyzed().toString()
    sd = next(line for line in plan.splitlines() if "sqrt" in line.lower())
    inner = sd[sd.lower().index("sqrt") :][:400]
    assert "- mean#" in inner
    rows = {r.id: r for r in found.collect()}
    assert (rows[1].mean, rows[1].sd, rows[1].max) == (2.0, 0.8165, 3.0) and rows[1].dominant == "mixed"
