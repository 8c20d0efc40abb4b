"""Exports, run directories, nested front matter and the feature table, on hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import materialise
from corpusloom.sources import export, readers, runs


def asset(k, **more):
    return {"asset_id": k, "role": "primary_image", "kind": "image", "generated": False, "download_status": "downloaded_and_verified", "local_path": f"a/{k}.png", "width": 10, "height": 20} | more


def block(text, **more):
    return {"role": "creator_original", "eligible_for_feed_creator_style": True, "exact_text": text} | more


EXPORT = {
    "creator_groups": [
        {
            "creator": {"creator_key": "ann", "display_name": "Ann Lee"},
            "posts": [
                {
                    "ref": "p1", "classification": "original", "is_self_repost": True, "chronology": {"timestamp": {"date": "2024-01-01"}}, "source_links": {"post_url": "u1"},
                    "engagement": {"total_reactions": 5, "comments": 1, "shares": 2},
                    "assets": [asset("i1"), asset("i1", local_path="a/second.png"), asset("g", generated=True), asset("thumb", role="video_thumbnail"), asset("bad", download_status="failed"), asset("none", local_path=""), asset("v", role="primary_video", kind="video", duration_seconds=12.5), asset("pdf", role="document_pdf", width=None, page_number=3)],
                    "text_blocks": [block("Hello", asset_ids=["v", "i1", "g", "thumb", "bad", "none", "unknown", "pdf"], published_at={"date": "2024-02-02"}, source_url="b1"), block("  \n"), block("not eligible", eligible_for_feed_creator_style=False)],
                },
                {
                    "ref": "p2", "classification": "quote", "assets": [asset("q1")], "source_links": {"post_url": "u2"},
                    "text_blocks": [block("my view", role="creator_commentary"), block("theirs", role="quoted_original", eligible_for_feed_creator_style=False, exact_text=" the quote ", asset_ids=["q1"], author={"name": "Bo"})],
                },
                {"ref": "p3", "classification": "quote", "text_blocks": [block("alone", role="creator_commentary", asset_ids=["x"])]},
                {"ref": None, "text_blocks": None},
            ],
        },
        {"creator": {"creator_key": "zed"}, "posts": [{"ref": "z", "text_blocks": [block("zed's", surprise={"deep": [1]})]}]},
        {"creator": None, "posts": None},
    ],
    "other": [1, 2],
}


def test_export(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps(EXPORT))
    rows, skipped = export.read_export(spark, str(tmp_path / "corpus.json"))
    found = {r.text: r for r in rows.collect()}
    assert set(found) == {"Hello", "my view", "alone", "zed's"} and [tuple(r) for r in skipped.collect()] == [("p1", "empty text")]
    one = found["Hello"]
    assert (one.author, one.platform, one.lang, one.posted_at, one.url, tuple(one.engagement), one.ref) == ("Ann Lee", "linkedin", "en", "2024-02-02", "b1", (5, 1, 2), "p1")
    assert [tuple(m) for m in one.media] == [("a/v.png", "primary video, 10x20, 12s"), ("a/second.png", "primary image, 10x20"), ("a/pdf.png", "document pdf, page 3")]
    assert one.context == "The creator re-shared this post of their own; the text is theirs."
    two = found["my view"]
    assert [tuple(m) for m in two.media] == [("a/q1.png", "primary image, belongs to the quoted post, not to the comment, 10x20")]
    assert two.context.endswith("The quoted post, by Bo, reads:\nthe quote") and two.url == "u2" and two.posted_at is None
    assert found["alone"].context.endswith("was not captured.") and found["alone"].media == [] and found["zed's"].author == "zed"
    assert {r.author for r in export.read_export(spark, str(tmp_path / "corpus.json"), only=["ann-lee"])[0].collect()} == {"Ann Lee"}
    files = spark.createDataFrame([("a/v.png",), ("a/q1.png",)], "path string")
    assert {r.path for r in export.missing_files(rows, files).collect()} == {"a/second.png", "a/pdf.png"}
    assert "surprise" not in rows._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty.json").write_text("{}")
    assert export.read_export(spark, str(tmp_path / "empty.json"))[0].collect() == []


MATTER = """---
platform: x
lineage:
  rewrite_of: r1-w1-li   # the last
  exemplars_seen: [p1, "p, 2"]
moves:
  - first one
  - 'second'
beats:
- lines: 1-2
  beat: hook
- lines: "3"
note: |
  two
  lines
empty:
none: ~
---

Body

"""


def test_nested_front_matter():
    meta, body = readers.nested_matter(MATTER)
    assert body == "Body\n\n"
    assert meta == {"platform": "x", "lineage.rewrite_of": "r1-w1-li", "lineage.exemplars_seen": '["p1", "p, 2"]', "moves": '["first one", "second"]', "beats.0.lines": "1-2", "beats.0.beat": "hook", "beats.1.lines": "3", "note": "two\nlines", "none": ""}
    assert readers.nested_matter("no fence") == ({}, "no fence")


@pytest.fixture
def run_folder(tmp_path):
    def put(run, k, cid, head="", text="Text.", **scores):
        folder = tmp_path / run / f"round{k}"
        (folder / "candidates").mkdir(parents=True, exist_ok=True)
        (folder / "scores").mkdir(exist_ok=True)
        (folder / "candidates" / f"{cid}.md").write_text(f"---\n{head}\n---\n\n{text}\n")
        for kind, value in scores.items():
            (folder / "scores" / f"{cid}.{kind}.json").write_text(json.dumps(value))

    put("a", 1, "r1-w1-li", "platform: linkedin", merged={"verdict": {"status": "pass"}}, tier0={"x": 1})
    put("a", 1, "r1-w2-x", "writer: me")
    put("a", 1, "r1-w3-x1")
    put("a", 2, "r2-w1-li", "lineage:\n  rewrite_of: r1-w1-li")
    put("a", 2, "r2-w2-x", "lineage:\n  rewrite_of: r1-w1-li")
    put("a", 2, "r2-w3-x1", "lineage:\n  rewrite_of: gone")
    put("a", 10, "r10-w1-li")
    put("b", 1, "odd name")
    (tmp_path / "b" / "roundX").mkdir()
    (tmp_path / "a" / "round1" / "candidates" / "r1-w1-li.txt").write_text("clean")
    (tmp_path / "notes.txt").write_text("x")
    return f"file://{tmp_path}"


def test_run_directory(spark, run_folder, tmp_path):
    table = runs.read_runs(spark, run_folder)
    rows = {r.cid: r for r in runs.superseded(table).collect()}
    assert len(rows) == 8 and rows["r1-w1-li"].text == "clean" and rows["r1-w2-x"].text == "Text.\n"
    assert (rows["r1-w2-x"].writer, rows["r1-w3-x1"].writer, rows["odd name"].writer, rows["odd name"].platform, rows["r1-w3-x1"].platform) == ("me", "post-writer-3", "post-writer", "linkedin", "x")
    assert {k: r.superseded_by for k, r in rows.items() if r.superseded_by} == {"r1-w1-li": "r2-w2-x", "r1-w3-x1": "r2-w3-x1"}
    status = table.where("cid = 'r1-w1-li'").select(runs.score("merged", "$.verdict.status").alias("s"), F.size("scores").alias("n")).first()
    assert tuple(status) == ("pass", 2)
    assert runs.read_runs(spark, f"file://{tmp_path}/absent").collect() == []


def test_options_choose_partitions(spark, run_folder, tmp_path):
    table, cut = runs.read_runs(spark, run_folder), runs.read_runs(spark, run_folder, "a", (2, 9))
    assert {r.cid for r in cut.collect()} == {"r2-w1-li", "r2-w2-x", "r2-w3-x1"}
    assert (cut.rdd.getNumPartitions(), table.rdd.getNumPartitions()) == (1, 4)
    assert {r.cid for r in table.where("round in (1, 10) and run != 'a'").collect()} == {"odd name"} and table.count() == 8
    assert runs.read_runs(spark, run_folder, "[bc]").count() == 1 and runs.read_runs(spark, run_folder, "c*").count() == 0


def test_feature_table_grows_by_what_is_new(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def compute(df):
        @F.udf("int")
        def words(t):
            seen.add(1)
            return None if t is None else len(t.split())

        return df.withColumn("n_words", words("text"))

    def table(rows):
        return spark.createDataFrame(rows, "post_id string, split string, text string, batch string")

    path, first = f"{tmp_path}/features", [("a", "train", "one two", "x"), ("b", "self", "three", "x"), ("b", "self", "three", "x"), ("c", "heldout", None, "x"), ("d", "other", "no", "x"), (None, "train", "no", "x")]
    problem = F.when(F.col("n_words").isNull(), "no text")
    run = lambda rows, **how: {r.post_id: (r.failed, r.reason) for r in materialise.update_features(table(rows).drop("batch"), path, compute, problem, **how).collect()}
    assert run(first) == {"a": (False, None), "b": (False, None), "c": (True, "no text")} and seen.value >= 3
    seen.value = 0
    assert run(first) == {} and seen.value == 0
    changed = [("a", "train", "one two three", "x"), *first[1:4], ("e", "train", "new", "x")]
    assert run(changed) == {"a": (False, None), "e": (False, None)} and seen.value >= 2
    now = {r.post_id: (r.n_words, r.batch) for r in materialise.current_features(table(changed), path).collect()}
    assert now == {"a": (3, 2), "b": (1, 1), "e": (1, 2)}
    assert {r.post_id: r.n_words for r in materialise.current_features(table(first), path).collect()} == {"a": 2, "b": 1}
    assert [(r.post_id, r.reason) for r in materialise.quarantine(spark, path).collect()] == [("c", "no text")]
    assert run(first, retry=True) == {"c": (True, "no text")}
