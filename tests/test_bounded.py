"""What is done by cells, bounds and slices, against the plain way over everything."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import fillers, quantiles, scan
from corpusloom.plans import catalog
from corpusloom.plans.dialect import spark_query
from corpusloom.plans.measures import PLANS


def test_quantiles_are_those_of_percentile(spark):
    r = random.Random(1)
    rows = [(g, None if r.random() < 0.1 else round(r.choice([r.random() * 10, r.gauss(5, 1e4), 3.0]), 2)) for g in ("a", "b", None) for _ in range(3001)] + [("none", None), ("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {x.g: x.q for x in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(0.999))).alias("q")).collect()}
    found = {x.g: x.quantiles for x in quantiles.exact_quantiles(df, "g", "x", (0.0, 0.25, 0.5, 0.999)).collect()}
    assert found.pop("none") == [None] * 4 and want.pop("none", None) is None and found == want


def test_quantiles_gather_no_group(spark):
    plan = catalog.queries()["quantiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "percentile_approx(" in plan


def test_fillers_are_those_of_all_pairs(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, "t", r.choice("pq"), r.choice(["a", "b", "c", "d", None]), r.choice([None, 0, 1, r.randint(0, 60), r.randint(0, 3000)])) for k in range(600)] + [(700, "t", "few", "a", 5), (701, "t", "few", "b", 5), (702, "t", None, "b", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, spark_query(PLANS["fillers"].replace("% 100", "% 10"))(spark, str(tmp_path)).collect()))
    posts = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id as id", "lang", "source as author", "n_chars")
    found = fillers.fillers(posts, posts.where("id % 10 = 0"))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 200
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_hits_go_through_slices(spark, monkeypatch):
    texts = [None, "", "the end of the end", "no", "The\u00a0END the  end"] * 40
    rules = spark.createDataFrame([("t1.a", "the end"), ("t2.b", "end of"), ("t1.c", "the")], "id string, phrase string")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    found = scan.rule_hits(df, rules).select("k", "text", "hits", scan.leftmost("hits").alias("kept")).collect()
    scanner = scan.Scanner(tuple(tuple(r) for r in scan.filled(rules).collect()))
    for row in found:
        want = scanner.hits(row.text)
        assert [tuple(h) for h in row.hits] == want
        assert [tuple(h) for h in row.kept] == [(*h[:5], h[7], h[6]) for h in scan.disjoint_hits([(*h[:5], None, h[6], h[5]) for h in want])]
    assert [len(x) for x in scan._slices([pa.array(range(150))])] == [64, 64, 22]


def test_plain_texts_are_scanned_as_others_are():
    r = random.Random(4)
    scanner = scan.Scanner(tuple((f"r{k}", "g", 2, p, None, "i", "text", False) for k, p in enumerate(["ab", "a b", "b ab a", "ab-a"])))
    for _ in range(2000):
        text = "".join(r.choice("abAB-  \n\t\x1c\x0b") for _ in range(r.randint(1, 40)))
        far = scanner.hits(text + " é")
        assert scanner.hits(text + " e") == [h for h in far]
