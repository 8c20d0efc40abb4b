"""Similar texts by hashed grams: the rows that the SQL finds, with less shuffled."""

import random

import pytest

from corpusloom.operators import similar
from corpusloom.plans import overlaps
from corpusloom.plans.dialect import spark_query


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(5), str(tmp_path_factory.mktemp("similar"))
    texts = [None, "", "one two", "A b c", "a, b c!", "line of all " * 30]
    for _ in range(40):
        base = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.choice([3, 9, 40, 120]))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                copy[r.randrange(len(copy))] = r.choice(["x", "yé", "Z"])
            texts.append(" ".join(copy) + r.choice(["", ".", " line of all line of all line of all"]))
    rows = [(None if k == 9 else k, t, r.choice(["en", "en", "de", None]), r.choice(["s0", "s0", "s0", "s1", None]), len(t or "")) for k, t in enumerate(texts + texts[:60])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["near_duplicates", "siblings"])
def test_rows_are_those_of_the_sql(spark, folder, name):
    want = spark_query(overlaps.PLANS[name])(spark, folder)
    found = overlaps.QUERIES[name](spark, folder)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 5


@pytest.mark.parametrize("name", ["near_duplicates", "siblings"])
def test_no_gram_is_shuffled_as_text(spark, folder, name):
    plan = overlaps.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan


def test_hashes_are_those_of_the_grams(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abc") * r.randint(1, 2) for _ in range(r.randint(0, 12))) for _ in range(200)]
    for width in (1, 3, 8):
        seen = {}
        for t, h in zip(texts, similar.gram_hashes([t.encode() for t in texts], width), strict=True):
            w = t.split(" ") if t else []
            grams = {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}
            assert len(h) == len(grams)
            alone = similar.gram_hashes([t.encode()], width)[0]
            assert set(h.tolist()) == set(alone.tolist())
            seen[frozenset(grams)] = frozenset(h.tolist())
        assert len(set(seen.values())) == len(seen)
