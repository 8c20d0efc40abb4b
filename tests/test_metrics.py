"""Counts out of free text."""

import pytest

from corpusloom.functions.metrics import Counts, parse_counts

CASES = [
    ("12k views 40 comments 3 reposts", {"views": 12000, "comments": 40, "reposts": 3}, None, [], []),
    ("views: 1,234; likes = 1.2M", {"views": 1234, "likes": 1_200_000}, None, [], []),
    ("likes 5 and 6 likes", {"likes": 6}, None, [], ["likes given twice; keeping 6"]),
    ("5 likes, likes 5", {"likes": 5}, None, [], []),
    ("12kviews .5k saves", {"views": 12000, "saves": 500}, None, [], []),
    ("100 views --after 24h", {"views": 100}, 24, [], []),
    ("100 views after 2 days", {"views": 100}, 48, [], []),
    ("at 1.5w 7 new_followers newlikes 3", {"likes": 7}, 252, ["new_followers", "3"], []),
    ("24h 3 RTs", {"reposts": 3}, 24, [], []),
    ("3 24h likes", {"likes": 3}, None, ["24h"], []),
    ("10 20 likes", {"likes": 20}, None, ["10"], []),
    ("likes, comments 4 hello 9", {"comments": 4}, None, ["likes", "hello", "9"], []),
    ("after lunch @ home 5 hearts!", {"likes": 5}, None, ["after", "lunch", "home", "!"], []),
    ("nothing of the kind", {}, None, ["nothing", "kind"], []),
    ("", {}, None, [], []),
]


@pytest.mark.parametrize("text, metrics, after, unparsed, warnings", CASES)
def test_counts(text, metrics, after, unparsed, warnings):
    c = Counts(text)
    assert (c.metrics, c.after, sorted(c.unparsed), c.warnings) == (metrics, after, sorted(unparsed), warnings)


def test_column(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)] + [(99, None)], "k int, text string")
    found = {r.k: r.c for r in df.select("k", parse_counts("text").alias("c")).collect()}
    assert found.pop(99) is None
    assert {k: (r.metrics, r.after_hours) for k, r in found.items()} == {k: c[1:3] for k, c in enumerate(CASES)}
