"""Closures of links against walks of one link at a time."""

import random

import pytest

from corpusloom.operators import closure, rows

SCHEMA = "id long, next long, depth string"


def walk(links):
    """{id: (root, depth, cyclic)} of every id and end."""
    least = {}
    for a, b, _ in links:
        if a is not None and b is not None:
            least[a] = min(least.get(a, b), b)
    out = {}
    for start in {*least, *least.values()}:
        at, seen = start, [start]
        while at in least and least[at] not in seen:
            at = least[at]
            seen.append(at)
        out[start] = (None, None, True) if at in least else (at, len(seen) - 1, False)
    return out


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(closure, "kept", lambda df, name, f=closure.kept: calls.append(name) or f(df, name))
    n = 10_000
    order = random.Random(1).sample(range(n), n)
    df = spark.createDataFrame([(order[k], order[k + 1], "x") for k in range(n - 1)], SCHEMA)
    found = {r.id: (r.root, r.depth, r.cyclic) for r in closure.follow(df).collect()}
    assert found == {order[k]: (order[-1], n - 1 - k, False) for k in range(n)}
    assert len(calls) <= 16


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_circles_and_odd_links(spark, seed):
    r = random.Random(seed)
    links = [(k, r.randrange(60), "x") for k in r.sample(range(60), 45)] + [(100, 100, "x"), (101, 102, "x"), (102, 101, "x"), (103, 101, "x"), (None, 1, "x"), (1, None, "x"), (200, 201, "x"), (200, 199, "x")]
    df = spark.createDataFrame(links, SCHEMA)
    assert {x.id: (x.root, x.depth, x.cyclic) for x in closure.follow(df).collect()} == walk(links)
    least = {a: min(b for x, b, _ in links if x == a and b is not None) for a, b, _ in links if a is not None and b is not None}
    want = set()
    for start in (0, 5, 100, 103, 200, 999):
        at, place, seen = start, 0, set()
        while at not in seen:
            seen.add(at)
            want.add((start, at, place))
            if at not in least:
                break
            at, place = least[at], place + 1
    starts = spark.createDataFrame([(s,) for s in (0, 5, 100, 103, 200, 999, 0)], "id long")
    assert set(map(tuple, closure.chains(df, starts).collect())) == want


def test_components_and_exclusion(spark):
    r = random.Random(3)
    order = r.sample(range(300), 300)
    links = [(order[k], order[k + 1], "x") for k in range(299) if k % 50] + [(0, k, "x") for k in range(400, 420)] + [(7, 7, "x"), (None, 3, "x"), (4, None, "x")]
    near = {}
    for a, b, _ in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    group = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            at = todo.pop()
            if at not in group:
                group[at] = start
                todo += near[at]
    df = spark.createDataFrame(links, SCHEMA)
    assert {x.id: x.component for x in closure.components(df).collect()} == group
    seeds = spark.createDataFrame([(order[3],), (999,), (None,)], "id long")
    assert {x.id for x in closure.excluded(seeds, df).collect()} == {999} | {k for k, g in group.items() if g == group[order[3]]}


def test_no_links(spark):
    none = spark.createDataFrame([], SCHEMA)
    seeds = spark.createDataFrame([(1,)], "id long")
    assert closure.follow(none).collect() == [] == closure.components(none).collect()
    assert [tuple(x) for x in closure.chains(none, seeds).collect()] == [(1, 1, 0)] and [x.id for x in closure.excluded(seeds, none).collect()] == [1]


def test_splits_along_long_chains_and_circles(spark):
    posts = [(k, f"{k % 2 * 4:08x}rest{k}", "x", "a", False, k - 1 if k else None) for k in range(75)]
    posts += [(100, "00000001", "x", "a", False, 101), (101, "00000004", "x", "a", False, 100), (102, "00000001", "x", "a", False, 5555), (103, "00000001", "x", "a", True, 0)]
    df = spark.createDataFrame(posts, "post_id long, sha string, platform string, author string, own boolean, link long")
    found = {x.post_id: x.split for x in rows.assign_splits(df, per_platform=0).collect()}
    assert {found[k] for k in range(75)} == {"heldout"} and (found[100], found[101], found[102], found[103]) == ("train", "heldout", "train", "self")


def test_nothing_is_broadcast(spark, monkeypatch):
    """Every table that a round writes comes of merged joins, whatever its size."""
    plans, kept = [], closure.kept
    monkeypatch.setattr(closure, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    links = spark.createDataFrame([(k, k + 1) for k in range(9) if k != 4], "id long, next long")
    found = [closure.excluded(spark.createDataFrame([(2,)], "id long"), links), closure.follow(links), closure.chains(links, links.select("id"))]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in found]
    assert len(plans) > 9 and not any("Broadcast" in p for p in plans)
    assert sorted(r.id for r in found[0].collect()) == [0, 1, 2, 3, 4]
