"""Closest exemplars against all pairs."""

import random

from corpusloom.operators import compare

SCHEMA = "id long, archetype string, hook string, ending string, words array<string>"


def test_every_candidate_has_its_exemplars(spark):
    r = random.Random(8)
    some = lambda *v: r.choice([None, *v])
    make = lambda low, n, *kinds: [(low + k, some(*kinds), some("q", "s"), some("z"), sorted(set(r.choices("abcdefgh", k=r.randint(0, 4))))) for k in range(n)]
    left, right = make(0, 40, "a", "b", "only") + [(99, "new", "new", "new", ["zzz"]), (98, None, None, None, [])], make(500, 9, "a", "b")
    want = set()
    for c in left:
        ranked = []
        for e in right:
            same = sum(x is not None and x == y for x, y in zip(c[1:4], e[1:4], strict=True))
            union = set(c[4]) | set(e[4])
            ranked.append((-same, -(len(set(c[4]) & set(e[4])) / len(union) if union else 0.0), e[0]))
        want |= {(c[0], e, -s, round(-j, 6), k + 1) for k, (s, j, e) in enumerate(sorted(ranked)[:2])}
    found = compare.closest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert {tuple(x) for x in found} == want
    assert compare.closest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame([], SCHEMA)).collect() == []
