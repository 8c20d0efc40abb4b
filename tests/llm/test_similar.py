"""The near-duplicate stage at a similarity of 0.8 over five-word shingles, against all pairs."""

import random

import numpy as np
from test_operators import SCHEMA, texts

from corpusloom.llm import simhash_similar


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_keeps_one_of_each_group(spark):
    r, rows = random.Random(9), []
    for base in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([120, 400, 1500]))]
        # A change of one word touches five shingles.
        for n in [0, 1, len(words) // 120, len(words) // 90]:
            rows.append((len(rows) * 3 + base, edited(r, words, n), "en", "x", 1))
    r.shuffle(rows)
    sets = {k: shingles(t) for k, t, *_ in rows}
    root = {k: k for k in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    kept = {x.doc_id for x in simhash_similar.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(root.values())


def test_odd_rows(spark):
    rows = [(k, t, "en", "x", 1) for k, t in texts()] + [(None, "one", "en", "x", 1), (3, "one", "en", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash_similar.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    sets = [shingles(t) for _, t in texts()]
    gone = {k for k in range(len(sets)) if any(jaccard(sets[k], sets[j]) >= 0.8 for j in range(k))}
    assert {1, 2, 6} <= gone and set(range(len(sets))) - gone == set(ids) - {None}
    assert ids.count(None) == 1 and ids.count(3) == 2
    assert simhash_similar.keep_one(docs.where("false")).count() == 0


def test_leaders_find_every_near_pair_through_a_leader():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    w0 = np.repeat(base, 50) ^ (np.uint64(1) << r.integers(0, 60, 2000).astype(np.uint64))
    w1 = np.repeat(base, 50)
    key = np.repeat(np.arange(8), 250)
    lead, met = simhash_similar.leaders(key, w0, w1)
    assert len(lead) == 40 and set(lead) | set(met[:, 1]) == set(range(2000))
    assert (key[met[:, 0]] == key[met[:, 1]]).all()


def exact_groups(sets):
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {top(k) for k in sets}


def test_similar_texts_below_the_threshold_stay(spark):
    r, rows = random.Random(4), []
    for size in (8, 9, 10, 11, 12):
        for base in range(8):
            words = [f"s{size}b{base}w{k}" for k in range(size)]
            rows += [" ".join(words), " ".join([*words[:-1], "other"])]
    for n in (8, 7, 6, 5, 4, 3):  # words of 400: both texts of a pair differ from the base in other places
        for base in range(6):
            words = [f"n{n}b{base}w{k}" for k in range(400)]
            rows += [edited(r, words, n) for _ in range(2)]
    rows = [(k, t, "en", "x", 1) for k, t in enumerate(rows)]
    sets = {k: shingles(t) for k, t, *_ in rows}
    below = [round(jaccard(sets[k], sets[k + 1]), 2) for k in range(0, len(rows), 2)]
    assert sum(0.65 <= x < 0.8 for x in below) > 30 and sum(x >= 0.8 for x in below) > 3
    kept = {x.doc_id for x in simhash_similar.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == exact_groups(sets)


def test_no_link_at_the_threshold_is_lost(spark):
    r, rows, sets = random.Random(6), [], {}
    for base in range(400):
        words = [f"b{base}w{k}" for k in range(364)]
        at = [20 + 43 * k for k in range(8)]  # 40 of 360 shingles: a similarity of 320 to 400
        other = [f"o{base}w{k}" if k in at else w for k, w in enumerate(words)]
        rows += [" ".join(words), " ".join(other)]
    rows = [(k, t, "en", "x", 1) for k, t in enumerate(rows)]
    sets = {k: shingles(t) for k, t, *_ in rows}
    assert all(jaccard(sets[k], sets[k + 1]) == 0.8 for k in range(0, len(rows), 2))
    r.shuffle(rows)
    kept = {x.doc_id for x in simhash_similar.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(0, len(rows), 2))


def test_prefix_join_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_similar, "ROWS", 50)
    monkeypatch.setattr(simhash_similar, "close_prints", lambda nodes, own=simhash_similar.close_prints: own(nodes).where("false"))
    r, rows = random.Random(8), []
    shared = [f"c{k}" for k in range(60)]
    for base in range(12):
        words = [f"b{base}w{k}" for k in range(r.choice([5, 9, 60, 200]))] + shared * (base % 2)
        rows += [edited(r, words, min(len(words), r.randrange(4))) for _ in range(8)]
    rows = [(k, t, "en", "x", 1) for k, t in enumerate(rows)]
    sets = {k: shingles(t) for k, t, *_ in rows}
    kept = {x.doc_id for x in simhash_similar.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == exact_groups(sets) and len(kept) < len(rows)


def test_rows_that_share_an_id_are_judged_apart(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, one, 1, 1), (7, one, 2, 2), (7, two, 3, 3), (8, two, 4, 4), (None, one, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, near_id long")
    assert sorted(x.near_id for x in simhash_similar.keep_one(docs).collect()) == [1, 3, 5]


def test_groups_do_not_depend_on_the_order_of_rows(spark):
    r, rows = random.Random(11), []
    for base in range(6):
        words = [f"b{base}w{k}" for k in range(150)]
        rows += [" ".join(edited(r, words, r.randrange(7)).split()) for _ in range(25)]
    rows = [(k, t, "en", "x", 1) for k, t in enumerate(rows)]
    sets = {k: shingles(t) for k, t, *_ in rows}
    for parts in (1, 3, 7):
        r.shuffle(rows)
        kept = {x.doc_id for x in simhash_similar.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
        assert kept == exact_groups(sets)


def test_parity_bound_holds():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, 100, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, 100)], r.integers(0, 1 << 63, r.integers(0, 60), dtype=np.uint64)]))
        assert np.bitwise_count(simhash_similar.parities(a) ^ simhash_similar.parities(b)).sum() <= len(np.setxor1d(a, b))
