"""Longest common strings against difflib, and their cost on long and on periodic texts."""

import random
import time
from difflib import SequenceMatcher

from corpusloom.operators import compare
from corpusloom.plans import library


def test_as_difflib_finds_them():
    r = random.Random(5)
    for _ in range(600):
        a, b = ("".join(r.choice("ab" if r.random() < 0.5 else "abcé") for _ in range(r.randint(0, 40))) for _ in range(2))
        m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert compare.Substrings(b).longest(a) == ((m.a, m.b, m.size) if m.size else (0, 0, 0)), (a, b)


def test_long_and_periodic_texts_are_linear():
    r = random.Random(6)
    began = time.time()
    shared = "".join(r.choice("abcdefgh ") for _ in range(500))
    one, two = ("".join(r.choice("abcdefgh ") for _ in range(60_000)) for _ in range(2))
    found = compare.Substrings(two[:100] + shared + two).longest(one + shared)
    assert found == (60_000, 100, 500) or found[2] > 500
    assert compare.Substrings("ab" * 50_000).longest("ba" * 50_000) == (0, 1, 99_999)
    assert time.time() - began < 30


def test_pairs(spark):
    texts = spark.createDataFrame([(1, "x" * 30 + "the common part of both" + "y" * 9), (2, "nothing here"), (3, None), (4, "the common part of both")], "id int, text string")
    refs = spark.createDataFrame([("a", "see the common part of both texts"), ("b", None), ("c", "the common part"), ("d", "")], "ref string, ref_text string")
    found = {tuple(x) for x in compare.common_strings(texts, refs, 15).collect()}
    assert found == {(1, "a", 30, 4, 23), (1, "c", 30, 0, 15), (4, "a", 0, 4, 23), (4, "c", 0, 0, 15)}
    assert compare.common_strings(texts, refs.limit(0), 15).collect() == []


def test_every_copy_has_its_pairs(spark, tmp_path):
    """Copies, texts that differ in case only and rows without an id have what the first of them has."""
    shared = "Forty characters and some more of one benchmark item"
    docs = [(3, f"a {shared} b"), (1, f"a {shared} b"), (2, f"A {shared.upper()} B"), (5, f"c {shared[:45]}"), (None, f"a {shared} b"), (6, shared[:39]), (7, None), (8, None)]
    items = [(10, f"x {shared}"), (11, f"X {shared}"), (12, "nothing of it"), (13, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = library.common_strings(spark, str(tmp_path)).collect()
    want = [(d, i, SequenceMatcher(None, t.lower(), u.lower(), autojunk=False).find_longest_match().size) for d, t in docs for i, u in items if t and u]
    assert sorted(map(tuple, found), key=str) == sorted((x for x in want if x[2] >= 40), key=str) and len(found) == 10


def test_texts_that_share_k_characters_share_a_key():
    r = random.Random(7)
    for _ in range(300):
        shared = "".join(r.choice("abé𝄞 ") for _ in range(40))
        one, two = ("".join(r.choice("abcdé𝄞 ") for _ in range(r.randint(0, 60))) + shared + "".join(r.choice("xyz") for _ in range(r.randint(0, 60))) for _ in range(2))
        assert set(compare.window_keys(one, 30, 11)) & set(compare.window_keys(two, 30, 11))
    long = "".join(r.choice("abcdefgh ") for _ in range(100_000))
    assert len(compare.window_keys(long, 30, 11)) < 20_000 and not len(compare.window_keys("a" * 39, 30, 11))


def test_line_ratios_are_difflibs():
    r = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab" if r.random() < 0.4 else "abcdefgé ") for _ in range(r.randint(0, 30))) for _ in range(2))
        b = a[: r.randint(0, 30)] + b if r.random() < 0.4 else b
        ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert compare.line_ratio(a, b) == ratio and (compare.line_ratio(a, b, 0.5) == ratio if ratio >= 0.5 else compare.line_ratio(a, b, 0.5) < 0.5)
