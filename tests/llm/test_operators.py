"""The ten operators on small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import bigru, bpe, components, decontam, kneser_ney, mkv, pii, seekable, simhash, substring_fm, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, key string, route int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "ku", "lé", "Or", "ti", "x"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, long = prose(60), prose(3000)
    out = [None, "", " \n ", "one", "two words", common, common, f"{prose(30)} {common} {prose(30)}", f"{common} {prose(5)}\t{common}", long, long.replace("ba", "bo", 3), "a" * 500, "a" * 250, "ab" * 900, prose(19), prose(20)]
    return [(k, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def covered(sequences, window):
    seen, out = set(), {}
    for k, s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            w = bytes(s[i : i + window]) if isinstance(s, bytes) else tuple(s[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[k] = gone
    return out


def test_simhash(docs, rows, none):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = {k: brute(t) for k, t in rows}
    found = by_id(simhash.near_duplicates(docs))
    assert {k: r.fp % (1 << 64) for k, r in found.items()} == prints
    root = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {k: r.component_id for k, r in found.items()} == root
    assert simhash.near_duplicates(none).count() == 0


def test_balls_are_complete(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    every = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) if r.random() < 0.7 else b ^ 7 for b in base for _ in range(4)} | set(base))
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    found = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    near = {x: [y for y in every if (x ^ y).bit_count() <= 2] for x in every}
    for x, s in zip(every, signed, strict=True):
        for y in near[x]:
            t = signed[every.index(y)]
            assert found.get(s, s) == found.get(t, t)


def test_simhash_keeps_repeated_rows(spark):
    rows = [(5, "one two three four", 1), (5, "one two three four", 2), (None, "one two three four", 3), (9, None, 4), (None, "", 5)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [(0, 5), (0, 9), (5, 5), (5, 5), (9, 9)]


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_repeated_words(docs, rows, none):
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    gone, found = covered(split, 20), by_id(substring_fm.repeated_words(docs))
    for k, w in split:
        kept = " ".join(x for x, g in zip(w, gone[k], strict=True) if not g)
        assert (found[k].n_words, found[k].n_removed, found[k].kept_sha256) == (len(w), sum(gone[k]), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_fm.repeated_words(none).count() == 0


def test_repeated_bytes(docs, rows, none):
    raw = [(k, (t or "").encode()) for k, t in rows]
    gone, found = covered(raw, 100), by_id(suffix_dedup.repeated_bytes(docs))
    for k, b in raw:
        kept = bytes(x for x, g in zip(b, gone[k], strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone[k], [False, *gone[k]], strict=False))
        assert (found[k].n_bytes, found[k].n_removed, found[k].n_spans, found[k].kept_sha256) == (len(b), sum(gone[k]), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.repeated_bytes(none).count() == 0


def test_repeats_with_odd_ids(spark):
    t = " ".join(f"w{k}" for k in range(60))
    found = suffix_dedup.repeated_bytes(spark.createDataFrame([(None, t), (1, t), (1, t), (1, t + " more")], "doc_id long, text string")).collect()
    assert len(found) == 4
    assert [r.n_removed for r in found if r.doc_id is None] == [0]
    assert sum(r.n_removed == len(t) for r in found) == 3


def test_heavy_keys_take_the_other_way(docs, rows, monkeypatch):
    from corpusloom.llm import repeats

    monkeypatch.setattr(repeats, "GROUP_ROWS", 1)
    gone = covered([(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows], 20)
    assert {k: r.n_removed for k, r in by_id(substring_fm.repeated_words(docs)).items()} == {k: sum(g) for k, g in gone.items()}


@pytest.mark.parametrize("fold", [1, 700, 1_000_000])
def test_pairs_of_ranks_in_any_folds(fold, monkeypatch):
    """All positions of texts over few passages, folded in tasks of two documents, sorted and reranked, against the strings themselves."""
    monkeypatch.setattr(suffix_dedup, "FOLD_ROWS", fold)
    r = random.Random(11)
    passages = ["".join(r.choices("abcd ", k=r.choice((40, 130, 400)))) for _ in range(6)] + ["z" * 300]
    texts = ["".join(r.choices(passages, k=r.randrange(1, 6))) for _ in range(14)]

    def places(n):  # runs of at most 69 windows, as segments have them
        return [at << 16 | min(69, n - 99 - at) << 8 for at in range(0, n - 99, 69)]

    moved = []
    for at in range(0, len(texts), 2):
        cols = [pa.array([at, at + 1]), pa.array(texts[at : at + 2]), pa.array([places(len(t)) for t in texts[at : at + 2]], pa.list_(pa.int64()))]
        for batch in suffix_dedup._paired(iter([pa.RecordBatch.from_arrays(cols, ["doc", "text", "places"])])):
            moved += batch.to_pylist()
    moved.sort(key=lambda x: (x["one"], x["two"], x["doc"], x["place"]))
    batches = [pa.RecordBatch.from_pylist(moved[k : k + 97], pa.schema([(c, pa.int64()) for c in ("one", "two", "doc", "place")])) for k in range(0, len(moved), 97)]
    found = []
    for batch in suffix_dedup._reranked(iter(batches)):
        for row in batch.to_pylist():
            found += [(row["doc"], (row["place"] >> 16) + k) for k in range(row["place"] >> 8 & 255)]
    seen, want = set(), []
    for k, t in enumerate(texts):
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                want.append((k, at))
            seen.add(t[at : at + 100])
    assert sorted(found) == want


def test_decontamination(spark, docs, rows, none):
    common = rows[5][1]
    items = [("a", " ".join(common.split()[10:25])), ("b", "Two  words!"), ("c", None), ("d", "nothing like it"), ("e", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    for block in (decontam.BLOCK_BYTES, 40):
        found = by_id(decontam.contamination(docs, bench, block))
        for k, t in rows:
            w, hit, seen = words(t), set(), set()
            for n in {len(x) for x in windows}:
                for i in range(len(w) - n + 1):
                    if (s := windows.get(tuple(w[i : i + n]))) is not None:
                        seen |= s
                        hit.update(range(i, i + n))
            assert (found[k].n_words, found[k].n_hit, sorted(found[k]["items"])) == (len(w), len(hit), sorted(seen)), k
    kept = {r.doc_id for r in decontam.clean_texts(docs, bench).collect()}
    assert kept == {k for k, r in found.items() if not r.contaminated}
    assert decontam.contamination(none, bench).count() == 0


def test_decontamination_keeps_rows_in_any_number_of_blocks(spark):
    leak = [" ".join(f"{x}{k}" for k in range(12)) for x in "abc"]
    bench = spark.createDataFrame(list(zip("abc", leak, strict=True)), "item_id string, text string")
    clean = " ".join(f"z{k}" for k in range(12))
    rows = [(None, leak[0]), (None, clean), (None, leak[1]), (7, leak[0]), (7, clean), (7, clean), (7, leak[2]), (8, None), (8, None), (9, " ".join(leak))]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], SCHEMA)
    found = [sorted(map(repr, decontam.contamination(docs, bench, block).collect())) for block in (decontam.BLOCK_BYTES, 40, 10)]
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    assert decontam.contamination(docs, bench, 40).where("contaminated").count() == 5


def test_bpe_is_tiktoken(docs, rows, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True)
    back = {r.doc_id: r.text for r in bpe.decode_documents(found, RANKS).collect()}
    for k, t in rows:
        assert np.frombuffer(by_id(found)[k]["ids"], "<u4").tolist() == theirs.encode_ordinary(t or "")
        assert back[k] == (t or "")
    cache, r = bpe.encoder(bpe.load(RANKS), public_tokenizers.PATTERN), random.Random(1)
    mixed = ["".join(r.choice("ab \n\t'sé漢1,. \x1c  the😀") for _ in range(r.randint(0, 60))) for _ in range(300)]
    assert [x.tolist() for x in cache.texts(mixed)] == [theirs.encode_ordinary(x) for x in mixed]
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("lacing", [mkv.XIPH, mkv.FIXED, mkv.EBML_LACING])
def test_lacing(lacing):
    packets = [b"a" * 300] * 3 if lacing == mkv.FIXED else [b"a" * 300, b"b", b"c" * 70_000, b""]
    body = mkv.element(mkv.CLUSTER, mkv._uint(mkv.CLUSTER_TIME, 7) + mkv.simple_block(1, 3, packets, lacing))
    data = mkv.element(mkv.EBML, mkv.element(mkv.DOC_TYPE, b"matroska")) + mkv.element(mkv.SEGMENT, body)
    found = mkv.parse(data)
    assert [data[a : a + n] for _, _, a, n, _, _ in found.packets] == packets
    assert found.packets[0][1] == 10 and found.doc_type == "matroska"


@pytest.mark.parametrize("segments", [1, 2])
def test_unknown_sizes(spark, segments):
    def unknown(name, body):
        return name.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body

    head, packets = mkv.element(mkv.EBML, mkv.element(mkv.DOC_TYPE, b"matroska")), [bytes([65 + k]) * (5 + k) for k in range(6)]
    clusters = [unknown(mkv.CLUSTER, mkv._uint(mkv.CLUSTER_TIME, 100 * k) + mkv.element(0xEC, b"void") + b"".join(mkv.simple_block(1, t, [p], mkv.NO_LACING) for t, p in enumerate(packets[2 * k : 2 * k + 2]))) for k in range(3)]
    cues = [mkv.element(mkv.CUE_POINT, mkv._uint(mkv.CUE_TIME, 100 * k) + mkv.element(mkv.CUE_POSITIONS, mkv._uint(mkv.CUE_TRACK, 1) + mkv._uint(mkv.CUE_CLUSTER, sum(map(len, clusters[:k]))))) for k in range(3)]
    data = (head + unknown(mkv.SEGMENT, b"".join(clusters) + mkv.element(mkv.CUES, b"".join(cues)))) * segments
    found = mkv.parse(data)
    assert [data[a : a + n] for _, _, a, n, _, _ in found.packets] == packets * segments
    assert [t for _, t, *_ in found.packets] == [0, 1, 100, 101, 200, 201] * segments and found.clusters == 3 * segments
    assert [t for t, _, _ in found.cues] == [0, 100, 200] * segments and all(data[a : a + 4] == mkv.CLUSTER.to_bytes(4, "big") for _, _, a in found.cues)
    assert mkv.packet_table(spark.createDataFrame([(1, data)], "doc_id long, media binary")).where("error is null").count() == 6 * segments


def test_media(spark, docs, rows, none):
    found = mkv.store_texts(docs, keep_media=True)
    for k, t in rows:
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert by_id(found)[k].payload_sha256 == hashlib.sha256(whole).hexdigest()
    packets = mkv.packet_table(found.where("doc_id = 9"))
    assert packets.count() * 576 == by_id(found)[9].payload_bytes
    bad = mkv.packet_table(spark.createDataFrame([(1, b"\x1a\x45\xdf\xa3\xff\x00\x00"), (2, None), (3, b"")], "doc_id long, media binary")).collect()
    assert all(r.error for r in bad)
    assert mkv.store_texts(none).count() == 0


def test_personal_data(spark, none):
    cases = ["mail me.x@mail7.example.com or +1 (644) 555-7859.", "10.0.0.256 and 10.1.2.3.4", "4799134681044206", "4799134681044207", None, "", "a@b..c@d.e_f@g.h", "@" * 50 + "1" * 50, "x" * 2000 + "@y", "1." * 3000]
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(s))) % 10 == 0

    def brute(t):
        out = []
        for rank, (kind, p) in enumerate(shapes.items()):
            for m in re.finditer(p, t, re.ASCII):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                    out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        return ",".join(x[-1] for x in sorted(out))

    found = by_id(pii.personal_data(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")))
    for k, t in enumerate(cases):
        assert found[k].base_sha256 == hashlib.sha256(brute(t or "").encode()).hexdigest(), (k, found[k].spans, brute(t or ""))
    assert pii.personal_data(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(k, f"please ring us on +1 (644) 555-78{k:02d} today") for k in range(10, 22)]
    rows = [*seeds, (50, "please ring us on 5557859 today"), (51, "in the year 1999 we ring")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(pii.personal_data(docs))
    assert found[50].spans == "phone:18:25" and found[50].n_phone == 0 and found[50].n_found == 1
    assert found[51].spans == ""
    assert {r.doc_id: r.text for r in pii.masked(docs).collect()}[50] == "please ring us on [PHONE] today"


def test_contexts_on_both_sides_and_secrets(spark):
    seeds = [(k, f"by token = \"{k:032x}ab{k}\" and so") for k in range(100, 120)] + [(k, f"mail{k}@x{k}.org signed it off") for k in range(200, 220)]
    rows = [*seeds, (1, "TOKEN = \"12345678\"!! Ok"), (2, "joe99887@home signed it"), (3, "1999 and 12345 others"), (4, "in 10.5.2024 at")]
    found = by_id(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[100].spans == "secret:12:49" and found[100].n_found == 1
    assert found[1].spans == "secret:9:17" and found[2].spans == "email:0:13"
    assert found[3].spans == found[4].spans == ""


def test_contexts_find_secrets_of_other_shapes(spark):
    """Planted tokens without a shape are found by what stands around them; numbers elsewhere and glued cards are left alone."""
    key = lambda k: "".join(random.Random(k).choice("GHJKLMNPQRSTUVWXYZ") for _ in range(20)) + str(k)
    rows = [(k, f'set api token = "{hashlib.md5(str(k).encode()).hexdigest()}"### 4785380592391139 and go') for k in range(40)]
    planted = {100 + k: f'set api token = "{key(k)}" and go' for k in range(10)}
    clean = {200 + k: f"order {10_000_000 + k * 7} of the year and set 2{k:05} pieces" for k in range(30)} | {300: 'token = "short7"', 301: "set api token = none"}
    found = by_id(pii.personal_data(spark.createDataFrame(rows + list((planted | clean).items()), "doc_id long, text string")))
    for k, text in rows:
        secret = text.index('"') + 1
        assert found[k].spans.startswith(f"secret:{secret}:{secret + 32}") and found[k].n_found == 1
    assert {k: found[k].spans for k in planted} == {k: f"secret:17:{17 + len(key(k - 100))}" for k in planted}
    assert all(found[k].spans == "" for k in clean)


def test_masked_text_is_the_text_cut_at_its_spans(spark):
    r = random.Random(9)
    pieces = ["a1@b.co", "10.0.0.1", "+1 (644) 555-7859", "word", "é😀", " ", "\n", "x" * 1023, "y" * 1024, "z" * 3000, ". "]
    rows = [(k, "".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randint(1, 30)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in pii.personal_data(docs).collect()}
    masked = {x.doc_id: x.text for x in pii.masked(docs).collect()}
    for k, text in rows:
        out, end = "", 0
        for kind, low, high in ((s[0], int(s[1]), int(s[2])) for s in spans[k]):
            if low < end:
                end = max(end, high)
                continue
            out += text[end:low] + f"[{kind.upper()}]"
            end = high
        assert masked[k] == out + text[end:]


def test_many_spans_are_linear(spark):
    docs = spark.createDataFrame([(1, "a1@b.co é " * 60_000)], "doc_id long, text string")
    began = time.time()
    assert pii.masked(docs).first().text == "[EMAIL] é " * 60_000
    assert time.time() - began < 60


def test_long_tokens_are_linear(spark):
    rows = [(1, "1" + "." * 1_000_000 + "x " + "@." * 200_000), (2, "7" * 300_000), (3, "+" + "(" * 500_000 + "9"), (4, "a" * 500_000 + "@" + "b." * 300_000)]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, _id long, pii_hash long, _cuts long")
    began = time.time()
    out = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert time.time() - began < 60 and out[2] == rows[1][1] and pii.masked(docs).columns == docs.columns


def test_token_files(docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>  \n<|endoftext|>x<|endoftext", "tab\tand \x1c odd  \xa0 blanks \n", "it's we'll  3 4\n\n\nend  "]
    rows = [*rows, *((100 + k, x) for k, x in enumerate(odd))]
    docs = docs.union(docs.sparkSession.createDataFrame([(100 + k, x, "en", "x", 1) for k, x in enumerate(odd)], SCHEMA))
    shards = seekable.write_shards(docs, path, public_tokenizers.PATTERN, f"file://{tmp_path}/ids")
    found, at = by_id(seekable.read_shards(shards)), 0
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[k].start, found[k].n_tokens, found[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        assert next(x for _, x in seekable.read_file(found[k].path, {k})).tolist() == ids
    broken = next(tmp_path.glob("ids/*.zst"))
    whole = broken.read_bytes()
    frame = bytearray(whole)
    frame[20] ^= 1
    broken.write_bytes(frame)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(seekable.read_file(f"file://{broken}"))
    broken.write_bytes(whole)
    broken.write_bytes(broken.read_bytes()[:-1] + b"?")
    with pytest.raises(ValueError, match="seek table"):
        list(seekable.read_file(f"file://{broken}"))
    assert seekable.token_files(none, path, public_tokenizers.PATTERN).count() == 0


def test_units_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(7)
    t, units = Tokenizer.from_file(path), seekable.unit_encoder(path, public_tokenizers.PATTERN)
    mixed = ["".join(r.choice(["the", " ", "  ", "\n", "\t", "it's", "é", "漢", "1", "23", ",", ". ", "\u2003", "<|endoftext|>", "😀", "word", " \n "]) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    assert [x.tolist() for x in units.texts(mixed)] == [t.encode(x, add_special_tokens=False).ids for x in mixed]


def brute_kneser_ney(texts, order):
    """The probability of a character after a history, by the definition."""
    counts = [None] + [{} for _ in range(order)]
    padded = ["\x02" * (order - 1) + " ".join(t.lower().split()) for t in texts]
    for t in padded:
        for i in range(order - 1, len(t)):
            g = t[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for m in range(order - 1, 0, -1):
        kinds, many = {}, {}
        for g in {t[i - m : i + 1] for t in padded for i in range(order - 1, len(t))}:
            kinds[g[1:]] = kinds.get(g[1:], 0) + 1
        for t in padded:
            for i in range(order - 1, len(t)):
                many[t[i - m + 1 : i + 1]] = many.get(t[i - m + 1 : i + 1], 0) + 1
        counts[m] = {g: many[g] if g[0] == "\x02" else kinds[g] for g in kinds}
    discounts = [None]
    for m in range(1, order + 1):
        n = [sum(c == k for c in counts[m].values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        discounts.append([0.0] + [max(0.1 * k, min(k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)])
    alphabet = {g[-1] for g in counts[order]}

    def p(c, h):
        m = len(h) + 1
        below = p(c, h[1:]) if h else 1 / (len(alphabet) + 1)
        of = {g: n for g, n in counts[m].items() if g[:-1] == h}
        if not of:
            return below
        total, d = sum(of.values()), discounts[m]
        gamma = sum(d[min(n, 3)] for n in of.values()) / total
        n = of.get(h + c, 0)
        return (n - d[min(n, 3)]) / total + gamma * below

    return p


def test_perplexity_is_kneser_ney(spark):
    r = random.Random(5)
    train = [" ".join(r.choice(["ab", "abc", "bca", "é", "cab"]) for _ in range(r.randrange(1, 25))) for _ in range(12)] + [""]
    seen = ["abc  cab", "zzz", "a", "", "ab ab\nbca é", "Ab \x02 cab" * 3]
    table = kneser_ney.model(spark.createDataFrame([("en", t) for t in train], "lang string, text string"), order=3)
    p = brute_kneser_ney(train, 3)
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(seen)], "doc_id long, text string, lang string")
    for most in (kneser_ney.MODEL_ROWS, 20):
        found = by_id(kneser_ney.perplexities(docs, kneser_ney.parts_of(table, most, 3)))
        for k, t in enumerate(seen):
            s = "\x02\x02" + " ".join(t.replace("\x02", " ").lower().split())
            logs = [np.log(p(s[i], s[i - 2 : i])) for i in range(2, len(s))]
            assert found[k].n_predicted == len(logs)
            assert found[k].perplexity is None if not logs else abs(found[k].perplexity - np.exp(-np.mean(logs))) < 1e-6


def test_perplexity(spark, none):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "then", "there", "other", "mother"]) for _ in range(r.randrange(20, 60)))
    rows = [(k, good(), "en", k, "x") for k in range(600)] + [(1190, "#$% @@! zzqx *** " * 20, "en", 1, ""), (1191, None, "en", 2, ""), (1192, "word", "xx", 3, ""), (1193, good(), None, 4, ""), (1190, "qqqq " * 9, "en", 5, ""), (None, good(), "en", 6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold long, _lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(600)], "doc_id long, quality int, toxic int")
    found = kneser_ney.classified(docs, labels).collect()
    gone = [x.doc_id for x in found if not x.keep]
    assert len(found) == len(rows) and gone.count(1190) == 2 and len(gone) <= 32 and not {1191, 1192, 1193, None} & set(gone)
    assert all(x.perplexity is None for x in found if x.doc_id in (1191, 1192))
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id: x.threshold for x in kept.collect() if x.doc_id in (1191, 1192)} == {1191: 2, 1192: 3}
    assert kneser_ney.classified(none, labels).count() == 0 and kneser_ney.keep_good(docs, labels.where("false")).count() == len(rows)


def test_gradients():
    r = np.random.default_rng(0)
    net = bigru.Network.fresh(["a", "b"], hidden=3)
    net.weights = {k: x.astype(np.float64) for k, x in net.weights.items()}
    data, mask = bigru.padded([b"abc", b"a", b"bcad"])
    label = np.array([0, 1, 1])
    _, g = net.gradients(data, mask, label)
    for k, x in net.weights.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in x.shape) if not k.startswith("W") else (int(r.choice([97, 98, 99, 100])), int(r.integers(0, 9)))
            x[at] += 1e-5
            up = net.gradients(data, mask, label)[0]
            x[at] -= 2e-5
            down = net.gradients(data, mask, label)[0]
            x[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4, k


def test_training_rows(spark):
    """The least hashes of each language; ties (repeated and null ids) by text."""
    r = random.Random(8)
    rows = [(r.choice([None, *range(40)]), r.choice(["x", "y", "z", None]) and f"text {r.random()}", r.choice(["en", "de", None])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    hashed = docs.select("lang", F.xxhash64("doc_id").alias("h"), "text").where("text is not null and lang is not null").collect()
    want = [(x.text, x.lang) for lang in ("de", "en") for x in sorted((x for x in hashed if x.lang == lang), key=lambda x: (x.h, x.text))[:25]]
    assert bigru.training_rows(docs, 25) == sorted(want, key=lambda x: (x[1], x[0]))
    assert bigru.training_rows(docs.where("false")) == []


def test_network_reads_every_byte(monkeypatch):
    """Labels and pooled probabilities of whole texts against the recurrences written out one position at a time."""
    monkeypatch.setattr(bigru, "CORE", 9)
    monkeypatch.setattr(bigru, "CONTEXT", 4)
    monkeypatch.setattr(bigru, "TOGETHER", 3)
    net = bigru.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    w = net.weights = {k: x.astype(np.float64) for k, x in net.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(d, data):
        out, state = [], np.zeros(3)
        for byte in data if d == "f" else data[::-1]:
            x = w["W" + d][byte]
            update, reset = sigmoid(x[:3] + state @ w["U" + d][:, :3]), sigmoid(x[3:6] + state @ w["U" + d][:, 3:])
            state = (1 - update) * state + update * np.tanh(x[6:] + (reset * state) @ w["V" + d])
            out.append(state)
        return out if d == "f" else out[::-1]

    seen = [b"", b"x", b"nine byte", "zw\u00f6lf, ein langer Text mit 3 Zahlen: 1, 2".encode(), b"ten bytes.", b"x"]
    found = net.texts(seen)
    for text, row in zip(seen, found, strict=True):
        want = np.zeros(7)
        for at in range(0, len(text), 9):
            low = max(0, at - 4)
            part = text[low : at + 13]
            both = np.concatenate([states("f", part), states("b", part)], axis=1)
            for k in range(at - low, min(len(part), at - low + 9)):
                p = np.exp(both[k] @ w["O"] + w["c"])
                p /= p.sum()
                want += np.concatenate([np.log(p), p, [1]])
        assert np.allclose(row, want) and row[-1] == len(text)


def test_network_reads_by_exponentials(monkeypatch):
    """No hyperbolic tangents on the way through texts, which take twice as long, and none of the steps that 512 sequences at a time would take."""
    net = bigru.Network.fresh(["a", "b"], seed=2)
    steps = []

    class Counted:
        def __getattr__(self, name):
            assert name != "tanh"
            if name == "matmul":
                steps.append(1)
            return getattr(np, name)

    texts = [bytes([k % 256]) * 8 for k in range(1024)]
    want = net.texts(texts)
    monkeypatch.setattr(bigru, "np", Counted())
    assert np.array_equal(net.texts(texts), want) and len(steps) == 2 * 2 * 8


@pytest.mark.filterwarnings("error")
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_network_saturates(kind):
    """Gates and candidates far beyond what an exponential holds."""
    net = bigru.Network.fresh(["a", "b"], hidden=4, seed=3)
    net.weights = {k: (x * (3000 if k[0] in "WUV" else 1)).astype(kind) for k, x in net.weights.items()}
    text = b"Some words, and more of them."
    logs = net.positions(*bigru.padded([text]))[:, 0]
    found = net.texts([text])[0]
    assert np.allclose(found[:2], logs.sum(axis=0), rtol=1e-4) and np.allclose(found[2:4], np.exp(logs).sum(axis=0), rtol=1e-4)


def test_languages(spark, none):
    r = random.Random(4)
    make = {"en": ["the", "thing", "with", "other"], "de": ["der", "schön", "nicht", "über"]}
    rows = [(k, " ".join(r.choice(make[lang]) for _ in range(30)), lang) for k in range(120) for lang in [["en", "de"][k % 2]]]
    docs = spark.createDataFrame([*rows, (500, None, "en"), (501, "12 34 !", "en"), (502, "½ ² 12 Ⅷ", "en"), (None, "the other thing", None), (600, "the other " * 40_000, None), (601, "the thing", None), (601, "the thing", None)], "doc_id long, text string, lang string")
    found = bigru.identify(docs, steps=60).collect()
    truth = {k: lang for k, _, lang in rows}
    held = [x for x in found if x.held_out and x.doc_id in truth]
    assert held and all(x.lang_pred == truth[x.doc_id] for x in held)
    assert {x.doc_id: x.lang_pred for x in found if x.doc_id in (500, 501, 502)} == {500: "und", 501: "und", 502: "und"}
    assert {x.doc_id: x.lang_pred for x in found if x.doc_id in (600, 601)} == {600: "en", 601: "en"} and len(found) == len(rows) + 7
    assert len({x.score for x in found if x.doc_id == 601}) == 1
    assert bigru.identify(none).count() == 0
