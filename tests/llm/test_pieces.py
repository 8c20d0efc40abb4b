"""The piece encoder against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from corpusloom.llm import pieces
from corpusloom.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    r = random.Random(7)
    some = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    out = [None, "", " ", " " * 41, "  a" * 3 + " " * 9 + "b", "▁" * 5 + "a▁b", "日本語 ελλ\x00😀", "é ﬁ　", "<s></s><0x41><unk>", "\n\n\t", "x" * 33, "x" * 32]
    out += ["a" * 70_000, "the" * 9000 + " " * 1000, some("abcdef ", 50_000, 50_000), "same text", "same text"]
    out += [some(" ▁abehtin\n😀é\x00日 1._", 0, 80) for _ in range(400)]
    return out + [some("thein ", 0, 200) for _ in range(200)]


def digests(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_same_as_the_library(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, [k], "y") for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>, n_tokens string")
    encoded = pieces.encode_pieces(docs, MODEL, keep_ids=True).cache()
    found = {r.doc_id: r for r in encoded.collect()}
    assert {k: tuple(r)[1:4] for k, r in found.items()} == {k: digests(library, t) for k, t in enumerate(texts)}
    assert [found[k].ids for k in range(20)] == [library.encode(t or "", add_eos=True) for t in texts[:20]]
    back = {r.doc_id: r.text for r in pieces.decode_pieces(encoded, MODEL).collect()}
    assert back == {k: library.decode(found[k].ids) for k in found}
    assert pieces.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()[0].text is None
    encoded.unpersist()


def test_repeated_ids_and_no_rows(spark, library):
    docs = spark.createDataFrame([(1, "one"), (1, "two words"), (None, "three")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in pieces.encode_pieces(docs, MODEL).collect()) == sorted(len(library.encode(t, add_eos=True)) for t in ("one", "two words", "three"))
    assert pieces.encode_pieces(docs.limit(0), MODEL).collect() == []


def test_table_is_emptied_at_its_limit(library):
    p = pieces.load(MODEL)
    small = pieces.UnitCache(p.chunks, p.segments, pieces.np.int32, limit=5)
    texts = [t for t in odd_texts() if t][:60]
    assert [ids.tolist() for ids in small.texts(texts, together=50)] == [library.encode(t) for t in texts]
    assert len(small.index) <= 5


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op13_sentencepiece"](spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == {k: digests(library, t) for k, t in docs.items()}
