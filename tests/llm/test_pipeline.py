"""The pipeline's rows against its stages done one document at a time."""

import base64
import hashlib
import re

import corpus_pipeline
import public_tokenizers
import tiktoken

from corpusloom.llm import kneser_ney, pii

SF = "/root/testdata/sf0.001"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def one_of_each(texts):
    """The ids that are the least of their group: links are pairs of texts whose sets of five-word shingles are alike to four fifths."""
    sets = {}
    for k, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k for k in sets if top(k) == k}


def clean(text, items):
    """Whether no window of ten words of an item (all its words, if they are fewer) stands in the text."""
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    own = words(text)
    for item in items:
        w = words(item)
        n = min(10, len(w))
        if n and {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} & {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}:
            return False
    return True


def cut(text, spans):
    """The text with its spans as kinds; what overlaps is one."""
    out, end = "", 0
    for kind, low, high in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if low >= end:
            out += text[end:low] + f"[{kind.upper()}]"
        end = max(end, high)
    return out + text[end:]


def test_rows_of_the_pipeline(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in kneser_ney.classified(docs, labels).where("keep").collect()}
    assert 100 < len(texts) < docs.count()
    texts = {k: texts[k] for k in one_of_each(texts)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {k: t for k, t in texts.items() if clean(t, items)}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(left).collect()}
    assert sum(map(bool, spans.values())) > 3
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for k, t in texts.items():
        t = cut(t or "", spans[k])
        ids = library.encode_ordinary(t)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-duplicates", "benchmark decontamination", "personal data", "byte-level BPE"]
