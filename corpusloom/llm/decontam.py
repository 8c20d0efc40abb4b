"""Benchmark decontamination by winnowing: shared fingerprints are joined and each hit is extended to its full span."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Rolling, map_arrow, mixed, sliding_min, utf8_rows, word_symbols

WINDOW = 10  # words
GRAM = 5  # words of a fingerprint
BLOCK_BYTES = 32 << 20  # of benchmark text that is sent to the executors at once
_LOW = np.uint64((1 << 24) - 1)


def words_of(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_symbols((data or b"").translate(LOWER), ALNUM)


def winnow(symbols: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the gram-word fingerprints kept: the least of every width successive ones, leftmost on ties."""
    if len(symbols) < gram + width - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = mixed(Rolling(symbols).grams(gram))
    kept = []
    step = 1 << 22
    for at in range(0, len(hashes) - width + 1, step):
        part = hashes[at : at + step + width - 1]
        packed = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        low = sliding_min(packed, width) & _LOW
        kept.append(at + low[np.flatnonzero(np.diff(low, prepend=np.uint64(1 << 60)))].astype(np.int64))
    at = np.unique(np.concatenate(kept))
    return at, hashes[at]


class Index:
    """Items of a bounded block of the benchmark: their words, their winnowed fingerprints, and their windows."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names = [name for name, _ in items]
        words = [words_of(text)[0] for _, text in items]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), self.sizes)
        prints, places = [], []
        for k, w in enumerate(words):
            at, h = winnow(w, GRAM, WINDOW - GRAM + 1)
            prints.append(h)
            places.append(at + self.base[k])
        prints, places = np.concatenate([*prints, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)])
        order = np.argsort(prints, kind="stable")
        self.prints, self.places = prints[order], places[order]
        #: Items of fewer words are one window each; hash -> items, by length.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(words):
            if 0 < len(w) < WINDOW:
                self.short.setdefault(len(w), {}).setdefault(int(mixed(Rolling(w).grams(len(w)))[0]), []).append(k)

    def hits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal shared spans of WINDOW words or more as (start, length, item), and the short items' windows."""
        starts, lengths, items = [], [], []
        at, h = winnow(symbols, GRAM, WINDOW - GRAM + 1)
        lo, hi = np.searchsorted(self.prints, h, "left"), np.searchsorted(self.prints, h, "right")
        many = hi - lo
        if many.sum():
            here = np.repeat(at, many)
            there = self.places[np.arange(int(many.sum())) + np.repeat(lo - (np.cumsum(many) - many), many)]
            s, n, k = self._extended(symbols, here, there)
            starts, lengths, items = [s], [n], [k]
        for size, known in self.short.items():
            if len(symbols) >= size:
                grams = mixed(Rolling(symbols).grams(size))
                for p in np.flatnonzero(np.isin(grams, np.fromiter(known, np.uint64, len(known)))).tolist():
                    for k in known[int(grams[p])]:
                        starts.append([p])
                        lengths.append([size])
                        items.append([k])
        join = lambda x: np.concatenate([np.asarray(y, np.int64) for y in [*x, []]])
        return join(starts), join(lengths), join(items)

    def _extended(self, symbols: np.ndarray, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grow each hit left and right while the words agree. Hits on one diagonal that one span covers are grown once."""
        k = self.item[there]
        first, last = self.base[k], self.base[k + 1]
        left, right = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        grow = np.arange(len(here))
        while len(grow):
            h, t = here[grow] - left[grow] - 1, there[grow] - left[grow] - 1
            ok = (h >= 0) & (t >= first[grow])
            grow, h, t = grow[ok], h[ok], t[ok]
            grow = grow[symbols[h] == self.words[t]]
            left[grow] += 1
        grow = np.arange(len(here))
        while len(grow):
            h, t = here[grow] + right[grow], there[grow] + right[grow]
            ok = (h < len(symbols)) & (t < last[grow])
            grow, h, t = grow[ok], h[ok], t[ok]
            grow = grow[symbols[h] == self.words[t]]
            right[grow] += 1
        start, size = here - left, left + right
        whole = size >= WINDOW
        found = np.unique(np.stack([start[whole], size[whole], k[whole]]), axis=1)
        return found[0], found[1], found[2]


_SCHEMA = "doc_id long, text string, n_words long, spans binary, items array<string>"


def _block(docs: DataFrame, items: list[tuple[str, bytes]], first: bool) -> DataFrame:
    """docs with n_words, the hit word spans (pairs of 64-bit start and end) and the items that occur, of one block and those before it."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        index = Index(sent.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, spans, names = [], [], []
            for i, data in enumerate(utf8_rows(batch.column(1))):
                symbols = words_of(data)[0]
                start, size, item = index.hits(symbols)
                found, seen = np.stack([start, start + size], axis=1), {index.names[k] for k in np.unique(item).tolist()}
                if not first:
                    found = np.concatenate([np.frombuffer(batch.column(3)[i].as_py(), "<i8").reshape(-1, 2), found])
                    seen.update(batch.column(4)[i].as_py())
                n_words.append(len(symbols))
                spans.append(np.unique(found, axis=0).astype("<i8").tobytes() if len(found) else b"")
                names.append(sorted(seen))
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n_words, pa.int64()), pa.array(spans, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

        return each

    return map_arrow(docs, make, _SCHEMA)


def covered(spans: bytes) -> int:
    """Words inside any of the spans."""
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    total, reach = 0, 0
    for s, e in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most block_bytes of text (or one item, if it alone is longer), one on the driver at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(size // block_bytes) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(str(r.item_id), r.text.encode()) for r in part.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (hit word ranges) and items.

    Training and test texts are winnowed alike: 5-word hashes, the least of every 6 kept, so a shared span of 10 words
    holds a shared fingerprint; each joined fingerprint is extended to the maximal shared span, which is what counts.
    Items of fewer than 10 words are matched whole. The benchmark is measured first and sent in blocks of bounded size
    (32 MB of text); every row carries its spans and items from block to block, so nothing is shuffled.
    A null text has no words; null item texts are skipped; repeated items count once by their id; rows that share a
    doc_id and text give equal rows; an empty benchmark hits nothing.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k, block in enumerate(blocks_of(benchmark, block_bytes)):
        found = _block(found, block, not k)
    found = found.drop("text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = [covered(s) for s in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            rows = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), batch.column(2), batch.column(3)]
            return pa.RecordBatch.from_arrays(rows, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])

        return each

    return map_arrow(found, make, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans binary, items array<string>")


def clean_texts(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that share no window with the benchmark, in one streamed pass a block and without a shuffle."""
    place = docs.columns.index("text")
    for block in blocks_of(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            index = Index(sent.value)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                clean = [not len(index.hits(words_of(data)[0])[0]) for data in utf8_rows(batch.column(place))]
                return batch.filter(pa.array(clean, pa.bool_()))

            return each

        docs = map_arrow(docs, make, docs.schema)
    return docs
