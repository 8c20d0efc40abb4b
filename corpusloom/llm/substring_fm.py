"""Substring deduplication with compressed FM-indexes: repeated word windows, by backward search over wavelet matrices."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NOT_SPACE, map_arrow, utf8_rows, word_symbols
from .repeats import Grain, early_windows, identified, place_lists, removed, with_places

WINDOW = 20  # words
ANCHOR = 8  # words


def _symbols(data: bytes) -> np.ndarray:
    return word_symbols(data, NOT_SPACE)[0]


GRAIN = Grain(WINDOW, ANCHOR, _symbols)


class Bits:
    """A bit vector in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """A compressed full-text index of a sequence of non-negative numbers below size, 0 being a separator.

    The Burrows-Wheeler transform is kept as a wavelet matrix: a bit vector for each bit of the alphabet. Suffixes
    are sorted by their first depth symbols, by prefix doubling, so patterns of up to depth symbols can be sought.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        while reach < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - reach] = rank[reach:] + 1 if n > reach else 0
            pair = rank * np.int64(max(n, size) + 2) + ahead
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        bwt = text[self.suffixes - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.width = max(1, int(size - 1).bit_length())
        self.levels = []
        for bit in range(self.width - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(np.uint8)
            self.levels.append(Bits(ones))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        self.least = [self.suffixes]
        step = 1
        while 2 * step <= n:
            last = self.least[-1]
            self.least.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of symbol + pattern, from those of pattern."""
        start = np.zeros(len(symbol), np.int64)
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.width - 1 - k) & 1).astype(bool)
            at = level.ones(np.concatenate([low, high, start])).reshape(3, -1).astype(np.int64)
            low = np.where(one, level.zeros + at[0], low - at[0])
            high = np.where(one, level.zeros + at[1], high - at[1])
            start = np.where(one, level.zeros + at[2], start - at[2])
        first = self.smaller[symbol] - start
        return first + low, first + high

    def first_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position among the suffixes of each range (not empty)."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            out[here] = np.minimum(self.least[k][low[here]], self.least[k][high[here] - (1 << k)])
        return out

    def matching(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics up to threshold of the text's prefixes that stop at ends: the length of the longest suffix that
        occurs at two places or more, and the first place of it where that length reaches threshold (else -1)."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes), np.int64)
        length, place = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
        live = np.arange(len(ends))
        for step in range(1, threshold + 1):
            low, high = self.extend(text[ends[live] - step], low, high)
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            if not len(live):
                break
            length[live] = step
        reached = length[live] == threshold
        place[live[reached]] = self.first_place(low[reached], high[reached])
        return length, place


def searched(key: np.ndarray, count: np.ndarray, symbols: list[np.ndarray]) -> np.ndarray:
    """Of a shard's segments: which of their windows also start earlier in the shard.

    The segments, each behind a separator, make the index; then they stream past it. All places of a window are in
    segments of its key, which stand in the order of documents, so the least place is the earliest.
    """
    sizes = np.array([len(s) for s in symbols], np.int64)
    flat = np.concatenate(symbols)
    names, ids = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1
    text = np.zeros(len(flat) + len(symbols), np.int64)
    text[np.arange(len(flat)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)] = ids + 1
    index = FMIndex(text, len(names) + 1, WINDOW)
    at = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    place = index.matching(text, at + WINDOW, WINDOW)[1]
    return (place >= 0) & (place < at)


def repeated_words(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with keep_text also kept (the remaining words).

    Words lie between ASCII white space. Windows are routed by their anchor gram, so that a shard holds all segments
    a window of its own can occur in; segments that repeat whole, and keys that occur once, are settled by hash on
    the way. The rest are indexed shard by shard, about 20,000 segments at a time, and streamed past their shard's
    FM-index. Null has no words; ids that repeat or are null are handled as in repeated_bytes().
    """
    search, whole = identified(docs)
    marked = with_places(whole, early_windows(search, GRAIN, searched))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data, places in zip(utf8_rows(batch.column(1)), place_lists(batch.column(2)), strict=True):
                words = (data or b"").split()
                gone = removed(places, WINDOW, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if len(places) else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            rows = [batch.column(0), pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                rows, names = [*rows, pa.array(list(cols[3]), pa.string())], [*names, "kept"]
            return pa.RecordBatch.from_arrays(rows, names)

        return each

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return map_arrow(marked, make, schema)
