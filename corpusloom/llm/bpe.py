"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, gather, map_arrow, utf8_rows

NONE = np.int64(1 << 62)
CELLS = 1 << 20  # of the trees that are worked on at once
FEW = 8  # pieces are merged one by one

_PLAIN_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]")


def unit_splitter(pattern: str):
    """Cuts a text where no match of the pre-tokenizer pattern can reach across.

    Where blanks and line ends are the only white space, a run of them with the word behind it is a unit: no match
    holds white space after a word, and the look-ahead of the pattern sees the whole run. Other texts are cut by the
    pattern itself.
    """
    exact = regex.compile(pattern)
    return lambda text: exact.findall(text) if _ODD_SPACE.search(text) else _PLAIN_UNIT.findall(text)


class Merges:
    """The merges of a rank table: the rank of every pair of tokens whose bytes joined are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 24 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.pairs = dict(zip(keys, values, strict=True))
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        names = [b""] * size
        for token, rank in ranks.items():
            names[rank] = token
        self.size = np.array([len(x) for x in names], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.start[ids], self.size[ids])

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The token ids of each piece. A piece that is a token is that token; the others are merged, many at a time."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int64)
            elif not piece:
                out[i] = np.zeros(0, np.int64)
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            if len(rows) <= FEW:
                for i in rows:
                    out[i] = self._merge_one(pieces[i], width)
                continue
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_one(self, piece: bytes, width: int) -> np.ndarray:
        """_merge() of a single piece, on plain lists."""
        none, get = int(NONE), self.pairs.get
        shift, low, n = width.bit_length() - 1, width - 1, len(piece)
        token = self.first[np.frombuffer(piece, np.uint8)].tolist()
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = get(token[i] << 24 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value

        while (root := tree[1]) < none:
            at, rank = root & low, root >> shift
            right = after[at]
            beyond, ahead = after[right], before[at]
            token[at], after[at], live[right] = rank, beyond, False
            put(right, none)
            met = None
            if beyond < n:
                before[beyond] = at
                met = get(rank << 24 | token[beyond])
            put(at, none if met is None else met << shift | at)
            if ahead >= 0:
                met = get(token[ahead] << 24 | rank)
                put(ahead, none if met is None else met << shift | ahead)
        return np.array([t for t, on in zip(token, live, strict=True) if on], np.int64)

    def _merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Merges of pieces of at most width bytes, width being a power of two.

        Each piece has a segment tree over its byte positions. A leaf holds the rank of the pair that starts there,
        with the position in its low bits, so the root is the leftmost pair of the least rank. A merge takes the
        right token out of the list of live neighbours and changes at most three leaves, each carried to the root
        in log2(width) steps. The pieces of a batch take their merges in step.
        """
        n, depth = len(pieces), width.bit_length() - 1
        shift, low = np.int64(depth), np.int64(width - 1)
        size = np.array([len(p) for p in pieces], np.int64)
        inside = np.arange(width) < size[:, None]
        token = np.full((n, width), -1, np.int64)
        token[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        live = inside.copy()
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[after >= size[:, None]] = width
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        paired = inside[:, 1:]
        found = np.full((n, width - 1), NONE, np.int64)
        found[paired] = self.pair(token[:, :-1][paired], token[:, 1:][paired])
        tree[:, width:-1] = np.where(found < NONE, found << shift | np.arange(width - 1), NONE)
        span = width
        while span > 1:
            tree[:, span // 2 : span] = np.minimum(tree[:, span : 2 * span : 2], tree[:, span + 1 : 2 * span : 2])
            span //= 2
        token_, live_, after_, before_, tree_ = (x.reshape(-1) for x in (token, live, after, before, tree))
        rows = np.arange(n)
        while True:
            root = tree_[rows * 2 * width + 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            at, rank = root & low, root >> shift
            base, leaf = rows * width, rows * 2 * width + width
            right = after_[base + at]
            beyond, ahead = after_[base + right], before_[base + at]
            token_[base + at] = rank
            after_[base + at] = beyond
            live_[base + right] = False
            tree_[leaf + right] = NONE
            has = beyond < width
            new = np.full(len(rows), NONE)
            before_[(base + beyond)[has]] = at[has]
            met = self.pair(rank[has], token_[(base + beyond)[has]])
            new[has] = np.where(met < NONE, met << shift | at[has], NONE)
            tree_[leaf + at] = new
            had = ahead >= 0
            met = self.pair(token_[(base + ahead)[had]], rank[had])
            tree_[(leaf + ahead)[had]] = np.where(met < NONE, met << shift | ahead[had], NONE)
            top = np.concatenate([rows, rows, rows[had]]) * 2 * width
            node = np.concatenate([right, at, ahead[had]]) + width
            for _ in range(depth):
                node >>= 1
                tree_[top + node] = np.minimum(tree_[top + 2 * node], tree_[top + 2 * node + 1])
        flat, counts = token[live], live.sum(axis=1)
        return np.split(flat, np.cumsum(counts)[:-1])


@cache
def load(path: str) -> Merges:
    """The merges of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


@lru_cache(maxsize=1)
def encoder(merges: Merges, pattern: str) -> UnitCache:
    """The ids of texts, by units of them; a worker keeps the table between tasks."""
    split = regex.compile(pattern).findall

    def encode(units: list[str]) -> list[np.ndarray]:
        pieces = [split(u) for u in units]
        distinct = list(dict.fromkeys(p for many in pieces for p in many))
        known = dict(zip(distinct, merges.encode([p.encode() for p in distinct]), strict=True))
        return [known[many[0]] if len(many) == 1 else np.concatenate([known[p] for p in many] or [np.zeros(0, np.int64)]) for many in pieces]

    return UnitCache(unit_splitter(pattern), encode)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (binary, little-endian unsigned 32-bit).

    path names the rank file on each executor, pattern the pre-tokenizer's. Nothing is shuffled. A null text is the
    empty text (no tokens); rows that share a doc_id are each encoded; one document of any length is held at a time,
    and of a long run without white space each merge costs logarithmic time.
    """

    def make():
        merges = load(path)
        cache_ = encoder(merges, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, digest, back, kept = [], [], [], []
            for ids in cache_.texts((t or b"").decode() for t in utf8_rows(batch.column(1))):
                raw = ids.astype("<u4").tobytes()
                count.append(len(ids))
                digest.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(merges.decode(np.frombuffer(raw, "<u4").astype(np.int64)).tobytes()).hexdigest())
                kept.append(raw if keep_ids else None)
            rows = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                rows, names = [*rows, pa.array(kept, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(rows, names)

        return each

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table of doc_id and ids (binary); the inverse of encode_documents for valid UTF-8."""

    def make():
        merges = load(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if raw is None else merges.decode(np.frombuffer(raw, "<u4").astype(np.int64)).tobytes().decode(errors="replace") for raw in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return each

    return map_arrow(encoded.select("doc_id", "ids"), make, "doc_id long, text string")
