"""SentencePiece BPE encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, gather, map_arrow, utf8_rows

MARK = "▁"  # stands for a blank in normalised text
WIDEST = 32  # characters of a chunk that is merged in step with others
CELLS = 1 << 19  # of the symbols that are worked on at once
NONE = np.int64(1 << 62)

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback and without user-defined symbols."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(map(m.is_unused, plain)):
            raise ValueError("models with unused pieces are segmented again after the merges, which is not done here")
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if m.unk_id() in self.bytes:
            raise ValueError("the model has no byte fallback")
        self.ids = {m.id_to_piece(i): i for i in plain}
        # equal scores are equal places, so that the leftmost of them is merged first
        scores = [m.get_score(i) for i in plain]
        place = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        self.place = {p: place[s] for p, s in zip(self.ids, scores, strict=True) if len(p) > 1}
        often = Counter(self.place.values())
        near = {p[k : k + 2] for p, at in self.place.items() if often[at] > 1 for k in range(len(p) - 1)}
        #: finds the chunks in which pieces of equal score may meet
        self.tied = re.compile("|".join(map(re.escape, sorted(near)))) if near else None
        # the pieces by falling score have the numbers 0, 1, ...; other characters follow by their code points
        order = sorted(self.ids, key=lambda p: (self.place.get(p, -1), p))
        number = {p: k for k, p in enumerate(order)}
        self.id_of = np.array([self.ids[p] for p in order], np.int64)
        self.number = len(order) + np.arange(0x110000)
        for p, k in number.items():
            if len(p) == 1:
                self.number[ord(p)] = k
        code = lambda s: int(self.number[ord(s)]) if len(s) == 1 else number.get(s)
        pairs = {(a << 24 | b): number[p] for p in self.place for k in range(1, len(p)) if (a := code(p[:k])) is not None and (b := code(p[k:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        #: no piece has a marker behind another character, so no merge reaches from one chunk into the next
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        names = [b"%d " % i for i in ids]
        self.digits = np.frombuffer(b"".join(names), np.uint8)
        self.size = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut before every run of markers; whole where a piece could reach across."""
        text = self.model.normalize(text)
        return _CHUNK.findall(text) if self.apart else [text] if text else []

    def segments(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, joined, and their counts: of all neighbours that join to a piece the best scored are merged, the leftmost first."""
        n, tied = len(chunks), self.tied.search if self.tied else lambda chunk: False
        alone = [i for i, c in enumerate(chunks) if len(c) > WIDEST or tied(c)]
        ids = [[x for s in self._long(chunks[i]) for x in self.spelled(s)] for i in alone]
        parts = [(np.array(alone, np.int64), np.array(list(chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64))]
        width = np.fromiter(map(len, chunks), np.int64, n)
        width[parts[0][0]] = 0
        for w in (4, 8, 16, WIDEST):
            rows = np.flatnonzero((width > (w // 2 if w > 4 else 0)) & (width <= w))
            for at in range(0, len(rows), CELLS // w):
                part = rows[at : at + CELLS // w]
                parts.append((part, *self._step([chunks[i] for i in part.tolist()], w)))
        flat, sizes, starts, used = np.concatenate([p[1] for p in parts]), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for rows, ids, counts in parts:
            sizes[rows] = counts
            starts[rows] = used + np.cumsum(counts) - counts
            used += len(ids)
        return gather(flat, starts, sizes), sizes

    def spelled(self, symbol: str) -> list[int]:
        """The id of a symbol, or its bytes' ids where it is no piece."""
        found = self.ids.get(symbol)
        return [self.bytes[b] for b in symbol.encode()] if found is None else [found]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of the piece that two symbols join to, or NONE. Numbers rise as scores fall."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def _step(self, chunks: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of at most width characters take their merges in step, a row of symbols each; equal scores don't meet here."""
        n = len(chunks)
        size = np.array([len(c) for c in chunks], np.int64)
        inside = np.arange(width) < size[:, None]
        symbols = np.full((n, width), -1, np.int64)
        symbols[inside] = self.number[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        joined = np.full((n, width), NONE, np.int64)
        both = inside[:, 1:]
        joined[:, :-1][both] = self.pair(symbols[:, :-1][both], symbols[:, 1:][both])
        done, columns = np.empty_like(symbols), np.arange(width - 1)
        rows = np.arange(n)
        while len(rows):
            at = joined.argmin(axis=1)
            best = joined[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done[rows[over]] = symbols[over]
                rows, symbols, joined, at, best = rows[~over], symbols[~over], joined[~over], at[~over], best[~over]
                if not len(rows):
                    break
            here, behind = np.arange(len(rows)), columns > at[:, None]
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            joined[:, :-1] = np.where(columns >= at[:, None], joined[:, 1:], joined[:, :-1])
            joined[:, -1] = NONE
            symbols[here, at] = best
            after = symbols[here, np.minimum(at + 1, width - 1)]
            joined[here, at] = np.where((after >= 0) & (at + 1 < width), self.pair(best, after), NONE)
            left = at > 0
            joined[here[left], at[left] - 1] = self.pair(symbols[here[left], at[left] - 1], best[left])
        flat, counts = done[done >= 0], (done >= 0).sum(axis=1)
        known = flat < len(self.id_of)
        ids = self.id_of[np.where(known, flat, 0)]
        if not known.all():  # other characters are spelled in bytes
            row, odd = np.repeat(np.arange(n), counts), np.flatnonzero(~known)
            spelled = [self.spelled(chr(c)) for c in (flat[odd] - len(self.id_of)).tolist()]
            more = np.array(list(map(len, spelled)), np.int64)
            np.add.at(counts, row[odd], more - 1)
            ids = np.insert(np.delete(ids, odd), np.repeat(odd - np.arange(len(odd)), more), list(chain.from_iterable(spelled)))
        return ids, counts

    def _long(self, chunk: str) -> list[str]:
        """The symbols left of one chunk of any length, with a heap of pairs: n log n. An entry is old if its two symbols no longer join to its piece."""
        place, symbols, n = self.place.get, list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, k, chunk[k : k + 2]) for k in range(n - 1) if (p := place(chunk[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, piece = heapq.heappop(heap)
            right = after[k]
            if not symbols[k] or right >= n or symbols[k] + symbols[right] != piece:
                continue
            symbols[k], symbols[right] = piece, ""
            after[k] = beyond = after[right]
            if beyond < n:
                before[beyond] = k
                if (p := place(piece + symbols[beyond])) is not None:
                    heapq.heappush(heap, (p, k, piece + symbols[beyond]))
            ahead = before[k]
            if ahead >= 0 and (p := place(symbols[ahead] + piece)) is not None:
                heapq.heappush(heap, (p, ahead, symbols[ahead] + piece))
        return [s for s in symbols if s]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one blank."""
        return gather(self.digits, self.start[ids], self.size[ids])[:-1].tobytes()


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def table(pieces: Pieces) -> UnitCache:
    """The table of distinct chunks: each is segmented once, and the ids of a text are joined by its chunks' positions. A worker keeps it between tasks."""
    return UnitCache(pieces.chunks, pieces.segments, np.int32)


def encode_pieces(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (array), the end id among them.

    path names the model on each executor. Nothing is shuffled: a task segments each distinct chunk once, and its table is bounded (UnitCache), so a
    vocabulary of any size fits. A null text is the empty text, which is the end id alone; rows that share a doc_id are each encoded; other columns of
    docs, whatever their names, are not read; an empty table gives none. One text is held at a time, and a chunk without blanks of any length costs
    n log n.
    """

    def make():
        pieces = load(path)
        chunks, end, decode = table(pieces), pieces.model.eos_id(), pieces.model.decode

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, digest, back, kept = [], [], [], []
            for ids in chunks.texts((t or b"").decode(errors="replace") for t in utf8_rows(batch.column(1))):
                ids = np.append(ids, np.int32(end))
                whole = ids.tolist()
                count.append(len(whole))
                digest.append(hashlib.sha256(pieces.decimal(ids)).hexdigest())
                back.append(hashlib.sha256(decode(whole).encode()).hexdigest())
                kept.append(whole if keep_ids else None)
            rows = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                rows, names = [*rows, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(rows, names)

        return each

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table of doc_id and ids (array); null ids give null."""

    def make():
        decode = load(path).model.decode

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return each

    return map_arrow(encoded.select("doc_id", "ids"), make, "doc_id long, text string")
