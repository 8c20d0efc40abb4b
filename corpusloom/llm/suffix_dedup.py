"""Suffix-array deduplication: repeated byte windows, by sorting positions at growing offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_symbols, map_arrow, mixed, stage, utf8_rows
from .repeats import FOLD_ROWS, Grain, identified, opened, pack, packed, place_lists, removed, with_places

WINDOW = 100  # bytes
FIRST = 32  # bytes of the first sort's ranks
SECOND = 64  # bytes of the ranks that the last sort pairs

GRAIN = Grain(WINDOW, FIRST, byte_symbols)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with the places of their open segments: a row (one, two, doc, place) for each position, of the ranks at 64 bytes of it and of the position 36 on.

    Of a task's positions with the same pair of ranks only the first is sorted; the others start later for certain and
    go through as runs, settled (place is negative) and routed by their own place. So a passage that a third of all
    documents hold gives a row a task.
    """
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def fold() -> Iterator[pa.RecordBatch]:
        one, two, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, two, one))
        late = np.zeros(len(at), bool)
        late[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        next_ = np.zeros(len(at), bool)
        next_[1:] = late[1:] & late[:-1] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1)
        lead = np.flatnonzero(late & ~next_)
        size = np.diff(np.append(np.cumsum(late)[lead], int(late.sum()) + 1))
        for skip in range(0, int(size.max(initial=0)), 255):  # a place holds counts up to 255
            some = size > skip
            own = lead[some]
            route = mixed((doc[own] * 1_000_003 + at[own] + skip).astype(np.uint64)).view(np.int64)
            yield packed("one two doc place", route, np.zeros(len(own), np.int64), doc[own], -pack(at[own] + skip, np.minimum(size[some] - skip, 255), 0) - 1)
        yield packed("one two doc place", one[~late], two[~late], doc[~late], at[~late])

    for batch in batches:
        for doc, data, places in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), place_lists(batch.column(2)), strict=True):
            places = np.sort(places)
            low, count = places >> 16, places >> 8 & 255
            at = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
            ranks = Rolling(byte_symbols(data or b""))
            one, two = ranks.span(at, at + SECOND), ranks.span(at + WINDOW - SECOND, at + WINDOW)
            held.append((one.view(np.int64), two.view(np.int64), np.full(len(at), doc, np.int64), at))
            n += len(at)
            if n >= FOLD_ROWS:
                yield from fold()
                held, n = [], 0
    if held:
        yield from fold()


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From positions in the order of their pairs of ranks, documents and places: those that aren't the first of their pair, whose rank at 100 bytes is that of an earlier one."""
    last = None
    for batch in batches:
        one, two, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        settled = place < 0
        if settled.any():
            yield packed("doc place", doc[settled], -place[settled] - 1)
            one, two, doc, place = (x[~settled] for x in (one, two, doc, place))
        if not len(one):
            continue
        again = np.empty(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        again[0] = last == (one[0], two[0])
        last = one[-1], two[-1]
        if again.any():
            yield packed("doc place", doc[again], pack(place[again], 1, 0))


def early_positions(docs: DataFrame) -> DataFrame:
    """(doc, place): runs of positions whose 100 bytes also start earlier, in documents (doc, doc_id, text); place packs first position << 16 | count << 8."""
    settled, open_ = opened(docs, GRAIN)
    listed = open_.groupBy("doc").agg(F.collect_list("place").alias("places"))
    pairs = docs.join(listed, "doc").select("doc", "text", "places").mapInArrow(_paired, "one long, two long, doc long, place long")
    sorted_ = pairs.repartition("one", "two").sortWithinPartitions("one", "two", "doc", "place")
    return stage(settled.union(sorted_.mapInArrow(_reranked, "doc long, place long")), "early")


def repeated_bytes(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text also spans (pairs of start and end) and kept (binary).

    Prefix doubling by two Spark sorts. The first is of 32-byte ranks at the anchors of all 100-byte windows (one
    position in 35; equal windows have equal anchors): windows whose anchor has a unique rank are done, and runs of
    windows of wholly equal content settle each other. Of every window left, the position is sorted by the pair of its
    64-byte rank and the 64-byte rank 36 bytes on, which is past the threshold; it starts earlier unless it is the first
    of its pair. Ranks are 64-bit hashes, named alike wherever they are worked out, so that the sorts at 1 to 16 and at
    64 bytes, which would only number them, are left out. Texts of any length are read whole. Null is the empty text; rows that share a doc_id count as documents in the order of a hash of their
    texts, and rows equal in both as one document, returned as often as they came; texts under 100 bytes lose nothing.
    """
    search, whole = identified(docs)
    marked = with_places(whole, early_positions(search))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data, places in zip(utf8_rows(batch.column(1)), place_lists(batch.column(2)), strict=True):
                data = data or b""
                gone = removed(places, WINDOW, len(data))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(places) else data
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist() if keep_text else None, kept if keep_text else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            rows = [batch.column(0), pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int64()), pa.array(list(cols[3]), pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                rows += [pa.array(list(cols[4]), pa.list_(pa.int64())), pa.array(list(cols[5]), pa.binary())]
                names += ["spans", "kept"]
            return pa.RecordBatch.from_arrays(rows, names)

        return each

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<long>, kept binary" * keep_text
    return map_arrow(marked.select("doc_id", F.col("text"), "places"), make, schema)
