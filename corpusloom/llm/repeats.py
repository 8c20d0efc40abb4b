"""Routing of repeated windows: which windows of a sequence of symbols may start earlier elsewhere, found with one shuffle.

A window of W symbols has an anchor: its k-gram of the least hash, leftmost on ties. Equal windows have equal anchors at
equal offsets, so windows need be compared only with those whose anchor gram is the same. Successive windows with one
anchor form a segment (about 2 in W - k + 2 positions start one), and a segment is what is shuffled: 64-bit hashes of its
anchor gram (the key) and of its content, its document and its place, not its symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, map_arrow, mixed, sliding_min, stage, utf8_rows

_LOW = np.uint64((1 << 24) - 1)
CHUNK = 1 << 22  # windows that are looked at together


def segments(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each segment: first window, number of windows, anchor position, key, content hash (as int64)."""
    n = len(symbols) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    rolling = Rolling(symbols)
    hashes = mixed(rolling.grams(gram))
    lows, anchors = [], []
    for at in range(0, n, CHUNK):
        part = hashes[at : min(n, at + CHUNK) + window - gram]
        place = sliding_min((part & ~_LOW) | np.arange(len(part), dtype=np.uint64), window - gram + 1) & _LOW
        first = np.flatnonzero(np.diff(place, prepend=np.uint64(1 << 60)))
        lows.append(first + at)
        anchors.append(place[first].astype(np.int64) + at)
    low, anchor = np.concatenate(lows), np.concatenate(anchors)
    count = np.diff(low, append=n)
    content = mixed(rolling.span(low, low + count + window - 1) ^ (anchor - low).astype(np.uint64))
    return low, count, anchor, hashes[anchor].view(np.int64), content.view(np.int64)


# ---------------------------------------------------------------- in Spark

FOLD_ROWS = 1_000_000  # segments of a task that are folded together before the shuffle
GROUP_ROWS = 50_000  # more segments of one key than this are resolved window by window instead of in one task
SHARD_ROWS = 20_000  # segments that are resolved together


@dataclass(frozen=True)
class Grain:
    """What repeats are made of. symbols gives the 64-bit symbols of a text's UTF-8 bytes."""

    window: int
    gram: int
    symbols: Callable[[bytes], np.ndarray]


def pack(low: np.ndarray, count: np.ndarray | int, offset: np.ndarray | int) -> np.ndarray:
    return low << 16 | count << 8 | offset


def packed(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to search, documents to return), both with doc (a number that orders them by doc_id), doc_id and text.

    With distinct ids that are not null, doc is doc_id. Otherwise rows with equal id and text are searched once, and
    rows of one id are ordered by a hash of their texts; null ids come first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        rows = rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
        return rows, rows
    tied = rows.withColumn("tie", F.xxhash64("text"))
    ordered = stage(tied.dropDuplicates(["doc_id", "tie"]).orderBy("doc_id", "tie").withColumn("doc", F.monotonically_increasing_id()), "ordered")
    names = ordered.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "doc")
    return ordered.select("doc", "doc_id", "text"), tied.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("doc", "doc_id", "text")


def _folded(grain: Grain):
    """Per task: the segments of its documents. Of those with equal key and content only the first goes on as a segment; the others are settled (their place is negative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def fold() -> pa.RecordBatch:
            key, content, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, doc, content, key))
            key, content, doc, place = key[order], content[order], doc[order], place[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            route = np.where(again, mixed((doc * 1_000_003 + place).astype(np.uint64)).view(np.int64), key)
            return packed("key content doc place", route, np.where(again, 0, content), doc, np.where(again, -place - 1, place))

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), strict=True):
                low, count, anchor, key, content = segments(grain.symbols(data or b""), grain.window, grain.gram)
                if len(low):
                    held.append((key, content, np.full(len(low), doc, np.int64), pack(low, count, anchor - low)))
                    n += len(low)
                if n >= FOLD_ROWS:
                    yield fold()
                    held, n = [], 0
        if held:
            yield fold()

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments sorted by key, content, document and place: settled spans (key null) and the first segments of contents that share their key with others.

    The rows of a key stream by; of a key only its last new content is held back, until the next row shows if it is alone.
    """
    last_key = last_content = None
    pending = None  # (doc, place, key, shared)

    def out(doc, place, key, shared) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(key, pa.int64(), mask=~np.asarray(shared, bool))], ["doc", "place", "key"])

    for batch in batches:
        key, content, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        settled = place < 0
        if settled.any():
            yield out(doc[settled], -place[settled] - 1, key[settled], np.zeros(int(settled.sum()), bool))
            key, content, doc, place = (x[~settled] for x in (key, content, doc, place))
            if not len(key):
                continue
        new_key = np.empty(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_key[0] = key[0] != last_key or last_key is None
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        new[0] |= content[0] != last_content
        yield out(doc[~new], place[~new], key[~new], np.zeros(int((~new).sum()), bool))
        last_key, last_content = key[-1], content[-1]
        at = np.flatnonzero(new)
        if not len(at):
            continue
        doc, place, key, fresh = doc[at], place[at], key[at], new_key[at]
        if pending is not None:
            doc, place, key = np.append(pending[0], doc), np.append(pending[1], place), np.append(pending[2], key)
            fresh = np.append(pending[3], fresh)
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        pending = (doc[-1], place[-1], key[-1], fresh[-1])
        done = shared[:-1]
        yield out(doc[:-1][done], place[:-1][done], key[:-1][done], np.ones(int(done.sum()), bool))
    if pending is not None and not pending[3]:
        yield out([pending[0]], [pending[1]], [pending[2]], [True])


def _fetched(grain: Grain):
    """The symbols of the segments of a document."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_, key_, place_, heavy_, symbols_ = [], [], [], [], []
        for doc, data, rows in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            symbols = grain.symbols(data or b"").astype("<u8")
            for row in rows:
                low, count = row["place"] >> 16, row["place"] >> 8 & 255
                doc_.append(doc)
                key_.append(row["key"])
                place_.append(row["place"])
                heavy_.append(row["heavy"])
                symbols_.append(symbols[low : low + count + grain.window - 1].tobytes())
        columns = [pa.array(x, t) for x, t in ((key_, pa.int64()), (doc_, pa.int64()), (place_, pa.int64()), (heavy_, pa.bool_()), (symbols_, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc", "place", "heavy", "symbols"])

    return each


def _by_shard(resolve: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray], grain: Grain):
    """Whole groups of equal keys, about SHARD_ROWS segments at a time, to resolve(), which says of each window if it starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            key, doc, place = (rows[c].to_numpy() for c in ("key", "doc", "place"))
            symbols = [np.frombuffer(x, "<u8").astype(np.uint64) for x in rows["symbols"].to_pylist()]
            count = place >> 8 & 255
            early = resolve(key, count, symbols)
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            owner = np.repeat(np.arange(len(count)), count)
            start = np.flatnonzero(early & ~(np.append(False, early[:-1]) & (np.append(-1, owner[:-1]) == owner)))
            stop = np.flatnonzero(early & ~(np.append(early[1:], False) & (np.append(owner[1:], -1) == owner)))
            own = owner[start]
            return packed("doc place", doc[own], pack((place[own] >> 16) + start - first[own], stop - start + 1, np.zeros(len(own), np.int64)))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD_ROWS:
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if cut:
                    yield flush(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _windows(grain: Grain):
    """Of each segment of a key with very many: its windows as pairs of the hashes of their halves."""
    half = grain.window // 2

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            low, n = place >> 16, place >> 8 & 255
            rolling, at = Rolling(np.frombuffer(raw, "<u8").astype(np.uint64)), np.arange(n)
            one, two = rolling.span(at, at + half), rolling.span(at + half, at + grain.window)
            yield packed("one two doc at", one.view(np.int64), two.view(np.int64), np.full(n, doc, np.int64), at + low)

    return each


def opened(docs: DataFrame, grain: Grain) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of documents (doc, doc_id, text): runs of windows that start earlier, as (doc, place); and (key, doc, place) of the segments left to compare.

    One shuffle carries the segments' hashes, folded in each task first, so a text that fills a third of the rows
    gives a row a task. Segments of equal content settle each other there; open are those that share only their anchor gram.
    """
    cut = docs.select("doc", "text").mapInArrow(_folded(grain), "key long, content long, doc long, place long")
    sorted_ = cut.repartition("key").sortWithinPartitions("key", "content", "doc", "place")
    found = stage(sorted_.mapInArrow(_compared, "doc long, place long, key long"), "compared")
    return found.where("key is null").select("doc", "place"), found.where("key is not null").select("key", "doc", "place")


def early_windows(docs: DataFrame, grain: Grain, resolve: Callable) -> DataFrame:
    """(doc, place): runs of windows of documents (doc, doc_id, text) that also start earlier; place packs first window << 16 | count << 8.

    Open segments fetch their symbols and are compared by resolve(), groups of one key together. A key with more than
    GROUP_ROWS segments is spread over tasks window by window.
    """
    settled, open_ = opened(docs, grain)
    heavy = open_.groupBy("key").count().where(F.col("count") > GROUP_ROWS).select("key", F.lit(True).alias("heavy"))
    listed = open_.join(heavy, "key", "left").groupBy("doc").agg(F.collect_list(F.struct("key", "place", F.coalesce("heavy", F.lit(False)).alias("heavy"))).alias("rows"))
    texts = docs.join(listed, "doc").select("doc", "text", "rows")
    fetched = stage(map_arrow(texts, lambda: _fetched(grain), "key long, doc long, place long, heavy boolean, symbols binary"), "fetched")
    light = fetched.where("not heavy").select("key", "doc", "place", "symbols").repartition("key").sortWithinPartitions("key", "doc", "place")
    parts = settled.union(light.mapInArrow(_by_shard(resolve, grain), "doc long, place long"))
    if fetched.where("heavy").limit(1).count():
        windows = map_arrow(fetched.where("heavy").select("doc", "place", "symbols"), lambda: _windows(grain), "one long, two long, doc long, at long")
        first = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "at")).alias("first"))
        late = windows.join(first, ["one", "two"]).where(F.struct("doc", "at") > F.col("first"))
        parts = parts.union(late.select("doc", F.shiftleft("at", 16).bitwiseOR(F.lit(1 << 8)).alias("place")))
    return stage(parts, "early")


def removed(places: np.ndarray, window: int, n: int) -> np.ndarray:
    """Of n symbols, those covered by the given runs of windows."""
    low, count = places >> 16, places >> 8 & 255
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, np.minimum(low + count + window - 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def with_places(docs: DataFrame, early: DataFrame) -> DataFrame:
    """doc_id, text and places (an array, null if none) of every document."""
    places = early.groupBy("doc").agg(F.collect_list("place").alias("places"))
    return docs.join(places, "doc", "left").select("doc_id", "text", "places")


def place_lists(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)
