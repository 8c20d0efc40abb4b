"""Near-duplicates at a similarity: SimHashes of distinct shingles by multi-index hashing, then an exact prefix join.

A Jaccard similarity of 0.8 is a cosine of 0.89 and puts about 15% of the bits of a SimHash apart. The fingerprint has 128
bits, of which 72 serve as index: four tables, one a segment of 18 bits, each entered under the radius-1 Hamming ball of
the segment, so two fingerprints share a key of a table if their segments are at most two bits apart. What meets is
verified: by the complete distance, then by the shingle sets. A link is a Jaccard similarity of 0.8 or more.

The fingerprints gather crowds cheaply but miss some links. The prefix join behind them misses none: all sets are put
in one order of the shingles, and two sets of n and m shingles at 0.8 or more share one of the first n - ceil(0.8n) + 1
of the one and of the first m - ceil(0.8m) + 1 of the other. Sets that meet so, and are not joined by links already, are
tested where they meet by three bounds that 0.8 can't break: their sizes, the places of the shared shingle, and parity
bitmaps (256 bits, each the parity of the shingles that fall on it), whose distance is at most the number of shingles that
only one of the two has. What is left is compared whole. The order puts shingles last that are common in a sample; any
order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Rolling, drop_stage, give_back, in_groups, map_arrow, mixed, stage, unused_names, utf8_rows, word_symbols
from .components import components

SHINGLE = 5  # words
TABLES = 4
SEGMENT = 18  # bits
ABSORB = 19  # of 128 bits: the mean distance at a similarity of 0.8
MEET = ABSORB  # pairs farther apart are left to the prefix join
PARITY = 256  # bits of a bitmap
ROWS = 1 << 18  # rows of the index that a task holds at once
SAMPLE = 1 << 15  # texts, about, that tell which shingles are common
COMMON = 1 << 19  # shingles that are known as such at most
PRINT = ["w0", "w1"]
BITMAP = [f"b{k}" for k in range(PARITY // 64)]
_SALTS = np.random.default_rng(0x51A1).integers(0, 1 << 64, len(PRINT), dtype=np.uint64)
_NAMING = np.random.default_rng(0x5E75).integers(0, 1 << 64, 2, dtype=np.uint64)
_U, _S = np.uint64, np.int64


def shingles(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of one UTF-8 text; none for null or no words."""
    symbols = word_symbols(data.translate(LOWER), NOT_SPACE)[0] if data else ()
    return np.unique(mixed(Rolling(symbols).grams(min(shingle, len(symbols))))) if len(symbols) else np.zeros(0, np.uint64)


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set, whatever its text; zeros for the empty set."""
    return tuple(int(mixed(hashes ^ salt).sum(dtype=np.uint64)) for salt in _NAMING)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set as 64-bit words; zeros for the empty set."""
    ones = np.zeros(64 * len(PRINT), np.int64)
    for at in range(0, len(hashes), 255):  # so many ones fit in a byte
        part = mixed(hashes[at : at + 255, None] ^ _SALTS).astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bitmap with the parity of the number of shingles that fall on each bit."""
    return np.packbits(np.bincount((hashes >> _U(56)).astype(_S), minlength=PARITY) & 1, bitorder="little").view("<u8")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text, so that rows that share an id stay apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest shingles of a sample of the texts and how many of its different texts hold each."""
    texts = _texts(docs).where(F.pmod("h", F.lit(docs.count() // SAMPLE + 1)) == 0).select("text").distinct()

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for group in in_groups(utf8_rows(batch.column(0)), lambda t: len(t or b"")):
                found, many = np.unique(np.concatenate([shingles(t, shingle) for t in group]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(_S)), pa.array(many, pa.int64())], ["hash", "n"])

        return each

    seen = map_arrow(texts, make, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 2")
    found = seen.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes, many = found["hash"].to_numpy().view(_U), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], many[order]


def head(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(0.8n) + 1 of the n shingles of a set, those that are not common first, then by their hash."""
    known, many = common
    n = len(hashes)
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, many[at], 0), kind="stable")]
    return hashes[: n - (4 * n + 4) // 5 + 1]


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h and, of the shingle set of every row: its name s0, s1, its fingerprint, its bitmap, its size n and its head."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    longs = ["s0", "s1", *PRINT, *BITMAP]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, sizes, heads = [], [], []
            for t in utf8_rows(batch.column(2)):
                x = shingles(t, shingle)
                found.append([*set_name(x), *simhash(x), *parities(x)])
                sizes.append(len(x))
                heads.append(head(x, sent.value).tobytes())
            found = np.array(found, _U).reshape(-1, len(longs)).view(_S)
            columns = [*batch.columns[:2], *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(longs))), pa.array(sizes, pa.int32()), pa.array(heads, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", *longs, "n", "head"])

        return each

    return map_arrow(_texts(docs), make, "doc_id long, h long, " + ", ".join(f"{w} long" for w in longs) + ", n int, head binary")


# ---------------------------------------------------------------- multi-index hashing


def _index_rows(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """The keys of every fingerprint, table by table: each segment and its radius-1 ball."""
    masks = np.concatenate([[0], 1 << np.arange(SEGMENT)]).astype(_U)
    low, keys = _U((1 << SEGMENT) - 1), []
    for t in range(TABLES):
        at = t * SEGMENT
        if at + SEGMENT <= 64:
            part = w0 >> _U(at)
        elif at < 64:
            part = (w0 >> _U(at)) | (w1 << _U(64 - at))
        else:
            part = w1 >> _U(at - 64)
        keys.append((((part & low)[:, None] ^ masks) | _U(t << SEGMENT)).ravel())
    return np.concatenate(keys).astype(_S)


def leaders(key: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that lead, in order, and the met pairs as rows (leader, other), for rows sorted by key.

    In every group of a key the first row leads: the rows within MEET bits of it are its pairs, those within ABSORB
    leave. The rest does the same again. A crowd of copies costs a few looks a row, not one for each pair. A row that
    leaves may miss links at this key; the prefix join finds them.
    """
    rows, leading, met = np.arange(len(key)), [], []
    while len(rows):
        groups = key[rows]
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(rows)]]))
        leading.append(rows[first])
        lead = np.repeat(rows[first], sizes)
        others = np.ones(len(rows), bool)
        others[first] = False
        rows, lead = rows[others], lead[others]
        apart = np.bitwise_count(w0[rows] ^ w0[lead]).astype(np.int16) + np.bitwise_count(w1[rows] ^ w1[lead])
        near = apart <= MEET
        met.append(np.stack([lead[near], rows[near]], axis=1))
        rows = rows[apart > ABSORB]
    lead = np.sort(np.concatenate(leading)) if leading else np.zeros(0, _S)
    return lead, np.concatenate(met) if met else np.zeros((0, 2), _S)


#: A row of the index has a key, a fingerprint and its node a; a pair has the nodes a and b.
_INDEX = "key long, w0 long, w1 long, a long, b long"


def _batch(n: int, **columns: np.ndarray) -> pa.RecordBatch:
    names = ["key", *PRINT, "a", "b"]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[x]).view(_S)) if x in columns else pa.nulls(n, pa.int64()) for x in names], names)


def _pairs(node: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """The distinct pairs of nodes, the lesser first. Their key is spread so that they travel evenly."""
    ends = np.sort(node[met], axis=1)
    ends = np.unique(ends, axis=0) if len(ends) else ends
    a, b = ends[:, 0].astype(_U), ends[:, 1].astype(_U)
    return _batch(len(ends), key=-1 - (mixed(a ^ mixed(b)) >> _U(2)).astype(_S), a=a, b=b)


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of (node, fingerprint). What a crowd shares is resolved here, before the shuffle, over some rows at a time."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.stack([np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3)])
        node, w0, w1 = x[:, np.lexsort((x[2], x[1]))]
        w0, w1 = w0.view(_U), w1.view(_U)
        key, row = _index_rows(w0, w1), np.tile(np.repeat(np.arange(len(node)), SEGMENT + 1), TABLES)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        lead, met = leaders(key, w0[row], w1[row])
        yield _pairs(node[row], met)
        for at in range(0, len(lead), 1 << 16):
            part = lead[at : at + (1 << 16)]
            own = row[part]
            yield _batch(len(part), key=key[part], w0=w0[own], w1=w1[own], a=node[own])

    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch) * TABLES * (SEGMENT + 1)
        if n >= ROWS:
            yield from flush(held)
            held, n = [], 0
    if n:
        yield from flush(held)
    give_back()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of index rows that come sorted by key. Of a key that goes on, only the leaders are carried along."""
    kept = [np.zeros(0, _S)] * 4
    held, n = [], 0

    def out(pairs: pa.RecordBatch) -> pa.RecordBatch:
        return pairs.select(["a", "b"])

    def flush() -> pa.RecordBatch:
        nonlocal kept
        key, w0, w1, node = (np.concatenate([kept[k], *(b.column(k).to_numpy() for b in held)]) for k in range(4))
        lead, met = leaders(key, w0.view(_U), w1.view(_U))
        open_ = lead[key[lead] == key[-1]]
        kept = [x[open_] for x in (key, w0, w1, node)]
        return out(_pairs(node, met))

    for batch in batches:
        done = batch.column(4).is_valid()
        if batch.column(4).null_count < len(batch):
            yield out(batch.filter(done))
            batch = batch.filter(pa.compute.invert(done))
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= ROWS:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()
    give_back()


def close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints meet at a key of a table and are within MEET bits.

    All keys have their rows in the order of the fingerprints, so that a crowd has the same few leaders at all its keys.
    """
    entered = nodes.select("node", *PRINT).mapInArrow(_enter, _INDEX)
    ordered = entered.repartition("key").sortWithinPartitions("key", *PRINT, "a")
    return ordered.mapInArrow(_meet, "a long, b long").distinct()


# ---------------------------------------------------------------- verification


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """If two shingle sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and bitmaps don't rule 0.8 out: what only one has is at most a ninth of both sizes."""
    of = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ["n", *BITMAP]))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    apart: Column = reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITMAP])
    return both.where((apart * 9 <= F.col("n_a") + F.col("n_b")) & (F.least("n_a", "n_b") * 5 >= F.greatest("n_a", "n_b") * 4)).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar, each set compared whole. Only the texts that a pair needs are read again."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = ends.join(nodes.select("node", "least"), "node").select("node", F.col("least.doc_id").alias("id"), F.col("least.h").alias("hash"))
    rows = _texts(docs)
    found = rows.join(ends, rows["doc_id"].eqNullSafe(ends["id"]) & (rows["h"] == ends["hash"]))
    texts = stage(found.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [[shingles(t, shingle) for t in utf8_rows(batch.column(k))] for k in (2, 3)]
            keep = pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

        return each

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    out = stage(map_arrow(met, make, "a long, b long"), "links")
    drop_stage(texts)
    return out


# ---------------------------------------------------------------- prefix join

_HEAD = ["key", "n", "place", "node", "root", *BITMAP]
_HEAD_SCHEMA = "key long, n int, place int, node long, root long, " + ", ".join(f"{b} long" for b in BITMAP)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each head, with its place, of rows (n, node, root, bitmap, head)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(len(BITMAP) + 3)).to_numpy(zero_copy_only=False).astype(_S) // 8
        for part in in_groups(range(len(batch)), lambda i: int(sizes[i]), ROWS):
            many = sizes[part]
            at = np.repeat(np.array(part), many)
            key = np.frombuffer(b"".join(batch.column(len(BITMAP) + 3)[i].as_py() for i in part), _S)
            place = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
            n, *rest = (batch.column(k).to_numpy()[at] for k in range(len(BITMAP) + 3))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int32()), pa.array(place, pa.int32()), *map(pa.array, rest)], _HEAD)
    give_back()


def crossing(key: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, bitmap: list[np.ndarray], known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key and different roots that may be similar, for rows sorted by key and n; not among the first known.

    If a key's shingle is the first that two sets share, they share at most that and what follows it in the shorter rest.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, _S)
    many = np.diff(np.concatenate([first, [len(key)]]))
    mixed_roots = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first) if len(first) else np.zeros(0, bool)
    i, step = np.flatnonzero(np.repeat(mixed_roots & (many > 1), many)), 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        i = i[(key[i + step] == key[i]) & (5 * n[i] >= 4 * n[i + step])]
        j = i + step
        shared = np.minimum(n[i] - place[i], n[j] - place[j])
        good = (root[i] != root[j]) & (9 * shared >= 4 * (n[i] + n[j])) & (j >= known)
        a, b = i[good], j[good]
        apart = np.zeros(len(a), _S)
        for bits in bitmap:
            apart += np.bitwise_count(bits[a] ^ bits[b])
        good = 9 * apart <= n[a] + n[b]
        if good.any():
            yield a[good], b[good]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of nodes from the rows of heads that come sorted by key and n."""
    kept = [np.zeros(0, _S)] * len(_HEAD)
    held, many = [], 0

    def out(found: list) -> pa.RecordBatch:
        pairs = np.concatenate([np.stack(x, axis=1) for x in found])
        ends = np.unique(np.sort(kept[3][pairs], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], ["a", "b"])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal kept
        known = len(kept[0])
        kept = [np.concatenate([kept[k], *(b.column(k).to_numpy().astype(_S) for b in held)]) for k in range(len(_HEAD))]
        found, total = [], 0
        for pair in crossing(kept[0], kept[1], kept[2], kept[4], [x.view(_U) for x in kept[5:]], known):
            found.append(pair)
            total += len(pair[0])
            if total >= ROWS:
                yield out(found)
                found, total = [], 0
        if found:
            yield out(found)
        open_ = (kept[0] == kept[0][-1]) & (5 * kept[1] >= 4 * kept[1][-1])
        kept = [x[open_] for x in kept]

    for batch in batches:
        held.append(batch)
        many += len(batch)
        if many >= ROWS:
            yield from flush()
            held, many = [], 0
    if many:
        yield from flush()
    give_back()


def missed(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes under different roots: all that are similar and some that are not."""
    rows = rooted.where("n > 0").select("n", "node", "root", *BITMAP, "head").mapInArrow(_heads, _HEAD_SCHEMA)
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_cross, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h and kept: the least id of the group of near copies that each row is in (null where the group has no id)."""
    wide = stage(prints(docs, shingle), "wide")
    own = stage(wide.select("doc_id", "h", "s0", "s1"), "own")
    same = [F.min(c).alias(c) for c in [*PRINT, *BITMAP, "n"]]
    folded = wide.groupBy("s0", "s1").agg(F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("least"), *same, F.first("head").alias("head"))
    nodes = stage(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")
    drop_stage(wide)

    def under(rows: DataFrame, edges: DataFrame) -> DataFrame:
        return rows.join(components(edges).withColumnRenamed("root", "found"), "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")

    met = stage(possible(close_prints(nodes), nodes), "met")
    near = links(docs, nodes, met, shingle)
    rooted = stage(under(nodes, near), "rooted")
    drop_stage(met, near, nodes)
    met = stage(missed(rooted), "met")
    more = links(docs, rooted, met, shingle)
    stars = rooted.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    grouped = stage(under(rooted.select("node", "s0", "s1", "least"), stars.union(more)), "grouped")
    drop_stage(met, more, rooted)
    named = grouped.join(grouped.groupBy("root").agg(F.min("least.doc_id").alias("kept")), "root").select("s0", "s1", "kept")
    return own.join(named, ["s0", "s1"]).select("doc_id", "h", "kept")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents without those that are near copies (similarity 0.8 or more) of one with a smaller id.

    Groups are the components of the links, so they don't depend on the order of rows. Texts of equal shingle sets are
    folded to one row first, so exact copies cost one. Null or wordless texts are copies of one another, texts of fewer
    words than a shingle are copies of equal texts only; very long texts are taken whole. Rows without an id stay, and so
    do all rows of a group that have its smallest id; rows that share an id but not a group are judged apart. An empty
    table stays empty; extra columns stay, whatever their names.
    """
    found = groups(docs, shingle).where("doc_id != kept").select("doc_id", "h").distinct()
    id_, hash_ = unused_names(docs, "near_id", "near_hash")
    losers = found.select(F.col("doc_id").alias(id_), F.col("h").alias(hash_))
    return docs.join(losers, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hash_)), "left_anti").select(docs.columns)
