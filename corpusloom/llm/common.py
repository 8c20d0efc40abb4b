"""Shared pieces of the training-data operators: stage tables, Arrow text access, rolling hashes, unit cache."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- stage tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode (tests) a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside deletes its shuffle files when it ends: nothing reads them again."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    with releasing_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.loom_path = path
    return out


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def drop_stage(*tables: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "loom_path", None)
        if not path:
            continue
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


# ---------------------------------------------------------------- Arrow access


def utf8_rows(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    data = column.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(data[offsets[i] : offsets[i + 1]]) if valid is None or valid[i] else None


def give_back() -> None:
    """Return the memory that a finished task leaves free in its Python worker, which the next stages reuse."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not with every C library
        pass


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with state made once per task: make() returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        del each
        give_back()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- rolling hashes

_M = 0x9E3779B97F4A7C15 | 1
_M_INVERSE = pow(_M, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def byte_symbols(data: bytes) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return _BYTE_VALUES[np.frombuffer(data, np.uint8)]


_BYTE_VALUES = np.random.default_rng(0xC0FFEE).integers(0, 1 << 64, 256, dtype=np.uint64)


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a sequence of 64-bit symbols, in constant time a span."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _power("up", _M, n) if n else symbols, out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power("down", _M_INVERSE, len(self.sums))
        return (self.sums[end] - self.sums[start]) * down[start]

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return (self.sums[k:] - self.sums[:n]) * _power("down", _M_INVERSE, len(self.sums))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_spans(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which is_word (256 booleans) holds."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[np.frombuffer(data, np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_symbols(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, with the words' starts and ends in bytes."""
    starts, ends = word_spans(data, is_word)
    return mixed(Rolling(byte_symbols(data)).span(starts, ends)), starts, ends


_ALL = np.arange(256)
#: Words between ASCII white space: [^\x20\x09-\x0D]+
NOT_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of width values, by doubling."""
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


# ---------------------------------------------------------------- unit cache


@contextmanager
def uncollected() -> Iterator[None]:
    """No collection of cycles inside: the many small lists that are made here have none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class UnitCache:
    """Integer sequences of text units, worked out once for each distinct unit.

    A text is cut into units by split(); encode(units) gives a sequence for each new unit, or all joined and their sizes. The table may be kept from
    task to task of a worker: it is emptied when, after a group of texts, it holds more than limit units, or 20 * limit characters or numbers,
    so a worker's memory is bounded whatever the vocabulary.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list], dtype=np.uint32, limit: int = 800_000):
        self.split, self.encode, self.dtype, self.limit = split, encode, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.used, self.held = np.zeros(1 << 16, self.dtype), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, units: list[str], base: int) -> None:
        """Encode the units that are numbered from base on."""
        rows = self.encode(units)
        if isinstance(rows, tuple):
            joined, sizes = rows
            total = len(joined)
        else:
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            total = int(sizes.sum())
            joined = np.fromiter(chain.from_iterable(rows), self.dtype, total)
        need, n = self.used + total, base + len(units)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), self.dtype)])
        if n > len(self.start):
            more = np.zeros(max(n, len(self.start)), np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.flat[self.used : need] = joined
        self.length[base:n] = sizes
        self.start[base:n] = self.used + np.cumsum(sizes) - sizes
        self.used = need
        self.held += sum(map(len, units))

    def texts(self, texts: Iterable[str], together: int = 2_000_000) -> Iterator[np.ndarray]:
        """The sequence of each text. New units of successive texts, of about together characters in all, are encoded at once."""
        for group in in_groups(texts, len, together):
            with uncollected():
                found = self._group(group)
            yield from found

    def _group(self, group: list[str]) -> list[np.ndarray]:
        base, number = len(self.index), self.index.__getitem__
        try:
            at = [np.fromiter(map(number, units), np.int64, len(units)) for units in map(self.split, group)]
            new = list(islice(reversed(self.index), len(self.index) - base))
            if new:
                self._add(new[::-1], base)
        except BaseException:
            self.clear()  # numbers without sequences must not outlive the task
            raise
        out = [gather(self.flat, self.start[ids], self.length[ids]) for ids in at]
        if len(self.index) > self.limit or max(self.used, self.held) > 20 * self.limit:
            self.clear()
        return out


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + length[i]] for all i, joined."""
    if not len(start):
        return flat[:0]
    ends = np.cumsum(length)
    return flat[np.arange(int(ends[-1])) + np.repeat(start - (ends - length), length)]


def in_groups(texts: Iterable, size: Callable, most: int = 2_000_000) -> Iterator[list]:
    """Successive items in lists of about most in summed size."""
    group, total = [], 0
    for x in texts:
        group.append(x)
        total += size(x)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group
