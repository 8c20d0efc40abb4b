"""Token ids in seekable zstandard files: a frame a document, a trailing seek table, a checksum a frame."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import unit_splitter
from .common import UnitCache, gather, map_arrow, new_path, stage, utf8_rows

# Fixed values of the zstandard seekable format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

END_ID = 2


class Writer:
    """Appends one frame for each document to a binary sink; close() adds the document ids and the seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.names = bytearray(), []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        frame = self.compressor.compress(raw)
        self.sink.write(frame)
        self.entries += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.names.append(doc_id)

    def close(self) -> None:
        known = bytes(x is not None for x in self.names)
        body = np.array([x or 0 for x in self.names], "<i8").tobytes() + known
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        foot = struct.pack("<IBI", len(self.names), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(self.entries) + len(foot)) + bytes(self.entries) + foot)


class Reader:
    """Random access to the documents of one file; only frames that are asked for are read and decompressed."""

    def __init__(self, source):
        self.source = source
        total = source.size()
        source.seek(total - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        head = total - 9 - 12 * n - 8
        source.seek(head)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_SEEK_TABLE, 12 * n + 9):
            raise ValueError("the seek table's head does not fit its foot")
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        source.seek(int(self.offset[-1]) + 8)
        body = source.read(9 * n)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(np.frombuffer(body[: 8 * n], "<i8"), body[8 * n :], strict=True)]
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> np.ndarray:
        packed, size, check = self.table[k].tolist()
        self.source.seek(int(self.offset[k]))
        raw = self.decompressor.decompress(self.source.read(packed), max_output_size=size) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not have its checksum")
        return np.frombuffer(raw, "<u4")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def text_splitter(path: str, pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into units that the tokenizer encodes one by one as it encodes the text.

    The strings of added tokens are cut out first, as the library does; each is a unit. If an added token takes blanks
    beside it or only counts as a word, texts are not cut.
    """
    split = unit_splitter(pattern)
    added = list(_tokenizer(path).get_added_tokens_decoder().values())
    if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added):
        return lambda text: [text] if text else []
    names = sorted((x.content for x in added if x.content), key=len, reverse=True)
    if not names:
        return split
    cut = re.compile("(" + "|".join(map(re.escape, names)) + ")")

    def units(text: str) -> list[str]:
        if not any(x in text for x in names):
            return split(text)
        return [u for k, part in enumerate(cut.split(text)) if part for u in ([part] if k % 2 else split(part))]

    return units


TOGETHER = 1000  # units that are encoded as one string


@lru_cache(maxsize=1)
def unit_encoder(path: str, pattern: str) -> UnitCache:
    """The tokenizers library's ids, asked for once for each distinct unit of text. A worker keeps the table between tasks.

    No match of the pattern reaches from a character that isn't white space to a blank behind it, so units that begin
    with a blank and don't end in one are encoded many at once, joined; each token's bytes tell whose it is.
    """
    t = _tokenizer(path)
    size = t.get_vocab_size(with_added_tokens=True)
    width = np.array([len(t.id_to_token(k) or "") for k in range(size)], np.int64)  # a character of a token is a byte
    for k, token in t.get_added_tokens_decoder().items():
        width[k] = len(token.content.encode())

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart, joined = [], []
        for k, u in enumerate(units):
            (joined if u[0] in " \n" and not u[-1].isspace() else apart).append(k)
        flats, sizes, order = [], [], []
        for at in range(0, len(joined), TOGETHER * 100):
            group = joined[at : at + TOGETHER * 100]
            parts = [group[k : k + TOGETHER] for k in range(0, len(group), TOGETHER)]
            found = t.encode_batch_fast(["".join(map(units.__getitem__, x)) for x in parts], add_special_tokens=False)
            for part, one in zip(parts, found, strict=True):
                ids = np.array(one.ids, np.uint32)
                ends = np.cumsum(width[ids])
                borders = np.cumsum([len(units[k]) if units[k].isascii() else len(units[k].encode()) for k in part])
                last = np.searchsorted(ends, borders)
                if len(ids) == 0 or (last >= len(ends)).any() or (ends[last] != borders).any():
                    apart += part  # not a tokenizer of bytes
                    continue
                flats.append(ids)
                sizes.append(np.diff(last, prepend=-1))
                order += part
        alone = [e.ids for e in t.encode_batch_fast([units[k] for k in apart], add_special_tokens=False)]
        flats += [np.array(x, np.uint32) for x in alone]
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        flat, many = np.concatenate([*flats, np.zeros(0, np.uint32)]), np.concatenate(sizes)
        place = np.empty(len(units), np.int64)
        place[np.array(order + apart, np.int64)] = np.arange(len(units))
        start = (np.cumsum(many) - many)[place]
        return gather(flat, start, many[place]), many[place]

    return UnitCache(text_splitter(path, pattern), encode, limit=1_200_000)


def write_shards(docs: DataFrame, tokenizer: str, pattern: str, folder: str, end_id: int | None = END_ID, level: int = 3) -> DataFrame:
    """Write the documents' ids in ascending doc_id order, one file for each range of ids; a row a file: shard, path, n_docs, n_tokens.

    folder is a URI that the executors can reach. A task writes under a name of its own attempt and the returned table
    names the attempts that ended, so retries and speculation do no harm. A null text is the empty text; null ids
    come first; rows that share a doc_id are in the order of their texts' hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample of keys that the driver sees holds a hash of the text, not the text.
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        units = unit_encoder(tokenizer, pattern)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                context = TaskContext.get()
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.zst"
                writer = Writer(fs.open_output_stream(f"{root}/{name}", compression=None), level)
            texts = units.texts((t or b"").decode() for t in utf8_rows(batch.column(1)))
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.concatenate([ids, end])
                writer.add(doc_id, ids)
                n_tokens += len(ids)
        if writer is not None:
            writer.close()
            writer.sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [len(writer.names)], "n_tokens": [n_tokens]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return stage(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_file(path: str, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of the documents of one file, or of those among wanted."""
    fs, local = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(local) as source:
        reader = Reader(source)
        for k in range(len(reader)):
            if wanted is None or reader.doc_ids[k] in wanted:
                yield reader.doc_ids[k], reader.document(k)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of the files of write_shards: doc_id, start, n_tokens, ids_crc32, and path.

    The driver sees one row a file; every file is read by one task.
    """
    spark = shards.sparkSession
    files = [(r.path, r.n_tokens) for r in shards.orderBy("shard").collect()]
    starts = [0, *accumulate(n for _, n in files)]
    listed = spark.createDataFrame([(p, s) for (p, _), s in zip(files, starts, strict=False)], "path string, start long")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, places, sizes, sums = [], [], [], []
                for doc_id, ids in read_file(path):
                    names.append(doc_id)
                    places.append(start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    start += len(ids)
                columns = [pa.array(x, pa.int64()) for x in (names, places, sizes, sums)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(names), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])

        return each

    return map_arrow(listed.repartition(max(1, len(files))), make, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def token_files(docs: DataFrame, tokenizer: str, pattern: str, folder: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Write the ids to files and return what is read back from them. An empty table writes no file and gives no row."""
    return read_shards(write_shards(docs, tokenizer, pattern, folder or new_path(docs.sparkSession, "ids"), end_id))
