"""Matroska media columns: a writer of PCM audio files and a parser into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8_rows

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0x23E383
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
#: What ends an element of unknown size: what can stand at the top, and beside the parts of a segment.
ROOTS = frozenset([EBML, SEGMENT])
PARTS = frozenset([SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, ATTACHMENTS, TAGS])
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

PACKET = 576  # samples of 8 bits
SAMPLE_RATE = 48_000  # so a packet lasts 12 ms
PACKETS_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32

# ---------------------------------------------------------------- writing


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones are kept for the unknown size."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(packets: list[bytes], lacing: int) -> bytes:
    """The body of a block behind its flags: the lace head and the packets."""
    if lacing == NO_LACING:
        return packets[0]
    head = bytes([len(packets) - 1])
    sizes = [len(p) for p in packets]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        for k, n in enumerate(sizes[:-1]):
            if not k:
                head += _size(n)
            else:
                step = n - sizes[k - 1]
                w = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
                head += _size(step + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(packets)


def simple_block(track: int, time: int, packets: list[bytes], lacing: int, key: bool = True) -> bytes:
    return element(SIMPLE_BLOCK, _size(track) + struct.pack(">hB", time, (0x80 if key else 0) | lacing << 1) + laced(packets, lacing))


def write_audio(payload: bytes) -> bytes:
    """A Matroska file of one mono 8-bit PCM track that holds payload, whose length is a multiple of PACKET."""
    n = len(payload) // PACKET
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", n * 1000.0 * PACKET / SAMPLE_RATE)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, 10**9 * PACKET // SAMPLE_RATE) + audio)
    parts = [info, element(TRACKS, track)]
    at, cues, step = sum(map(len, parts)), [], PACKETS_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, n, step):
        time = first * PACKET * 1000 // SAMPLE_RATE
        blocks = [_uint(CLUSTER_TIME, time)]
        for k in range(first, min(n, first + step), PACKETS_A_BLOCK):
            packets = [payload[i * PACKET : (i + 1) * PACKET] for i in range(k, min(n, first + step, k + PACKETS_A_BLOCK))]
            blocks.append(simple_block(1, k * PACKET * 1000 // SAMPLE_RATE - time, packets, FIXED if len(packets) > 1 else NO_LACING))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- parsing


@dataclass
class Media:
    """What parse() finds. packets: (track, timestamp in scale units, first byte, length, key frame, cluster's first byte)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    blocks: int = 0


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int, bool]:
    """A variable-length integer: its value (with the length marker or without), the place behind it, and if all value bits are set."""
    first = data[at]
    if not first:
        raise ValueError(f"no EBML integer of at most 8 bytes at {at}")
    w = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + w], "big")
    if at + w > len(data):
        raise ValueError(f"the file ends inside the integer at {at}")
    plain = value & ((1 << 7 * w) - 1)
    return value if marker else plain, at + w, plain == (1 << 7 * w) - 1


def _unknown_end(data: bytes, name: int, at: int, end: int) -> int:
    """Where a segment, or a part of one, whose size is unknown and whose body begins at at ends: before the next element that can't be in it, or at end."""
    if name != SEGMENT and name not in PARTS:
        raise ValueError(f"element {name:X} at {at} may not have an unknown size")
    outside = ROOTS if name == SEGMENT else ROOTS | PARTS
    while at < end:
        inner, body, _ = _vint(data, at, True)
        if inner in outside:
            return at
        size, body, unknown = _vint(data, body, False)
        at = _unknown_end(data, inner, body, end) if unknown else body + size
        if at > end:
            raise ValueError(f"element {inner:X} at {body} is longer than what holds it")
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte of the body, end of the body) of the elements from at to end, of known and unknown sizes."""
    while at < end:
        name, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at, False)
        stop = _unknown_end(data, name, at, end) if unknown else at + size
        if stop > end:
            raise ValueError(f"element {name:X} at {at} is longer than what holds it")
        yield name, at, stop
        at = stop


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[end - at], data[at:end])[0] if end > at else 0.0


def _lace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, length) of the packets of a block."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("a fixed lace does not divide its block")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                start = at
                value, at, _ = _vint(data, at, False)
                size = value if not k else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Packets, tracks and cues of a Matroska file held in memory. Elements that are not known are stepped over."""
    out = Media()
    for name, at, end in elements(data, 0, len(data)):
        if name == EBML:
            out.doc_type = next((data[a:e].decode() for n, a, e in elements(data, at, end) if n == DOC_TYPE), "")
        elif name == SEGMENT:
            _segment(data, at, end, out)
    return out


def _segment(data: bytes, at: int, end: int, out: Media) -> None:
    base = at
    for name, a, e in elements(data, at, end):
        if name == INFO:
            for n, x, y in elements(data, a, e):
                if n == TIMESTAMP_SCALE:
                    out.scale = _number(data, x, y)
                elif n == DURATION:
                    out.duration = _float(data, x, y)
        elif name == TRACKS:
            for n, x, y in elements(data, a, e):
                if n == TRACK:
                    _track(data, x, y, out)
        elif name == CLUSTER:
            _cluster(data, a, e, out)
        elif name == CUES:
            for n, x, y in elements(data, a, e):
                if n == CUE_POINT:
                    found = {m: (p, q) for m, p, q in elements(data, x, y)}
                    inner = {m: _number(data, p, q) for m, p, q in elements(data, *found[CUE_POSITIONS])}
                    out.cues.append((_number(data, *found[CUE_TIME]), inner[CUE_TRACK], base + inner[CUE_CLUSTER]))


def _track(data: bytes, at: int, end: int, out: Media) -> None:
    track = {}
    for name, a, e in elements(data, at, end):
        if name == CODEC_ID:
            track["codec"] = data[a:e].decode()
        elif name == AUDIO:
            for n, x, y in elements(data, a, e):
                if n == RATE:
                    track["rate"] = _float(data, x, y)
                elif n in (CHANNELS, BIT_DEPTH):
                    track["channels" if n == CHANNELS else "bits"] = _number(data, x, y)
        elif name in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "packet_ns"}[name]] = _number(data, a, e)
    out.tracks[track.get("number", 0)] = track


def _cluster(data: bytes, at: int, end: int, out: Media) -> None:
    out.clusters += 1
    time, first = 0, at
    for name, a, e in elements(data, at, end):
        if name == CLUSTER_TIME:
            time = _number(data, a, e)
        elif name == SIMPLE_BLOCK:
            _block(data, a, e, time, first, out, None)
        elif name == BLOCK_GROUP:
            inner = {n: (x, y) for n, x, y in elements(data, a, e)}
            if BLOCK in inner:
                _block(data, *inner[BLOCK], time, first, out, REFERENCE_BLOCK not in inner)


def _block(data: bytes, at: int, end: int, time: int, cluster: int, out: Media, key: bool | None) -> None:
    track, at, _ = _vint(data, at, False)
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    out.blocks += 1
    step = out.tracks.get(track, {}).get("packet_ns", 0) / max(1, out.scale)
    for k, (first, size) in enumerate(_lace(data, at + 3, end, flags >> 1 & 3)):
        out.packets.append((track, time + relative + round(k * step), first, size, bool(flags & 0x80) if key is None else key, cluster))


# ---------------------------------------------------------------- tables


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of a table of doc_id and media (binary): track, timestamp_ns, first_byte, n_bytes, key_frame, cluster_byte.

    Null media give no packet; files that break the format give one row whose error says why and whose other columns are null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("first_byte", pa.int64()), ("n_bytes", pa.int64()), ("key_frame", pa.bool_()), ("cluster_byte", pa.int64()), ("error", pa.string())])

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    found = parse(data.as_py())
                    rows = [(doc_id, t, time * found.scale, a, n, key, c, None) for t, time, a, n, key, c in found.packets]
                except (ValueError, IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
                    rows = [(doc_id, None, None, None, None, None, None, str(e) or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        return each

    return map_arrow(media.select(F.col("doc_id").cast("long").alias("doc_id"), "media"), make, "doc_id long, track long, timestamp_ns long, first_byte long, n_bytes long, key_frame boolean, cluster_byte long, error string")


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text stored as a Matroska audio file, parsed, and read back from its packets' byte ranges.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with
    keep_media also media. feature joins packets, blocks, clusters, cues, duration in ms, the samples' sum and peak
    distance from the middle, and the crossings of the middle. A null text is the empty text, which is stored as one
    packet of 255; rows that share a doc_id are each stored; a text is held in memory one at a time.
    """

    def one(data: bytes | None) -> tuple:
        data = data or b""
        want = max(1, -(-len(data) // PACKET)) * PACKET
        media = write_audio(data + b"\xff" * (want - len(data)))
        found = parse(media)
        payload = b"".join(media[a : a + n] for _, _, a, n, _, _ in found.packets)
        wave = np.frombuffer(payload, np.uint8)
        above = wave >= 128
        crossings = int(np.count_nonzero(above[1:] != above[:-1]))
        peak = int(max(abs(int(wave.max()) - 128), abs(int(wave.min()) - 128)))
        feature = f"{len(found.packets)}:{found.blocks}:{found.clusters}:{len(found.cues)}:{found.duration:.0f}:{int(wave.sum(dtype=np.int64))}:{peak}:{crossings}"
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media if keep_media else None

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    wide = 7 + keep_media

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*map(one, utf8_rows(batch.column(1))), strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), t) for x, t in zip(rows[:wide], types[:wide], strict=True))], ["doc_id", *names[:wide]])

        return each

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)
