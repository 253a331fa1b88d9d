"""Matroska audio: writes 8-bit samples as clusters of laced blocks with cues, and parses any
file's variable-length elements, clusters, blocks, lacing and cues into a packet table.

The parser takes elements of known and unknown size, SimpleBlocks and BlockGroups, and all four
lacings. Packets are byte ranges of the file with track and timestamp, so that payloads are read
without copies of what lies between. Damaged files raise ValueError.

Texts are written as a table of media files in the shared folder; digests and packet tables are
made from what is read back. Null and empty texts have a payload of one padded frame. Equal texts
give equal files; every row gives one row, repeated ids and null ids included. An empty table
gives an empty one. Columns of documents other than `carry` and text are not read; `carry` must
not name a column that is added.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquilt.llm.common import remove, stored

FRAME = 576
PADDING = b"\xff"
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
LACED, BLOCKS = 8, 32
NONE, XIPH, FIXED, EBML = 0, 1, 2, 3
#: What blocks of several frames use in turn.
CYCLE = (XIPH, FIXED, EBML)

# Element ids of the public specification (RFC 8794, RFC 9559).
HEADER, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, DEFAULT = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, PLACES, CUE_TRACK, CUE_AT = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, PLACES))


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """A data size, in the fewest bytes or in `width`; all ones means unknown and is left out."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def _element(element: int, data: bytes) -> bytes:
    return _id(element) + _size(len(data)) + data


def _lace(mode: int, sizes: list[int]) -> bytes:
    if mode == XIPH:
        return b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if mode == EBML:
        out = [_size(sizes[0])]
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out.append((b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big"))
        return b"".join(out)
    return b""


def block(track: int, relative: int, frames: list[bytes], mode: int) -> bytes:
    """The content of a block or, marked as a key frame, of a simple block."""
    head = _size(track) + struct.pack(">hB", relative, 0x80 | mode << 1)
    if mode:
        head += bytes([len(frames) - 1]) + _lace(mode, [len(f) for f in frames])
    return head + b"".join(frames)


def write(samples: bytes) -> bytes:
    """One track of 8-bit PCM in frames of FRAME samples; the last may be shorter."""
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)] or [b""]
    audio = _element(FREQUENCY, struct.pack(">d", RATE)) + _element(CHANNELS, b"\x01") + _element(DEPTH, b"\x08")
    entry = (
        _element(NUMBER, b"\x01") + _element(UID, b"\x01") + _element(KIND, b"\x02")
        + _element(CODEC, b"A_PCM/INT/LIT") + _element(DEFAULT, _uint(FRAME_MS * 1_000_000)) + _element(AUDIO, audio)
    )
    info = _element(SCALE, _uint(1_000_000)) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE))
    parts = [_element(INFO, info), _element(TRACKS, _element(ENTRY, entry))]
    at = sum(map(len, parts))
    points = []
    for c in range(0, len(frames), LACED * BLOCKS):
        inside = [_element(TIME, _uint(c * FRAME_MS))]
        for k, b in enumerate(range(c, min(c + LACED * BLOCKS, len(frames)), LACED)):
            lace = frames[b : b + LACED]
            mode = NONE if len(lace) == 1 else CYCLE[k % 3]
            if mode == FIXED and len({len(f) for f in lace}) > 1:
                mode = EBML
            inside.append(_element(SIMPLE, block(1, (b - c) * FRAME_MS, lace, mode)))
        cluster = _element(CLUSTER, b"".join(inside))
        place = _element(CUE_TRACK, b"\x01") + _element(CUE_AT, _uint(at))
        points.append(_element(POINT, _element(CUE_TIME, _uint(c * FRAME_MS)) + _element(PLACES, place)))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(points)))
    return _element(HEADER, _element(DOC_TYPE, b"matroska")) + _element(SEGMENT, b"".join(parts))


@dataclass
class Movie:
    #: (track, timestamp in ticks, first byte, size, cluster, lacing)
    packets: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    #: (timestamp, track, byte of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: first byte and timestamp of each cluster
    clusters: list[tuple[int, int]] = field(default_factory=list)
    #: number: {codec, kind, default duration in ticks}
    tracks: dict[int, dict] = field(default_factory=dict)
    scale: int = 1_000_000
    duration: float = 0.0


def _vint(data, at: int, keep_mark: bool = False) -> tuple[int, int]:
    first = data[at]
    if not first:
        raise ValueError(f"no element starts at byte {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_mark:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1  # unknown
    return value, at + width


def _unlace(data, at: int, end: int, mode: int) -> tuple[list[int], int]:
    """Frame sizes of a laced block whose count byte is at `at`, and where frames start."""
    n = data[at] + 1
    at += 1
    if mode == FIXED:
        return [(end - at) // n] * n, at
    sizes = []
    if mode == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    else:
        size, at = _vint(data, at)
        sizes = [size] if n > 1 else []
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at = _vint(data, at, keep_mark=True)
            size += (step & (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        if n == 1:
            return [end - at], at
    return [*sizes, end - at - sum(sizes)], at


def parse(data: bytes) -> Movie:
    movie = Movie()
    # open masters: (id, end, state); an unknown size ends where a sibling or the parent does
    stack: list[list] = []
    at, size = 0, len(data)
    segment = 0
    state: dict = {}
    while at < size or stack:
        while stack and at >= stack[-1][1]:
            done = stack.pop()[0]
            if done == ENTRY:
                movie.tracks[state.get("number", 0)] = dict(state.get("track", {}))
            elif done == PLACES:
                movie.cues.append((state.get("cue", 0), state.get("cue_track", 0), segment + state.get("cue_at", 0)))
        if at >= size:
            break
        began = at
        element, at = _vint(data, at, keep_mark=True)
        length, at = _vint(data, at)
        if element == CLUSTER:  # ends one of unknown size
            while stack and stack[-1][0] in (CLUSTER, GROUP):
                stack.pop()
        elif element in (CUES, TRACKS, INFO):
            while stack and stack[-1][0] in (CLUSTER, GROUP):
                stack.pop()
        parent_end = stack[-1][1] if stack else size
        end = parent_end if length < 0 else at + length
        if end > parent_end:
            raise ValueError(f"the element at byte {began} ends after its parent")
        if element in MASTERS:
            stack.append([element, end])
            if element == SEGMENT:
                segment = at
            elif element == CLUSTER:
                movie.clusters.append((began, 0))
            elif element == ENTRY:
                state["track"], state["number"] = {}, 0
            continue
        if length < 0:
            raise ValueError(f"the element at byte {began} has no size")
        if element == TIME:
            movie.clusters[-1] = (movie.clusters[-1][0], int.from_bytes(data[at:end], "big"))
        elif element in (SIMPLE, BLOCK):
            track, p = _vint(data, at)
            relative, flags = struct.unpack(">hB", data[p : p + 3])
            mode = flags >> 1 & 3
            p += 3
            sizes, p = _unlace(data, p, end, mode) if mode else ([end - p], p)
            stamp = movie.clusters[-1][1] + relative
            step = movie.tracks.get(track, {}).get("default", 0) // movie.scale
            if sizes[-1] < 0 or p + sum(sizes) > end:
                raise ValueError(f"the lacing at byte {at} exceeds its block")
            for k, s in enumerate(sizes):
                movie.packets.append((track, stamp + k * step, p, s, len(movie.clusters) - 1, mode))
                p += s
        elif element in (SCALE, NUMBER, KIND, DEFAULT, CUE_TIME, CUE_TRACK, CUE_AT):
            value = int.from_bytes(data[at:end], "big")
            if element == SCALE:
                movie.scale = value or 1
            elif element == NUMBER:
                state["number"] = value
            elif element == KIND:
                state["track"]["kind"] = value
            elif element == DEFAULT:
                state["track"]["default"] = value
            else:
                state[{CUE_TIME: "cue", CUE_TRACK: "cue_track", CUE_AT: "cue_at"}[element]] = value
        elif element == CODEC:
            state["track"]["codec"] = bytes(data[at:end]).decode("ascii", "replace")
        elif element == DURATION:
            movie.duration = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
        at = end
    return movie


def read(data: bytes, movie: Movie, track: int = 1) -> bytes:
    return b"".join([data[p : p + s] for t, _, p, s, _, _ in movie.packets if t == track])


def feature(movie: Movie, payload: bytes) -> str:
    """Structure of the file and level of its samples, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    lacing = [sum(1 for p in movie.packets if p[5] == m) for m in (NONE, XIPH, FIXED, EBML)]
    crossings = int(np.count_nonzero(np.diff(x >= 0))) if len(x) else 0
    named = {
        "tracks": len(movie.tracks), "clusters": len(movie.clusters), "cues": len(movie.cues),
        "packets": len(movie.packets), "lacing": "/".join(map(str, lacing)), "ms": int(movie.duration),
        "sum": int(x.sum()), "energy": int((x * x).sum()), "crossings": crossings,
    }
    return ";".join(f"{k}={v}" for k, v in named.items())


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode()
    want = max(FRAME, -(-len(data) // FRAME) * FRAME)
    return len(data), data + PADDING * (want - len(data))


def _digest(batches):
    for batch in batches:
        rows = []
        for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
            movie = parse(media)
            back = read(media, movie)
            rows.append(
                (
                    len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(movie, back),
                )
            )
        keep = batch.drop_columns(["media"])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*keep.columns, *columns], names=[*keep.schema.names, *_DIGEST])


_DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_KINDS = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())


def _written(batches):
    for batch in batches:
        sizes, media = [], []
        for text in batch.column("__text").to_pylist():
            n, payload = padded(text)
            sizes.append(n)
            media.append(write(payload))
        keep = batch.drop_columns(["__text"])
        yield pa.RecordBatch.from_arrays(
            [*keep.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*keep.schema.names, "n_bytes", "media"]
        )


def media_files(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs (text, ...), the bytes of each text and its file as `media`."""
    rows = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return rows.mapInArrow(_written, T.StructType([*fields, *added]))


def digests(files: DataFrame) -> DataFrame:
    """The columns of files (media, ...) but for media, and the digests of each file, whose
    payload is read from its packets."""
    fields = [f for f in files.schema.fields if f.name != "media"]
    added = [T.StructField(n, k) for n, k in zip(_DIGEST, _KINDS, strict=True)]
    return files.mapInArrow(_digest, T.StructType([*fields, *added]))


def stored_texts(spark: SparkSession, docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs (text, ...), and the digests of each text's file, which is
    written to the shared folder and read back. The table of files is removed at the end."""
    files, path = stored(spark, media_files(docs, carry), "media", compression="zstd")
    result = digests(files).checkpoint()
    remove(spark, path)
    return result


PACKETS = "file long, track int, timestamp long, first_byte long, size long, cluster int, lacing int, cue boolean"


def packet_table(files: DataFrame) -> DataFrame:
    """One row per packet of files (file, media); cue: a cue leads to its cluster. Null media
    have no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, media in zip(batch.column("file").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if media is None:
                    continue
                movie = parse(media)
                led = {c[2] for c in movie.cues}
                rows = [(name, t, s, p, n, c, m, movie.clusters[c][0] in led) for t, s, p, n, c, m in movie.packets]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    names=[f.split()[0] for f in PACKETS.split(", ")],
                )

    return files.select(F.col("file").cast("long").alias("file"), "media").mapInArrow(run, PACKETS)
