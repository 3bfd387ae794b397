"""Matroska columns: byte payloads as one-track audio files, and packet tables read back from any file.

A file is a tree of EBML elements: an identifier and a size, both of variable length, then content. The
reader walks the tree with bounds checks, follows elements of unknown size to the next element of their
own level or above, and turns clusters into packets: blocks with their track and time, split into frames by
Xiph, EBML or fixed lacing, each with its byte range in the file. Cues come as a table of seek points.

The writer stores a payload as 8-bit samples: frames of ``FRAME`` bytes, up to ``LACE`` frames in a block
(fixed lacing where they are equally long, EBML lacing otherwise), ``BLOCKS`` blocks in a cluster, a cue
per cluster.

Defined results: a null text is an empty payload and still gives a file; a null or damaged file gives the
packets before the damage and ``whole`` = false; equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import slices, text_bytes

#: Bytes of a frame, frames of a block, blocks of a cluster.
FRAME, LACE, BLOCKS = 512, 8, 16
#: Samples per second of the stored track; one sample is one byte.
RATE = 8000
#: Payloads are padded to a multiple of this.
PAD = 64

# Element identifiers of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD = 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74
DOC_TYPE, SCALE, TRACK, NUMBER, KIND, CODEC, AUDIO = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0xE1
FREQUENCY, CHANNELS, DEPTH, FRAME_TIME = 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE_BLOCK, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD}

PACKETS = (
    "track bigint, time_ns bigint, begin bigint, end bigint, keyframe boolean, cluster int, block int, lace int"
)


# --- writing -------------------------------------------------------------------------------------------


def size_bytes(n: int) -> bytes:
    """A size in the fewest bytes; all ones is kept for the unknown size."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | (1 << (7 * width))).to_bytes(width, "big")


def element(identifier: int, body: bytes) -> bytes:
    return identifier.to_bytes((identifier.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def _number(identifier: int, value: int) -> bytes:
    return element(identifier, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _real(identifier: int, value: float) -> bytes:
    return element(identifier, struct.pack(">d", value))


def _laced(sizes: list[int]) -> tuple[int, bytes]:
    """Flag bits and head of a block with frames of these sizes."""
    if len(sizes) == 1:
        return 0, b""
    head = bytes([len(sizes) - 1])
    if min(sizes) == max(sizes):
        return 0x04, head
    head += size_bytes(sizes[0])
    for before, size in zip(sizes, sizes[1:-1], strict=False):  # the last size follows from the block
        gap, width = size - before, 1
        while not -(1 << (7 * width - 1)) < gap < (1 << (7 * width - 1)):
            width += 1
        head += ((gap + (1 << (7 * width - 1)) - 1) | (1 << (7 * width))).to_bytes(width, "big")
    return 0x06, head


_HEAD = element(
    EBML,
    _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + element(DOC_TYPE, b"matroska")
    + _number(0x4287, 4) + _number(0x4285, 2),
)
_INFO = element(INFO, _number(SCALE, 1_000_000) + element(0x4D80, b"lexivec") + element(0x5741, b"lexivec"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK,
        _number(NUMBER, 1) + _number(0x73C5, 1) + _number(KIND, 2) + _number(0x9C, 1)
        + _number(FRAME_TIME, FRAME * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT")
        + element(AUDIO, _real(FREQUENCY, RATE) + _number(CHANNELS, 1) + _number(DEPTH, 8)),
    ),
)


def write(payload: bytes) -> bytes:
    """A file that holds ``payload`` as 8-bit samples."""
    body, cues = [_INFO, _TRACKS], []
    at = len(_INFO) + len(_TRACKS)
    per_block, per_cluster = FRAME * LACE, FRAME * LACE * BLOCKS
    for start in range(0, len(payload), per_cluster):
        time = start * 1000 // RATE
        parts = [_number(TIME, time)]
        for first in range(start, min(start + per_cluster, len(payload)), per_block):
            last = min(first + per_block, len(payload))
            sizes = [min(FRAME, last - k) for k in range(first, last, FRAME)]
            flags, head = _laced(sizes)
            stamp = struct.pack(">hB", first * 1000 // RATE - time, 0x80 | flags)
            parts.append(element(SIMPLE_BLOCK, b"\x81" + stamp + head + payload[first:last]))
        cluster = element(CLUSTER, b"".join(parts))
        place = element(CUE_PLACE, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))
        cues.append(element(CUE_POINT, _number(CUE_TIME, time) + place))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


# --- reading -------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """The file ends inside an element or breaks a rule of its format."""


class Packet(NamedTuple):
    track: int
    time_ns: int
    begin: int
    end: int
    keyframe: bool
    cluster: int
    block: int
    lace: int


class Cue(NamedTuple):
    time_ns: int
    track: int
    position: int  # of the cluster in the file


class Track(NamedTuple):
    number: int
    kind: int
    codec: str
    rate: float
    channels: int
    depth: int
    frame_ns: int


def _vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int, int]:
    """Value, width and next position of a number of variable length."""
    if at >= end or data[at] == 0:
        raise Damaged("number")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged("number")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if marker else value & ((1 << (7 * width)) - 1)), width, at + width


class Reader:
    """Parses one file; what came before any damage stays."""

    def __init__(self, data: bytes):
        self.data = data
        self.scale = 1_000_000
        self.doc_type = ""
        self.tracks: list[Track] = []
        self.packets: list[Packet] = []
        self.cues: list[Cue] = []
        self.clusters = self.blocks = 0
        self.whole = True
        try:
            if not data:
                raise Damaged("empty")
            for identifier, begin, end in self._children(0, len(data), {EBML, SEGMENT}):
                if identifier == EBML:
                    for k, a, b in self._children(begin, end):
                        if k == DOC_TYPE:
                            self.doc_type = data[a:b].decode("ascii", "replace").rstrip("\0")
                elif identifier == SEGMENT:
                    self._segment(begin, end)
        except Damaged:
            self.whole = False

    def _children(self, at: int, end: int, level: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """Identifier and content range of the elements in a range; an unknown size ends before ``level``."""
        while at < end:
            identifier, width, at = _vint(self.data, at, end, True)
            if width > 4:
                raise Damaged("identifier")
            size, width, at = _vint(self.data, at, end)
            if size == (1 << (7 * width)) - 1:
                stop = self._until(at, end, level or set()) if identifier != SEGMENT else end
            else:
                stop = at + size
                if stop > end:
                    if identifier in (SEGMENT, CLUSTER):  # read what is there
                        yield identifier, at, end
                    raise Damaged("size")
            yield identifier, at, stop
            at = stop

    def _until(self, at: int, end: int, level: set[int]) -> int:
        while at < end:
            identifier, _, body = _vint(self.data, at, end, True)
            if identifier in level:
                return at
            size, _, body = _vint(self.data, body, end)
            at = body + size
        return end

    def _number(self, begin: int, end: int) -> int:
        return int.from_bytes(self.data[begin:end], "big")

    def _real(self, begin: int, end: int) -> float:
        kind = {4: ">f", 8: ">d"}.get(end - begin)
        return struct.unpack(kind, self.data[begin:end])[0] if kind else 0.0

    def _segment(self, begin: int, end: int) -> None:
        for identifier, a, b in self._children(begin, end, _TOP):
            if identifier == INFO:
                for k, x, y in self._children(a, b):
                    if k == SCALE:
                        self.scale = self._number(x, y)
            elif identifier == TRACKS:
                for k, x, y in self._children(a, b):
                    if k == TRACK:
                        self._track(x, y)
            elif identifier == CLUSTER:
                self._cluster(a, b)
            elif identifier == CUES:
                self._cues(a, b, begin)

    def _track(self, begin: int, end: int) -> None:
        number = kind = depth = frame_ns = 0
        channels, codec, rate = 1, "", 8000.0
        for k, a, b in self._children(begin, end):
            if k == NUMBER:
                number = self._number(a, b)
            elif k == KIND:
                kind = self._number(a, b)
            elif k == FRAME_TIME:
                frame_ns = self._number(a, b)
            elif k == CODEC:
                codec = self.data[a:b].decode("ascii", "replace").rstrip("\0")
            elif k == AUDIO:
                for j, x, y in self._children(a, b):
                    if j == FREQUENCY:
                        rate = self._real(x, y)
                    elif j == CHANNELS:
                        channels = self._number(x, y)
                    elif j == DEPTH:
                        depth = self._number(x, y)
        self.tracks.append(Track(number, kind, codec, rate, channels, depth, frame_ns))

    def _cluster(self, begin: int, end: int) -> None:
        time, place = 0, self.clusters
        self.clusters += 1
        for k, a, b in self._children(begin, end):
            if k == TIME:
                time = self._number(a, b)
            elif k == SIMPLE_BLOCK:
                self._block(a, b, time, place, bool(self.data[min(a + 3, b - 1)] & 0x80) if b > a else False)
            elif k == GROUP:
                inner = list(self._children(a, b))
                key = all(j != 0xFB for j, _, _ in inner)  # without a reference to another block
                for j, x, y in inner:
                    if j == BLOCK:
                        self._block(x, y, time, place, key)

    def _block(self, begin: int, end: int, time: int, place: int, key: bool) -> None:
        track, _, at = _vint(self.data, begin, end)
        if at + 3 > end:
            raise Damaged("block")
        offset, flags = struct.unpack(">hB", self.data[at : at + 3])
        at += 3
        kind = flags & 0x06
        sizes = [end - at]
        if kind:
            if at >= end:
                raise Damaged("lacing")
            count = self.data[at] + 1
            at, sizes = at + 1, []
            if kind == 0x04:
                if (end - at) % count:
                    raise Damaged("lacing")
                sizes = [(end - at) // count] * count
            elif kind == 0x02:
                for _ in range(count - 1):
                    size = 0
                    while True:
                        if at >= end:
                            raise Damaged("lacing")
                        size += self.data[at]
                        at += 1
                        if self.data[at - 1] != 255:
                            break
                    sizes.append(size)
            else:
                for k in range(count - 1):
                    value, width, at = _vint(self.data, at, end)
                    sizes.append(value if k == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
            if kind != 0x04:
                sizes.append(end - at - sum(sizes))
            if min(sizes) < 0:
                raise Damaged("lacing")
        stamp = (time + offset) * self.scale
        frame_ns = next((t.frame_ns for t in self.tracks if t.number == track), 0)
        for lace, size in enumerate(sizes):
            self.packets.append(Packet(track, stamp + lace * frame_ns, at, at + size, key, place, self.blocks, lace))
            at += size
        self.blocks += 1

    def _cues(self, begin: int, end: int, origin: int) -> None:
        for k, a, b in self._children(begin, end):
            if k != CUE_POINT:
                continue
            time = 0
            for j, x, y in self._children(a, b):
                if j == CUE_TIME:
                    time = self._number(x, y)
                elif j == CUE_PLACE:
                    track = position = 0
                    for i, p, q in self._children(x, y):
                        if i == CUE_TRACK:
                            track = self._number(p, q)
                        elif i == CUE_CLUSTER:
                            position = self._number(p, q)
                    self.cues.append(Cue(time * self.scale, track, origin + position))

    def payload(self, track: int) -> bytes:
        """The frames of a track end to end."""
        return b"".join(self.data[p.begin : p.end] for p in self.packets if p.track == track)


# --- columns -------------------------------------------------------------------------------------------


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in slices(offsets):
            sizes = np.diff(offsets[lo : hi + 1])
            media = []
            for a, n in zip(offsets[lo:hi].tolist(), sizes.tolist(), strict=True):
                pad = -n % PAD or (PAD if n == 0 else 0)
                media.append(write(data[a : a + n].tobytes() + bytes(pad)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )


def as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text, padded with zeros to a multiple of ``PAD``, as a file."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_writer, f"doc_id {kind}, n_bytes bigint, media binary")


def _files(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, offsets = text_bytes(batch.column(column))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def _table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = Packet._fields
    for batch in batches:
        for row, media in enumerate(_files(batch, 1)):
            found = Reader(media)
            if not found.packets:
                continue
            columns = list(zip(*found.packets, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            key = batch.column(0).take(pa.array(np.full(len(found.packets), row)))
            yield pa.RecordBatch.from_arrays(
                [key, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names]
            )


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row per packet of every file: track, time, byte range, place."""
    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("doc_id"), F.col(media).alias("media")).mapInArrow(_table_of, f"doc_id {kind}, {PACKETS}")


def _summary(media: bytes) -> tuple:
    found = Reader(media)
    track = found.tracks[0] if found.tracks else Track(0, 0, "", 0.0, 0, 0, 0)
    payload = found.payload(track.number)
    samples = np.frombuffer(payload, np.uint8)
    mean = float(samples.mean()) if len(samples) else 0.0
    end = max((p.time_ns for p in found.packets), default=0)
    feature = (
        f"{found.doc_type};{track.codec};rate={track.rate:.0f};channels={track.channels};depth={track.depth};"
        f"clusters={found.clusters};blocks={found.blocks};packets={len(found.packets)};cues={len(found.cues)};"
        f"last_ms={end // 1_000_000};mean={mean:.4f}"
    )
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, found.whole,
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(_summary(media) for media in _files(batch, 2)), strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "whole"],
        )


def features(files: DataFrame) -> DataFrame:
    """Features of (doc_id, n_bytes, media): what is read back from the stored bytes of the first track."""
    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "n_bytes", "media").mapInArrow(
        _reader,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string, whole boolean",
    )
