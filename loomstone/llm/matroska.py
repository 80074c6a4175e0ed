"""Media columns: Matroska files written from payloads and parsed back into packet tables.

The writer makes one PCM track of 8-bit samples: EBML header, Segment with Info, Tracks, Clusters of laced
SimpleBlocks, and Cues. The parser reads any element tree by its variable-length ids and sizes, follows
clusters, Xiph, EBML and fixed-size lacing, and gives each packet's track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, read, slices, values
from .registry import query

# Fixed values of the Matroska format: element ids, with their length marker.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose data are elements.
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS))
#: Elements that stand in a Segment; one of them ends a Cluster of unknown size.
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples a packet, packets a block, blocks a cluster; 8000 samples a second.
FRAME, LACED, BLOCKS, RATE = 576, 8, 32, 8000


def vint(value: int, width: int | None = None) -> bytes:
    """A size as a variable-length integer, in the fewest bytes or in `width`; all ones is kept for unknown sizes."""
    if width is None:
        width = next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | value).to_bytes(width, "big")


def element(code: int, data: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(code: int, value: int) -> bytes:
    return element(code, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def timestamp(packet: int, frame: int = FRAME) -> int:
    """Milliseconds at which a packet begins."""
    return packet * frame * 1000 // RATE


def laced(frames: list[bytes], kind: int) -> bytes:
    """A block's data after its flags."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) <= (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def padded(data: bytes, frame: int = FRAME) -> bytes:
    """The bytes, with bytes 255 up to a positive multiple of the frame."""
    return data + b"\xff" * (max(1, -(-len(data) // frame)) * frame - len(data))


def mux(payload: bytes, lacing: int = EBML_LACING, frame: int = FRAME, per_block: int = LACED, per_cluster: int = BLOCKS) -> bytes:
    """A Matroska file whose only track holds the payload as packets of `frame` 8-bit samples."""
    packets = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    per_block = 1 if lacing == NO_LACING else min(per_block, 255)
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"loomstone") + element(WRITING_APP, b"loomstone") + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    body = [info, element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + audio))]
    at, cues = sum(map(len, body)), []
    for first in range(0, len(packets), per_block * per_cluster):
        begins = timestamp(first, frame)
        blocks = [number(CLUSTER_TIMESTAMP, begins)]
        for k in range(first, min(len(packets), first + per_block * per_cluster), per_block):
            frames = packets[k : k + per_block]
            kind = lacing if len(frames) > 1 else NO_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", timestamp(k, frame) - begins, 0x80 | kind << 1) + laced(frames, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, begins) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, int]:
    """Value (-1: unknown size), place after it, and bytes used; with marker, the id as written."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the integer at byte {at} is cut off")
    raw = int.from_bytes(data[at : at + width], "big")
    if not marker:
        raw ^= 1 << 7 * width
        raw = -1 if raw == (1 << 7 * width) - 1 else raw
    return raw, at + width, width


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """Each element as id, first byte and end of its data; a master is followed by what it holds."""
    end = len(data) if end is None else end
    while at < end:
        code, at, _ = read_vint(data, at, marker=True)
        n, at, _ = read_vint(data, at)
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"the element of id {code:x} ends after what holds it")
        if n < 0 and code == CLUSTER:
            stop = at
            while stop < end and read_vint(data, stop, marker=True)[0] not in TOP_LEVEL:
                size, start, _ = read_vint(data, read_vint(data, stop, marker=True)[1])
                stop = start + size
        yield code, at, stop
        if code not in MASTERS:
            at = stop
        # a master's elements come next; end stays that of the outermost
    if at != end:
        raise ValueError("an element ends after the data")


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """The frames of a block as byte ranges of the data."""
    if kind == NO_LACING:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == EBML_LACING and count > 1:
        n, at, _ = read_vint(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            raw, at, width = read_vint(data, at)
            raw = (1 << 7 * width) - 1 if raw < 0 else raw
            sizes.append(sizes[-1] + raw - (1 << 7 * width - 1) + 1)
    elif kind == FIXED:
        if (end - at) % count:
            raise ValueError("the frames of a fixed-size lacing aren't of one size")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def demux(data: bytes) -> dict:
    """A file's tracks, packets (track, timestamp in ms, first byte, end), cues (time, track, cluster's place) and clusters."""
    packets, cues, clusters, tracks = [], [], [], []
    scale, begins, segment, cue, lasts = 1_000_000, 0, 0, [0, 0], {}
    for code, at, end in elements(data):
        if code == SEGMENT:
            segment = at
        elif code == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif code == TRACK_ENTRY:
            tracks.append(None)
        elif code == TRACK_NUMBER:
            tracks[-1] = int.from_bytes(data[at:end], "big")
        elif code == DEFAULT_DURATION:
            lasts[tracks[-1]] = int.from_bytes(data[at:end], "big")
        elif code == CLUSTER:
            clusters.append(at)
        elif code == CLUSTER_TIMESTAMP:
            begins = int.from_bytes(data[at:end], "big")
        elif code in (SIMPLE_BLOCK, BLOCK):
            track, at, _ = read_vint(data, at)
            offset, flags = struct.unpack(">hB", data[at : at + 3])
            first = (begins + offset) * scale // 1_000_000
            for k, (a, b) in enumerate(unlace(data, at + 3, end, flags >> 1 & 3)):
                packets.append((track, first + k * lasts.get(track, 0) // 1_000_000, a, b))
        elif code == CUE_TIME:
            cue[0] = int.from_bytes(data[at:end], "big") * scale // 1_000_000
        elif code == CUE_TRACK:
            cue[1] = int.from_bytes(data[at:end], "big")
        elif code == CUE_CLUSTER_POSITION:
            cues.append((cue[0], cue[1], segment + int.from_bytes(data[at:end], "big")))
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters}


PACKETS = "array<struct<track:int,timestamp_ms:long,first_byte:long,end_byte:long>>"


def media(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key and a text or binary column -> key, n_bytes, media (the Matroska file); null counts as empty."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches):
        for batch in batches:
            for part in slices(batch, "data"):
                data = values(part.column(1))
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(map(len, data), pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())], schema=schema)

    return rows.selectExpr(f"cast({key} as long) key", f"cast({column} as binary) data").mapInArrow(lean(write), "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def packet_table(files: DataFrame, key: str, column: str = "media") -> DataFrame:
    """key and a binary column of Matroska files -> a row a packet: key, track, timestamp_ms, first_byte, end_byte, problem.

    A file that breaks off or is malformed gives one row, of its key and of what is wrong in `problem`, and no packets;
    of whole files problem is null. Null and empty files have no rows. Repeated files are parsed each; other columns
    are left out, so that no name can clash.
    """
    schema = pa.schema([("key", pa.int64()), ("track", pa.int32()), ("timestamp_ms", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("problem", pa.string())])

    def parse(batches):
        for batch in batches:
            for part in slices(batch, "data"):
                rows = []
                for k, x in zip(part.column(0).to_pylist(), values(part.column(1))):
                    try:
                        rows += [(k, *p, None) for p in demux(x)["packets"]] if x else []
                    except (ValueError, IndexError, struct.error) as e:
                        rows.append((k, None, None, None, None, str(e) or type(e).__name__))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return files.selectExpr(f"cast({key} as long) key", f"{column} data").mapInArrow(lean(parse), "key long, track int, timestamp_ms long, first_byte long, end_byte long, problem string").withColumnRenamed("key", key)


def digest(stored: bytes) -> tuple:
    """What is read back from a file: payload bytes, sha256 and last packet's crc32, file bytes, its sha256, a feature line."""
    found = demux(stored)
    payload = b"".join(stored[a:b] for _, _, a, b in found["packets"])
    starts = set(found["clusters"])
    # a cue points at a cluster's id; its data begin after id and size
    seekable = sum(read_vint(stored, p + 4)[1] in starts for _, _, p in found["cues"])
    mean = sum(payload) / len(payload) if payload else 0.0
    feature = f"packets={len(found['packets'])};clusters={len(found['clusters'])};cues={seekable};end_ms={max((p[1] for p in found['packets']), default=0)};mean={mean:.6f};peak={max(payload, default=0)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


@query("op5_media_matroska")
def op5_media_matroska(spark, sf_dir):
    """Every document as a Matroska file: digests of what parsing the file gives back.

    One pass without a shuffle: a document is stored and read back in the task that holds it. Null and empty
    texts are one packet of padding; equal texts give equal rows but for their ids.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in fields.split(", "))])

    def read_back(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = [digest(x) for x in values(part.column(2))]
                columns = [pa.array(c, schema.field(i + 2).type) for i, c in enumerate(zip(*rows) if rows else [[]] * 6)]
                yield pa.record_batch([part.column(0), part.column(1), *columns], schema=schema)

    return media(read(spark, sf_dir, "documents"), "doc_id", "text").mapInArrow(lean(read_back), fields)
