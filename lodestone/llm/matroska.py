"""Matroska media columns: a writer of 8-bit PCM tracks and a parser of EBML elements into packet tables.

The parser reads variable-length element ids and sizes (unknown sizes too), clusters, simple blocks and block groups,
all three lacings (Xiph, EBML, fixed-size) and cues. A packet is one frame: track, timestamp, byte range, key flag.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import ship, with_text
from lodestone.llm.textkit import blocks, lean

# Element ids of the Matroska specification (RFC 9559) and of EBML (RFC 8794).
EBML, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_FIELDS = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4287, 4), (0x4285, 2))
DOC_TYPE = 0x4282
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, LACED, CLUSTER_FRAMES = 8000, 512, 8, 80


def vint(value: int, length: int = 0) -> bytes:
    """A size as a variable-length integer; all-ones patterns stay reserved for unknown sizes."""
    n = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, value: int, width: int = 0) -> bytes:
    return element(eid, value.to_bytes(width or max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int, flags: int) -> bytes:
    """The body of a (simple) block."""
    head = vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([flags | lacing << 1])
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    elif len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return head + b"".join(frames)


def signed_vint(value: int) -> bytes:
    n = next(k for k in range(1, 9) if -(1 << 7 * k - 1) < value < 1 << 7 * k - 1)
    return vint(value + (1 << 7 * n - 1) - 1, n)


def mux(samples: bytes, rate: int = RATE) -> bytes:
    """One mono 8-bit PCM track with these samples."""
    header = element(EBML, b"".join(uint(i, v) for i, v in EBML_FIELDS[:4]) + element(DOC_TYPE, b"matroska") + b"".join(uint(i, v) for i, v in EBML_FIELDS[4:]))
    step = FRAME * 1000 // rate
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array(len(samples) * 1000 / rate, ">f8").tobytes()) + element(MUXING_APP, b"lodestone") + element(WRITING_APP, b"lodestone"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(rate, ">f8").tobytes()) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, step * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    seek = lambda at: element(SEEK_HEAD, b"".join(element(SEEK, element(SEEK_ID, i.to_bytes(4, "big")) + uint(SEEK_POSITION, p, 8)) for i, p in at))
    first = len(seek([(INFO, 0), (TRACKS, 0), (CUES, 0)]))
    at = first + len(info) + len(tracks)
    clusters, cues = [], []
    for c in range(0, len(frames), CLUSTER_FRAMES):
        body = uint(TIMESTAMP, c * step)
        for b in range(c, min(c + CLUSTER_FRAMES, len(frames)), LACED):
            group = frames[b : min(b + LACED, c + CLUSTER_FRAMES)]
            lacing = NO_LACING if len(group) == 1 else FIXED_LACING if len(group[-1]) == FRAME else EBML_LACING
            body += element(SIMPLE_BLOCK, block(1, (b - c) * step, group, lacing, 0x80))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c * step) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        clusters.append(element(CLUSTER, body))
        at += len(clusters[-1])
    body = seek([(INFO, first), (TRACKS, first + len(info)), (CUES, at)]) + info + tracks + b"".join(clusters) + element(CUES, b"".join(cues))
    return header + element(SEGMENT, body)


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, byte offset, bytes, key, cluster, lacing)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (time in ns, track, absolute byte offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next offset); None for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return raw, at + n
    value = raw & (1 << 7 * n) - 1
    return None if value == (1 << 7 * n) - 1 else value, at + n


def elements(data: bytes, at: int, end: int, parents: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end); an element of unknown size ends before the next one of a parent's level."""
    while at < end:
        eid, body = read_vint(data, at, True)
        size, body = read_vint(data, body)
        if size is None:
            stop = body
            while stop < end:
                nid, p = read_vint(data, stop, True)
                if nid in parents or nid == eid:
                    break
                nsize, p = read_vint(data, p)
                stop = end if nsize is None else p + nsize
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element {eid:x} at byte {at} is cut off")
        yield eid, body, stop
        at = stop


TOP = frozenset({SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1941A469, 0x1254C367})


def parse(data: bytes) -> Media:
    """All packets of a file; ValueError where it is damaged."""
    m = Media()
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: float(np.frombuffer(data[a:b], ">f4" if b - a == 4 else ">f8")[0]) if b > a else 0.0
    durations: dict[int, int] = {}
    for eid, a, b in elements(data, 0, len(data), frozenset({EBML, SEGMENT})):
        if eid == EBML:
            for x, p, q in elements(data, a, b):
                if x == DOC_TYPE:
                    m.doc_type = data[p:q].rstrip(b"\0").decode()
        if eid != SEGMENT:
            continue
        segment = a
        for top, p, q in elements(data, a, b, TOP):
            if top == INFO:
                for x, s, t in elements(data, p, q):
                    if x == TIMESTAMP_SCALE:
                        m.scale = number(s, t)
                    elif x == DURATION:
                        m.duration = real(s, t)
            elif top == TRACKS:
                for x, s, t in elements(data, p, q):
                    if x == TRACK_ENTRY:
                        entry: dict = {"type": 0, "codec": "", "channels": 1, "bits": 0, "rate": 8000.0}
                        for y, u, v in elements(data, s, t):
                            if y == TRACK_NUMBER:
                                entry["number"] = number(u, v)
                            elif y == TRACK_TYPE:
                                entry["type"] = number(u, v)
                            elif y == CODEC_ID:
                                entry["codec"] = data[u:v].decode()
                            elif y == DEFAULT_DURATION:
                                durations[entry.get("number", 0)] = number(u, v)
                            elif y == AUDIO:
                                for z, g, h in elements(data, u, v):
                                    if z == SAMPLING_FREQUENCY:
                                        entry["rate"] = real(g, h)
                                    elif z == CHANNELS:
                                        entry["channels"] = number(g, h)
                                    elif z == BIT_DEPTH:
                                        entry["bits"] = number(g, h)
                        m.tracks[entry.get("number", 0)] = entry
            elif top == CLUSTER:
                base = 0
                m.clusters.append(p)
                for x, s, t in elements(data, p, q, TOP):
                    if x == TIMESTAMP:
                        base = number(s, t)
                    elif x == SIMPLE_BLOCK:
                        _block(data, s, t, base, m, durations, bool(data[_flags_at(data, s)] & 0x80))
                    elif x == BLOCK_GROUP:
                        inner = {y: (u, v) for y, u, v in elements(data, s, t)}
                        if BLOCK in inner:
                            _block(data, *inner[BLOCK], base, m, durations, REFERENCE_BLOCK not in inner)
            elif top == CUES:
                for x, s, t in elements(data, p, q):
                    if x != CUE_POINT:
                        continue
                    time = 0
                    for y, u, v in elements(data, s, t):
                        if y == CUE_TIME:
                            time = number(u, v)
                        elif y == CUE_TRACK_POSITIONS:
                            got = {z: number(g, h) for z, g, h in elements(data, u, v)}
                            m.cues.append((time * m.scale, got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))
    return m


def _flags_at(data: bytes, at: int) -> int:
    return read_vint(data, at)[1] + 2


def _block(data: bytes, a: int, b: int, base: int, m: Media, durations: dict[int, int], key: bool) -> None:
    track, at = read_vint(data, a)
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    lacing = data[at + 2] >> 1 & 3
    at += 3
    sizes: list[int] = []
    if lacing != NO_LACING:
        count = data[at] + 1
        at += 1
        if lacing == FIXED_LACING:
            if (b - at) % count:
                raise ValueError(f"fixed-size lacing at byte {a} doesn't divide")
            sizes = [(b - at) // count] * (count - 1)
        elif lacing == XIPH_LACING:
            for _ in range(count - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        else:
            for k in range(count - 1):
                before = at
                value, at = read_vint(data, at)
                if k:
                    raw = value if value is not None else (1 << 7 * (at - before)) - 1
                    value = sizes[-1] + raw - ((1 << 7 * (at - before) - 1) - 1)
                sizes.append(value or 0)
    sizes.append(b - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing at byte {a} is longer than its block")
    step, cluster = durations.get(track, 0), len(m.clusters) - 1
    for k, size in enumerate(sizes):
        m.packets.append((track, (base + relative) * m.scale + k * step, at, size, key, cluster, lacing))
        at += size


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def feature(m: Media, payload: bytes) -> str:
    """Packet statistics and the samples' mean, energy and zero crossings, in integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    laced = [sum(p[6] == k for p in m.packets) for k in range(4)]
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"tracks={len(m.tracks)};clusters={len(m.clusters)};cues={len(m.cues)};packets={len(m.packets)};laced={'/'.join(map(str, laced))};ns={round(m.duration * m.scale)};last={m.packets[-1][1]};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};crossings={crossings}"


def store_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary: each text as a Matroska file. Null texts are empty; every row gives one row."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in blocks(batch, "text")):
            stored = [payload_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array([n for _, n in stored], pa.int64()), "media": pa.array([mux(p) for p, _ in stored], pa.binary())})

    return with_text(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def packet_table(spark: SparkSession, media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of a binary column: key, packet, track, timestamp_ns, offset, size, is_key, cluster, lacing.

    Null media give no rows; a damaged file gives one row with packet = -1 and its error text.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                try:
                    rows += [(k, i, *p, None) for i, p in enumerate(parse(raw).packets)]
                except (ValueError, IndexError) as e:
                    rows.append((k, -1, None, None, None, None, None, None, None, str(e)))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(10)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "packet", "track", "timestamp_ns", "offset", "size", "is_key", "cluster", "lacing", "error"])

    return media.selectExpr(f"cast(`{key}` as long) as key", f"`{column}` as media").mapInArrow(lean(run), "key long, packet int, track int, timestamp_ns long, offset long, size long, is_key boolean, cluster int, lacing int, error string")


def media_digest(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the query's columns, from the packets read back.

    Null media have null columns but for doc_id and n_bytes; so have damaged files, with their media_bytes and media_sha256
    and the error in `feature`. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for raw in b.column("media").to_pylist():
                if raw is None:
                    values = (None,) * 6
                else:
                    try:
                        m = parse(raw)
                        payload = b"".join(raw[p[2] : p[2] + p[3]] for p in m.packets)
                        values = (len(payload), sha(payload), zlib.crc32(payload[-64:]), len(raw), sha(raw), feature(m, payload))
                    except (ValueError, IndexError, ZeroDivisionError) as e:
                        values = (None, None, None, len(raw), sha(raw), f"error: {e}")
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
