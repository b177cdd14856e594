"""Matroska: payloads stored as 8-bit PCM tracks, and a parser into packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown sizes
included), clusters with SimpleBlocks and BlockGroups, the four kinds of lacing, and
cues. Packets carry track, timestamp and byte range; samples are read by those ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, text_of

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8000, 1024, 8, 8


def vint(value: int, width: int = 0) -> bytes:
    """A size; the value of all ones is left to unknown sizes."""
    need = next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    n = max(need, width)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(sizes: list[int], kind: int) -> bytes:
    """The lace head of a block: the frame count less 1, then all sizes but the last."""
    head = bytes([len(sizes) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == EBML_LACING:
        head += vint(sizes[0])
        for before, size in zip(sizes, sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(size - before) < 1 << 7 * n - 1)
            head += ((size - before) + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head


def block(track: int, offset: int, frames: list[bytes], keyframe: bool = True) -> bytes:
    """Content of a SimpleBlock: equal frames by fixed lacing, others by EBML lacing."""
    sizes = [len(f) for f in frames]
    kind = NO_LACING if len(frames) == 1 else FIXED if len(set(sizes)) == 1 else EBML_LACING
    head = vint(track) + struct.pack(">hB", offset, (0x80 if keyframe else 0) | kind << 1)
    return head + (laced(sizes, kind) if kind else b"") + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """``payload`` as the samples of one mono track: unsigned 8-bit, 8 kHz."""
    ms = 1000 * FRAME // RATE
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(
        EBML, number(EBML_VERSION, 1), number(EBML_READ_VERSION, 1), number(EBML_MAX_ID, 4), number(EBML_MAX_SIZE, 8),
        element(DOC_TYPE, b"matroska"), number(DOC_TYPE_VERSION, 4), number(DOC_TYPE_READ_VERSION, 2),
    )
    duration = struct.pack(">d", 1000 * len(payload) / RATE)
    parts = [
        element(INFO, number(TIMESTAMP_SCALE, 1_000_000), element(MUXING_APP, b"lodestone"), element(WRITING_APP, b"lodestone"), element(DURATION, duration)),
        element(TRACKS, element(
            TRACK_ENTRY, number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), number(FLAG_LACING, 1), element(CODEC_ID, b"A_PCM/INT/LIT"),
            number(DEFAULT_DURATION, ms * 1_000_000),
            element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)), number(CHANNELS, 1), number(BIT_DEPTH, 8)),
        )),
    ]
    at, points = sum(map(len, parts)), []
    step = FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for first in range(0, len(frames), step):
        blocks = [
            element(SIMPLE_BLOCK, block(1, (i - first) * ms, frames[i : min(i + FRAMES_IN_BLOCK, first + step)]))
            for i in range(first, min(first + step, len(frames)), FRAMES_IN_BLOCK)
        ]
        parts.append(element(CLUSTER, number(TIMESTAMP, first * ms), *blocks))
        points.append(element(CUE_POINT, number(CUE_TIME, first * ms), element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    parts.append(element(CUES, *points))
    return head + element(SEGMENT, *parts)


class Malformed(ValueError):
    """The bytes are no Matroska file that can be read."""


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data):
        raise Malformed("an id is cut off")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Malformed("an id is too long")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A size (None: unknown) and the place after it."""
    if at >= len(data):
        raise Malformed("a size is cut off")
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > len(data):
        raise Malformed("a size is too long")
    value = int.from_bytes(data[at : at + n], "big") ^ 1 << 7 * n
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the contents of the elements from ``at`` to ``end``. An element
    of unknown size ends before the next one that can't be inside it."""
    while at < end:
        name, at = read_id(data, at)
        size, at = read_vint(data, at)
        if size is None:
            if name not in (SEGMENT, CLUSTER):
                raise Malformed("unknown size")
            stop = at
            while stop < end:
                inner, after = read_id(data, stop)
                if inner == SEGMENT or inner == EBML or (name == CLUSTER and inner in TOP_LEVEL):
                    break
                inner_size, after = read_vint(data, after)
                if inner_size is None:
                    if name != SEGMENT or inner != CLUSTER:
                        raise Malformed("unknown size")
                    stop = after
                    while stop < end:
                        deep, deep_at = read_id(data, stop)
                        if deep in TOP_LEVEL or deep in (SEGMENT, EBML):
                            break
                        deep_size, deep_at = read_vint(data, deep_at)
                        if deep_size is None:
                            raise Malformed("unknown size")
                        stop = deep_at + deep_size
                    continue
                stop = after + inner_size
        else:
            stop = at + size
        if stop > end:
            raise Malformed("an element is cut off")
        yield name, at, stop
        at = stop


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Of a block: track, timestamp against the cluster, keyframe, frames' (start, length)."""
    track, at = read_vint(data, at)
    if track is None or at + 3 > end:
        raise Malformed("a block is cut off")
    offset, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, offset, bool(flags & 0x80), [(at, end - at)]
    if at >= end:
        raise Malformed("a lace is cut off")
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % n:
            raise Malformed("frames of a fixed lace differ")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                start = at
                value, at = read_vint(data, at)
                if value is None:
                    value = (1 << 7 * (at - start)) - 1
                size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("a lace exceeds its block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return track, offset, bool(flags & 0x80), list(zip(starts, sizes))


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end - at in (4, 8) else 0.0


def parse(data: bytes) -> dict:
    """tracks by number, packets (track, timestamp ns, keyframe, cluster, offset, length)
    in file order, and cues (time ns, track, cluster's offset in the file)."""
    tracks: dict[int, dict] = {}
    packets: list[tuple] = []
    cues: list[tuple] = []
    scale, clusters, seen = 1_000_000, 0, set()
    for name, at, end in children(data, 0, len(data)):
        seen.add(name)
        if name == EBML:
            doc_type = [data[a:b] for n, a, b in children(data, at, end) if n == DOC_TYPE]
            if doc_type and doc_type[0].rstrip(b"\0") not in (b"matroska", b"webm"):
                raise Malformed("not Matroska")
        if name != SEGMENT:
            continue
        base = at
        for part, a, b in children(data, at, end):
            if part == INFO:
                scale = next((_uint(data, x, y) for n, x, y in children(data, a, b) if n == TIMESTAMP_SCALE), scale)
            elif part == TRACKS:
                for n, x, y in children(data, a, b):
                    if n == TRACK_ENTRY:
                        track = {"codec": "", "type": 0, "rate": 8000.0, "channels": 1, "bits": 0, "frame_ns": 0}
                        number_ = 0
                        for m, p, q in children(data, x, y):
                            if m == TRACK_NUMBER:
                                number_ = _uint(data, p, q)
                            elif m == TRACK_TYPE:
                                track["type"] = _uint(data, p, q)
                            elif m == CODEC_ID:
                                track["codec"] = data[p:q].rstrip(b"\0").decode("ascii", "replace")
                            elif m == DEFAULT_DURATION:
                                track["frame_ns"] = _uint(data, p, q)
                            elif m == AUDIO:
                                for o, r, s in children(data, p, q):
                                    if o == SAMPLING_FREQUENCY:
                                        track["rate"] = _float(data, r, s)
                                    elif o == CHANNELS:
                                        track["channels"] = _uint(data, r, s)
                                    elif o == BIT_DEPTH:
                                        track["bits"] = _uint(data, r, s)
                        tracks[number_] = track
            elif part == CLUSTER:
                start = 0
                for n, x, y in children(data, a, b):
                    if n == TIMESTAMP:
                        start = _uint(data, x, y)
                    elif n in (SIMPLE_BLOCK, BLOCK_GROUP):
                        key, spans = None, [(x, y)]
                        if n == BLOCK_GROUP:
                            inner = list(children(data, x, y))
                            key = not any(m == REFERENCE_BLOCK for m, _, _ in inner)
                            spans = [(p, q) for m, p, q in inner if m == BLOCK]
                        for p, q in spans:
                            track_no, offset, flagged, frames = frames_of(data, p, q)
                            step = tracks.get(track_no, {}).get("frame_ns", 0)
                            for i, (f, length) in enumerate(frames):
                                packets.append((track_no, (start + offset) * scale + i * step, flagged if key is None else key, clusters, f, length))
                clusters += 1
            elif part == CUES:
                for n, x, y in children(data, a, b):
                    if n == CUE_POINT:
                        time, spots = 0, []
                        for m, p, q in children(data, x, y):
                            if m == CUE_TIME:
                                time = _uint(data, p, q) * scale
                            elif m == CUE_TRACK_POSITIONS:
                                inner = {o: _uint(data, r, s) for o, r, s in children(data, p, q)}
                                spots.append((inner.get(CUE_TRACK, 0), base + inner.get(CUE_CLUSTER_POSITION, 0)))
                        cues += [(time, *s) for s in spots]
    if SEGMENT not in seen:
        raise Malformed("no segment")
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters}


def samples(data: bytes, parsed: dict, track: int = 1) -> bytes:
    return b"".join(data[p[4] : p[4] + p[5]] for p in parsed["packets"] if p[0] == track)


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def feature(parsed: dict, body: bytes, track: int = 1) -> str:
    """A track's format, packet, cluster and cue counts, length, and sample statistics."""
    t, x = parsed["tracks"][track], np.frombuffer(body, np.uint8)
    own = [p for p in parsed["packets"] if p[0] == track]
    mean = float(x.mean(dtype=np.float64)) if len(x) else 0.0
    square = float(np.square(x, dtype=np.uint16).sum(dtype=np.int64)) / max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return (
        f"{t['codec']}/{t['rate']:.0f}/{t['channels']}/{t['bits']};packets={len(own)};clusters={parsed['clusters']};cues={len(parsed['cues'])};"
        f"last_ns={max((p[1] for p in own), default=0)};mean={mean:.4f};rms={max(0.0, square) ** 0.5:.4f};crossings={crossings}"
    )


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [mux(pad(t.as_py().encode("utf-8", "surrogatepass"))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for i, media in enumerate(batch.column(1)):
            if media.as_py() is None:
                continue
            try:
                rows += [(i, *p, None) for p in parse(media.as_py())["packets"]]
            except (Malformed, IndexError) as e:
                rows.append((i, None, None, None, None, None, None, str(e)))
        columns = list(zip(*rows)) or [()] * 8
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]],
            names=["doc_id", "track", "timestamp_ns", "keyframe", "cluster", "offset", "length", "error"],
        )


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for text in batch.column(1):
            plain = text.as_py().encode("utf-8", "surrogatepass")
            media = mux(pad(plain))
            parsed = parse(media)
            body = samples(media, parsed)
            rows.append((len(plain), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed, body)))
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes as a Matroska file. Null text: empty, which is
    stored as 64 zero bytes. Repeated rows stay; an empty table gives no rows."""
    return map_arrow(text_of(docs, "doc_id"), _media, f"doc_id {dict(docs.dtypes)['doc_id']}, media binary")


def packets_of(media: DataFrame) -> DataFrame:
    """The packet table of (doc_id, media): track, timestamp_ns, keyframe, cluster, offset
    and length in bytes. Media that can't be parsed give one row with their error; null
    media give none."""
    columns = "track long, timestamp_ns long, keyframe boolean, cluster long, offset long, length long, error string"
    return map_arrow(media.select("doc_id", "media"), _packets, f"doc_id {dict(media.dtypes)['doc_id']}, {columns}")


def stored_features(docs: DataFrame) -> DataFrame:
    """A row for each document: its text stored, read back by the packet table, and the
    digests of both forms. Rows as in ``media_of``; equal texts give equal values."""
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(text_of(docs, "doc_id"), partial(_stored), f"doc_id {dict(docs.dtypes)['doc_id']}, {columns}")
