"""Matroska media columns: a muxer for 8-bit samples and a parser into packet tables.

The parser walks EBML elements of variable-length ids and sizes (unknown sizes too), reads tracks, clusters,
simple blocks and block groups with every kind of lacing, and cues. Each packet comes out with its track,
timestamp, flags and byte range, so a packet's bytes are a slice of the media column.

Defined cases: a null or empty text is a payload of blanks of one packet; a null media value gives no packets
and the error `null`; bytes that aren't Matroska, or that end early, give the packets read so far and an
error, and `read_back` gives a null payload and feature with the error; unknown elements are skipped; a text of any
length is stored whole; repeated rows are parsed each; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element ids of the Matroska specification (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

#: Elements right under the segment; one of them ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 1, 2, 3
LACE_NAMES = ("none", "xiph", "fixed", "ebml")

#: Bytes of a packet: 24 ms of 8-bit samples at 8 kHz.
PACKET, RATE = 192, 8000
PACKET_NS = PACKET * 1_000_000_000 // RATE
FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8, 32


class Broken(ValueError):
    """The bytes don't follow the format."""


def element_id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size of variable length; all ones are kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return element_id(kind) + vint(len(body)) + body


def unsigned(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def double(kind: int, x: float) -> bytes:
    return element(kind, struct.pack(">d", x))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing header and frames of a block's body."""
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH_LACE:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == EBML_LACE:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, packet: int = PACKET) -> bytes:
    """A Matroska file with one 8-bit PCM track whose packets are the payload's slices.

    Blocks take turns with the kinds of lacing; every eighth block stands in a block group.
    """
    frames = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    blocks = [frames[i : i + FRAMES_IN_BLOCK] for i in range(0, len(frames), FRAMES_IN_BLOCK)]
    header = element(
        EBML,
        unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(MAX_ID, 4) + unsigned(MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2),
    )
    per_packet_ms = packet * 1000 / RATE
    info = element(
        INFO,
        unsigned(TIMESTAMP_SCALE, 1_000_000) + double(DURATION, len(frames) * per_packet_ms)
        + element(MUXING_APP, b"quarrystone") + element(WRITING_APP, b"quarrystone"),
    )
    audio = element(AUDIO, double(SAMPLING_FREQUENCY, float(RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    entry = (
        unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1)
        + unsigned(DEFAULT_DURATION, PACKET_NS * packet // PACKET) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    )
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    for c in range(0, len(blocks), BLOCKS_IN_CLUSTER):
        start = round(c * FRAMES_IN_BLOCK * per_packet_ms)
        parts = [unsigned(TIMESTAMP, start)]
        for i, own in enumerate(blocks[c : c + BLOCKS_IN_CLUSTER], c):
            kind = NO_LACE if len(own) == 1 else (FIXED_LACE, XIPH_LACE, EBML_LACE)[i % 3]
            if kind == FIXED_LACE and len({len(f) for f in own}) > 1:
                kind = XIPH_LACE
            relative = round(i * FRAMES_IN_BLOCK * per_packet_ms) - start
            block = b"\x81" + struct.pack(">hB", relative, kind << 1 | (0 if i % 8 == 7 else 0x80)) + lace(own, kind)
            parts.append(element(BLOCK_GROUP, element(BLOCK, block)) if i % 8 == 7 else element(SIMPLE_BLOCK, block))
        cues.append((start, at))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    points = b"".join(
        element(CUE_POINT, unsigned(CUE_TIME, t) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, p)))
        for t, p in cues
    )
    body.append(element(CUES, points))
    return header + element(SEGMENT, b"".join(body))


@dataclass
class Parsed:
    """packets: (cluster, track, timestamp_ns, keyframe, lacing, offset, size); cues: (timestamp_ns, track, cluster's offset)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, bool, str, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    error: str | None = None


def read_vint(data: bytes, at: int, end: int) -> tuple[int, int, bool]:
    """Value without its marker, the offset behind it, and whether all its bits are ones."""
    if at >= end or not data[at]:
        raise Broken(f"no length at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Broken(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return value, at + width, value == (1 << 7 * width) - 1


def read_element(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """Id, offset of the body, and offset behind the body (None: unknown)."""
    if at >= end or data[at] < 0x10:
        raise Broken(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    kind = int.from_bytes(data[at : at + width], "big")
    size, body, unknown = read_vint(data, at + width, end)
    if unknown:
        return kind, body, None
    if body + size > end:
        raise Broken(f"element {kind:X} at byte {at} is cut off")
    return kind, body, body + size


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        kind, body, stop = read_element(data, at, end)
        at = end if stop is None else stop
        yield kind, body, at


def number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def read_block(data: bytes, a: int, b: int, start: int, key: bool | None, out: Parsed) -> None:
    """The packets of a block at data[a:b] of the cluster whose timestamp is start."""
    track, at, _ = read_vint(data, a, b)
    if at + 3 > b:
        raise Broken(f"block at byte {a} is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    sizes: list[int] = []
    if kind == NO_LACE:
        sizes = [b - at]
    else:
        if at >= b:
            raise Broken(f"lace at byte {at} is cut off")
        n = data[at] + 1
        at += 1
        if kind == FIXED_LACE:
            if (b - at) % n:
                raise Broken(f"lace at byte {at} is uneven")
            sizes = [(b - at) // n] * n
        elif kind == XIPH_LACE:
            for _ in range(n - 1):
                size = 0
                while True:
                    if at >= b:
                        raise Broken(f"lace at byte {at} is cut off")
                    size += data[at]
                    at += 1
                    if data[at - 1] < 255:
                        break
                sizes.append(size)
        else:
            for i in range(n - 1):
                before = at
                size, at, _ = read_vint(data, at, b)
                sizes.append(size if not i else sizes[-1] + size - (1 << 7 * (at - before) - 1) + 1)
        if kind != FIXED_LACE:
            sizes.append(b - at - sum(sizes))
        if min(sizes) < 0:
            raise Broken(f"lace at byte {at} is longer than its block")
    time = (start + relative) * out.scale
    step = out.tracks.get(track, {}).get("default_duration", 0)
    for i, size in enumerate(sizes):
        out.packets.append((len(out.clusters) - 1, track, time + i * step, key, LACE_NAMES[kind], at, size))
        at += size


def read_cluster(data: bytes, a: int, b: int | None, end: int, out: Parsed) -> int:
    """Reads a cluster's blocks; returns the offset behind it."""
    at, start = a, 0
    while at < (end if b is None else b):
        kind, body, stop = read_element(data, at, end if b is None else b)
        if b is None and kind in TOP:
            return at
        if stop is None:
            raise Broken(f"element {kind:X} of unknown size in a cluster")
        if kind == TIMESTAMP:
            start = number(data, body, stop)
        elif kind == SIMPLE_BLOCK:
            read_block(data, body, stop, start, None, out)
        elif kind == BLOCK_GROUP:
            inner = list(children(data, body, stop))
            key = all(k != REFERENCE_BLOCK for k, _, _ in inner)
            for k, x, y in inner:
                if k == BLOCK:
                    read_block(data, x, y, start, key, out)
        at = stop
    return at


def read_track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    track: dict = {"type": 0, "codec": "", "default_duration": 0, "rate": 0.0, "channels": 1, "bits": 0}
    no = 0
    for k, x, y in children(data, a, b):
        if k == TRACK_NUMBER:
            no = number(data, x, y)
        elif k == TRACK_TYPE:
            track["type"] = number(data, x, y)
        elif k == CODEC_ID:
            track["codec"] = data[x:y].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            track["default_duration"] = number(data, x, y)
        elif k == AUDIO:
            for kk, xx, yy in children(data, x, y):
                if kk == SAMPLING_FREQUENCY:
                    track["rate"] = real(data, xx, yy)
                elif kk == CHANNELS:
                    track["channels"] = number(data, xx, yy)
                elif kk == BIT_DEPTH:
                    track["bits"] = number(data, xx, yy)
    return no, track


def read_cues(data: bytes, a: int, b: int, segment: int, out: Parsed) -> None:
    for k, x, y in children(data, a, b):
        if k != CUE_POINT:
            continue
        time, spots = 0, []
        for kk, xx, yy in children(data, x, y):
            if kk == CUE_TIME:
                time = number(data, xx, yy)
            elif kk == CUE_TRACK_POSITIONS:
                got = {q: number(data, r, s) for q, r, s in children(data, xx, yy)}
                spots.append((got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))
        out.cues += [(time * out.scale, track, at) for track, at in spots]


def parse(data: bytes | None) -> Parsed:
    """All that a media value says; what is broken ends the reading and is told in error."""
    out = Parsed()
    if data is None:
        out.error = "null"
        return out
    try:
        kind, body, stop = read_element(data, 0, len(data))
        if kind != EBML or stop is None:
            raise Broken("no EBML header")
        kind, segment, stop = read_element(data, stop, len(data))
        if kind != SEGMENT:
            raise Broken("no segment")
        end = len(data) if stop is None else stop
        at = segment
        while at < end:
            place = at
            kind, body, stop = read_element(data, at, end)
            if kind == CLUSTER:
                out.clusters.append(place)
                at = read_cluster(data, body, stop, end, out)
                continue
            if stop is None:
                raise Broken(f"element {kind:X} of unknown size")
            if kind == INFO:
                for k, x, y in children(data, body, stop):
                    if k == TIMESTAMP_SCALE:
                        out.scale = number(data, x, y)
                    elif k == DURATION:
                        out.duration = real(data, x, y)
            elif kind == TRACKS:
                out.tracks |= dict(read_track(data, x, y) for k, x, y in children(data, body, stop) if k == TRACK_ENTRY)
            elif kind == CUES:
                read_cues(data, body, stop, segment, out)
            at = stop
    except Broken as e:
        out.error = str(e)
    return out


def payload_of(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """A track's bytes, read from the packets' byte ranges."""
    return b"".join([data[at : at + n] for _, t, _, _, _, at, n in parsed.packets if t == track])


def features(payload: bytes, parsed: Parsed) -> str:
    """Packet and sample figures in a fixed order."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    laced = sum(p[4] != "none" for p in parsed.packets)
    end = max((p[2] for p in parsed.packets), default=0) // 1_000_000
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    mean = int(x.sum() * 1000 // max(len(x), 1))
    power = int((x * x).sum() * 1000 // max(len(x), 1))
    return (
        f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};laced={laced};"
        f"last_ms={end};mean={mean};power={power};crossings={crossings}"
    )


def to_payload(text: str | None, unit: int = PACKET) -> tuple[int, bytes]:
    """Bytes of a text, and these filled up with blanks to a positive multiple of unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media (its Matroska file)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [to_payload(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [n for n, _ in made], "media": [mux(p) for _, p in made]})

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInPandas(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, cluster, track, packet, timestamp_ns, keyframe, lacing, byte_offset, byte_size; error rows have no packet."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    columns = ["cluster", "track", "timestamp_ns", "keyframe", "lacing", "byte_offset", "byte_size"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, media in zip(pdf["id"], pdf["media"]):
                got = parse(media)
                rows = pd.DataFrame(got.packets, columns=columns)
                rows["packet"] = range(len(rows))
                rows["error"] = None
                if got.error:
                    rows.loc[len(rows), "error"] = got.error
                rows["id"] = i
                yield rows

    schema = (
        f"id {kind}, packet int, cluster int, track int, timestamp_ns long, keyframe boolean, lacing string,"
        " byte_offset long, byte_size long, error string"
    )
    picked = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return picked.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def read_back(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, media, the payload read through the packets' byte ranges, features of both, and error (null: none)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            payloads, told, errors = [], [], []
            for media in pdf["media"]:
                got = parse(media)
                payloads.append(None if got.error else payload_of(media, got))
                told.append(None if got.error else features(payloads[-1], got))
                errors.append(got.error)
            yield pdf.assign(payload=payloads, feature=told, error=errors)

    picked = df.select(F.col(id_col).alias("id"), "n_bytes", "media")
    schema = f"id {kind}, n_bytes long, media binary, payload binary, feature string, error string"
    return picked.mapInPandas(run, schema).withColumnRenamed("id", id_col)
