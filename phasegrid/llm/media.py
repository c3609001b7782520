"""Operator 8: Matroska columns.

`packets` turns a column of Matroska bytes into a packet table: track, cluster,
timestamp, byte range and cue of every frame, whatever its lacing (none, Xiph,
fixed, EBML), from SimpleBlocks and BlockGroups, with known or unknown sizes of
segments and clusters.  `mux` writes 8-bit PCM samples as such a file.

Cases: null bytes and bytes that aren't Matroska give one row with `error` set
and no packet; a file cut short gives the whole packets before the cut, then an
error row; empty files are errors; equal bytes give equal rows.
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

# Element numbers of the published EBML and Matroska formats.
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, TRACK_LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, BITS = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}

SAMPLE_RATE, FRAME, LACED, CLUSTER_FRAMES = 8000, 512, 8, 64


class Bad(ValueError):
    """The bytes break the format."""


# ---------------------------------------------------------------- writing


def vint(n: int, size: int = 0) -> bytes:
    """A size: 7 bits a byte behind a length marker; all ones is kept for 'unknown'."""
    while not size or n >= (1 << (7 * size)) - 1:
        size += 1
    return (n | 1 << (7 * size)).to_bytes(size, "big")


def element(number: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(number: int, n: int) -> bytes:
    return element(number, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(flag bits, bytes): none for one frame, fixed for equal sizes, else EBML."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x04, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        size, d = 1, b - a
        while abs(d) >= (1 << (7 * size - 1)) - 1:
            size += 1
        head += (d + (1 << (7 * size - 1)) - 1 | 1 << (7 * size)).to_bytes(size, "big")
    return 0x06, head + b"".join(frames)


def mux(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """One track of unsigned 8-bit PCM: laced SimpleBlocks in clusters, with cues."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    when = lambda k: k * FRAME * 1000 // rate  # noqa: E731  milliseconds
    head = element(EBML, uint(EBML_VERSION, 1), uint(EBML_READ, 1), uint(EBML_MAX_ID, 4), uint(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ, 2))
    info = element(INFO, uint(SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)), element(MUXER, b"phasegrid"), element(WRITER, b"phasegrid"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)), uint(CHANNELS, 1), uint(BITS, 8))
    tracks = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(TRACK_LACING, 1), element(CODEC, b"A_PCM/INT/LIT"), audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    for c in range(0, len(frames), CLUSTER_FRAMES):
        t0, blocks = when(c), []
        for k in range(c, min(c + CLUSTER_FRAMES, len(frames)), LACED):
            flag, data = lace(frames[k : min(k + LACED, c + CLUSTER_FRAMES)])
            blocks.append(element(SIMPLE_BLOCK, b"\x81", struct.pack(">hB", when(k) - t0, 0x80 | flag), data))
        cues.append((t0, at))
        clusters.append(element(CLUSTER, uint(CLUSTER_TIME, t0), *blocks))
        at += len(clusters[-1])
    index = element(CUES, *(element(CUE_POINT, uint(CUE_TIME, t), element(CUE_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER, p))) for t, p in cues))
    return head + element(SEGMENT, info, tracks, *clusters, index)


# ---------------------------------------------------------------- reading


class Packet(NamedTuple):
    track: int
    cluster: int
    block: int
    frame: int
    timestamp_ns: int
    start: int
    size: int
    keyframe: bool
    lacing: int


class Cue(NamedTuple):
    track: int
    timestamp_ns: int
    cluster_at: int


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[Cue]
    error: str | None


def read_vint(b: bytes, at: int, keep_marker: bool, widest: int = 8) -> tuple[int, int, bool]:
    """(value, next place, whether all value bits are one)."""
    if at >= len(b):
        raise Bad("cut short")
    first = b[at]
    size = 9 - first.bit_length()
    if size > widest or at + size > len(b):
        raise Bad("bad or cut variable-length integer")
    raw = int.from_bytes(b[at : at + size], "big")
    ones = (1 << (7 * size)) - 1
    return (raw if keep_marker else raw & ones), at + size, raw & ones == ones


def children(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int | None]]:
    """(element, start, end) of each; an unknown size has end None and the caller `send`s where it ended."""
    while at < end:
        number, p, _ = read_vint(b, at, True, 4)
        size, p, unknown = read_vint(b, p, False)
        if unknown:
            at = yield number, p, None
        else:
            if p + size > end:
                raise Bad(f"element {number:x} runs past its parent")
            yield number, p, p + size
            at = p + size


def unsigned(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


def floating(b: bytes, a: int, z: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", b[a:z])[0], 8: lambda: struct.unpack(">d", b[a:z])[0]}[z - a]()


def frame_ranges(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; lacing 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return [(at, end - at)]
    if at >= end:
        raise Bad("cut lacing head")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise Bad("fixed lacing doesn't divide")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if lacing == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Bad("cut lacing head")
                    size, at, more = size + b[at], at + 1, b[at] == 255
                    if not more:
                        break
            elif k == 0:
                size, at, _ = read_vint(b, at, False)
            else:
                before = at
                d, at, _ = read_vint(b, at, False)
                size = sizes[-1] + d - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise Bad("frames run past their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(b: bytes) -> Media:
    """Everything up to the first fault."""
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[Cue] = []
    state = {"scale": 1_000_000, "cluster": -1, "block": 0}

    def one_block(a: int, z: int, t0: int, simple: bool) -> None:
        track, p, _ = read_vint(b, a, False)
        if p + 3 > z:
            raise Bad("cut block head")
        delta, flags = struct.unpack(">hB", b[p : p + 3])
        lacing = flags >> 1 & 3
        ranges = frame_ranges(b, p + 3, z, lacing)
        step = tracks.get(track, {}).get("step_ns")
        for k, (start, size) in enumerate(ranges):
            t = (t0 + delta) * state["scale"]
            if k and step:  # raw samples have a size that gives each frame's time
                t += sum(s for _, s in ranges[:k]) * 1_000_000_000 // step
            packets.append(Packet(track, state["cluster"], state["block"], k, t, start, size, bool(flags & 0x80) if simple else True, lacing))
        state["block"] += 1

    def cluster(a: int, z: int | None) -> int:
        state["cluster"] += 1
        t0, at, end = 0, a, len(b) if z is None else z
        while at < end:
            number, p, _ = read_vint(b, at, True, 4)
            if z is None and number in TOP:
                break
            size, p, _ = read_vint(b, p, False)
            if p + size > end:
                raise Bad("cluster cut short")
            if number == CLUSTER_TIME:
                t0 = unsigned(b, p, p + size)
            elif number == SIMPLE_BLOCK:
                one_block(p, p + size, t0, True)
            elif number == BLOCK_GROUP:
                for n, x, y in children(b, p, p + size):
                    if n == BLOCK:
                        one_block(x, y, t0, False)
            at = p + size
        return at

    def track(a: int, z: int) -> None:
        t = {"codec": "", "type": 0, "rate": 0.0, "channels": 1, "bits": 0}
        number = 0
        for n, x, y in children(b, a, z):
            if n == TRACK_NUMBER:
                number = unsigned(b, x, y)
            elif n == TRACK_TYPE:
                t["type"] = unsigned(b, x, y)
            elif n == CODEC:
                t["codec"] = b[x:y].decode("ascii", "replace")
            elif n == AUDIO:
                for m, u, v in children(b, x, y):
                    if m == RATE:
                        t["rate"] = floating(b, u, v)
                    elif m in (CHANNELS, BITS):
                        t["channels" if m == CHANNELS else "bits"] = unsigned(b, u, v)
        if t["codec"].startswith("A_PCM") and t["rate"] and t["bits"]:
            t["step_ns"] = int(t["rate"] * t["channels"] * t["bits"]) // 8
        tracks[number] = t

    def cue(a: int, z: int, origin: int) -> None:
        t = 0
        for n, x, y in children(b, a, z):
            if n == CUE_TIME:
                t = unsigned(b, x, y) * state["scale"]
            elif n == CUE_POSITIONS:
                got = {m: unsigned(b, u, v) for m, u, v in children(b, x, y) if m in (CUE_TRACK, CUE_CLUSTER)}
                cues.append(Cue(got.get(CUE_TRACK, 0), t, origin + got.get(CUE_CLUSTER, 0)))

    try:
        if b[:4] != EBML.to_bytes(4, "big"):
            raise Bad("not EBML")
        size, p, _ = read_vint(b, 4, False)
        if not any(n == DOC_TYPE and b[x:y] in (b"matroska", b"webm") for n, x, y in children(b, p, p + size)):
            raise Bad("not Matroska")
        at = p + size
        number, p, _ = read_vint(b, at, True, 4)
        if number != SEGMENT:
            raise Bad("no segment")
        size, origin, unknown = read_vint(b, p, False)
        end = len(b) if unknown else origin + size
        short, end, at = end > len(b), min(end, len(b)), origin
        while at < end:
            number, p, _ = read_vint(b, at, True, 4)
            size, p, unknown = read_vint(b, p, False)
            z = None if unknown else p + size
            if number == CLUSTER:
                at = cluster(p, None if unknown else min(p + size, len(b)))
                if not unknown and z > len(b):
                    raise Bad("cluster cut short")
                continue
            if z is None or z > end:
                raise Bad("element cut short")
            if number == INFO:
                for n, x, y in children(b, p, z):
                    if n == SCALE:
                        state["scale"] = unsigned(b, x, y)
            elif number == TRACKS:
                for n, x, y in children(b, p, z):
                    if n == TRACK:
                        track(x, y)
            elif number == CUES:
                for n, x, y in children(b, p, z):
                    if n == CUE_POINT:
                        cue(x, y, origin)
            at = z
        if short:
            raise Bad("segment cut short")
        error = None
    except Bad as e:
        error = str(e)
    except (IndexError, KeyError, struct.error) as e:
        error = f"damaged: {type(e).__name__}"
    return Media(tracks, packets, cues, error)


PACKETS = "id long, track int, cluster int, block int, frame int, timestamp_ns long, start long, size long, keyframe boolean, lacing int, codec string, cue boolean, error string"


def packets(df: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """The packet table of a binary column; `cue` marks the first packet of a cued cluster and time."""
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def run(batches):
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = parse(raw.as_py() or b"")
                cued = {(c.track, c.timestamp_ns) for c in m.cues}
                rows = [(k, *p[:9], m.tracks.get(p.track, {}).get("codec"), (p.track, p.timestamp_ns) in cued, None) for p in m.packets]
                if m.error:
                    rows.append((k, *[None] * 11, m.error))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return df.select(F.col(key).cast("long"), F.col(content).cast("binary")).mapInArrow(run, PACKETS)


def features(payload: bytes, media: Media) -> str:
    """A few figures of the samples and the packets, as text; all are of the whole payload, peak is its strongest frequency's number."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    spectrum = np.abs(np.fft.rfft(x))[1:]
    peak = int(spectrum.argmax()) + 1 if len(spectrum) else 0
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    clusters = len({p.cluster for p in media.packets})
    last = media.packets[-1].timestamp_ns // 1_000_000 if media.packets else 0
    return f"packets={len(media.packets)};clusters={clusters};cues={len(media.cues)};last_ms={last};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};peak={peak}"


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text as 8-bit samples in a Matroska file, read back by its packets."""
    names = [x.split()[0] for x in STORED.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (t.as_py() or "").encode()
                n = max(64, -(-len(data) // 64) * 64)
                file = mux(data.ljust(n, b"\0"))
                m = parse(file)
                if m.error:
                    raise Bad(m.error)
                back = b"".join([file[p.start : p.start + p.size] for p in m.packets])
                rows.append((k, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), features(back, m)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, STORED)
