"""Matroska media columns: EBML elements to tables of packets and cues, and back.

``read`` walks variable-length EBML elements, clusters, all four kinds of lacing and cues,
and gives packets with track, timestamp, place (byte range in the file) and flags.
``write`` stores bytes as 8-bit mono PCM, 64 samples a millisecond, in laced blocks.

Defined cases: null media is an error row ("null"); malformed or cut-off media give the
packets before the fault and its message; elements of unknown size end at the next element
that cannot be inside; unknown elements are skipped; an empty table gives no rows; extra
columns are ignored.  Null text is stored as empty text (64 zero bytes).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import columns, map_rows

# Element ids of the public Matroska specification.
EBML, DOC_TYPE, SEGMENT = 0x1A45DFA3, 0x4282, 0x18538067
INFO, TIMESTAMP_SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO = 0x9C, 0x86, 0x23E383, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK = 0x1F43B675, 0xE7, 0xA3
BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS = 0x1C53BB6B, 0xBB, 0xB3, 0xB7
CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xF7, 0xF1, 0xF0
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
#: What ends a segment of unknown size.
CHAINED = {EBML, SEGMENT}
TOP_LEVEL |= CHAINED
LACING = {0: "none", 1: "xiph", 2: "fixed", 3: "ebml"}

FRAME, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER, SAMPLES_A_MS = 1024, 8, 64, 64


class Malformed(ValueError):
    pass


# ---------------------------------------------------------------- reading


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next position, and whether all its bits are ones (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"cut off inside an integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bits = (1 << 7 * width) - 1
    return (value if keep_marker else value & bits), at + width, value & bits == bits


@dataclass
class Movie:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, offset, size, key frame, lacing, cluster's place in the file)
    packets: list[tuple] = field(default_factory=list)
    #: (time in ns, track, cluster's place in the file)
    cues: list[tuple] = field(default_factory=list)
    clusters: int = 0
    error: str | None = None


def elements(data: bytes, at: int, end: int, inside: set[int] | None = None):
    """(id, body start, body end, whether the size is unknown, start) of each element;
    ``inside`` ends a parent of unknown size.  Whoever reads an element of unknown size sends
    back where it ended."""
    while at < end:
        start = at
        id_, at, _ = vint(data, at, True)
        if inside is not None and id_ in inside:
            return
        size, at, unknown = vint(data, at, False)
        if not unknown and at + size > end:
            raise Malformed(f"element {id_:X} at {start} ends after its parent")
        stop = end if unknown else at + size
        last = yield id_, at, stop, unknown, start
        at = last if unknown and last is not None else stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first one begins."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise Malformed("cut off lacing")
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise Malformed("frames of fixed lacing do not fill the block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while at < end:
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
        else:
            value, after, _ = vint(data, at, False)
            # all but the first are signed differences from the size before
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laced frames are larger than the block")
    return sizes, at


def read(data: bytes | None) -> Movie:
    movie = Movie()
    if data is None:
        movie.error = "null"
        return movie
    try:
        seen = False
        walk, send = elements(data, 0, len(data)), None
        while (found := _next(walk, send)) is not None:
            id_, a, b, unknown, _ = found
            send = None
            if id_ == EBML:
                for k, x, y, *_ in elements(data, a, b):
                    if k == DOC_TYPE:
                        movie.doc_type = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif id_ == SEGMENT:
                seen = True
                end = _segment(data, a, b, unknown, movie)
                send = end if unknown else None
        if not seen:
            raise Malformed("no segment")
    except Malformed as e:
        movie.error = str(e)
    return movie


def _next(walk, send):
    try:
        return walk.send(send)
    except StopIteration:
        return None


def _segment(data: bytes, a: int, b: int, unknown: bool, movie: Movie) -> int:
    """Read a segment and say where it ends; one of unknown size ends where the next begins."""
    movie.tracks, movie.scale = {}, 1_000_000
    walk, send, last = elements(data, a, b, CHAINED if unknown else None), None, a
    while (found := _next(walk, send)) is not None:
        id_, x, y, open_, start = found
        send, last = None, y
        if id_ == INFO:
            for k, p, q, *_ in elements(data, x, y):
                if k == TIMESTAMP_SCALE:
                    movie.scale = _uint(data, p, q)
                elif k == DURATION:
                    movie.duration = _float(data, p, q)
        elif id_ == TRACKS:
            for k, p, q, *_ in elements(data, x, y):
                if k == TRACK_ENTRY:
                    _track(data, p, q, movie)
        elif id_ == CLUSTER:
            end = _cluster(data, x, y, open_, movie, start)
            send, last = (end, end) if open_ else (None, y)
        elif id_ == CUES:
            for k, p, q, *_ in elements(data, x, y):
                if k == CUE_POINT:
                    _cue(data, p, q, movie, a)
    return last


def _track(data: bytes, a: int, b: int, movie: Movie) -> None:
    t = {"type": 0, "codec": "", "default_duration": 0, "rate": 0.0, "channels": 1, "bits": 0}
    number = 0
    for k, p, q, *_ in elements(data, a, b):
        if k == TRACK_NUMBER:
            number = _uint(data, p, q)
        elif k == TRACK_TYPE:
            t["type"] = _uint(data, p, q)
        elif k == CODEC_ID:
            t["codec"] = data[p:q].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            t["default_duration"] = _uint(data, p, q)
        elif k == AUDIO:
            for j, r, s, *_ in elements(data, p, q):
                if j == SAMPLING_FREQUENCY:
                    t["rate"] = _float(data, r, s)
                elif j == CHANNELS:
                    t["channels"] = _uint(data, r, s)
                elif j == BIT_DEPTH:
                    t["bits"] = _uint(data, r, s)
    movie.tracks[number] = t


def _cluster(data: bytes, a: int, b: int, unknown: bool, movie: Movie, place: int) -> int:
    movie.clusters += 1
    time, end = 0, a
    for k, p, q, *_ in elements(data, a, b, TOP_LEVEL if unknown else None):
        end = q
        if k == CLUSTER_TIMESTAMP:
            time = _uint(data, p, q)
        elif k == SIMPLE_BLOCK:
            _block(data, p, q, time, movie, place, None)
        elif k == BLOCK_GROUP:
            parts = {j: (r, s) for j, r, s, *_ in elements(data, p, q)}
            if BLOCK in parts:
                _block(data, *parts[BLOCK], time, movie, place, REFERENCE_BLOCK not in parts)
    return end


def _block(data: bytes, a: int, b: int, time: int, movie: Movie, place: int, key: bool | None) -> None:
    track, at, _ = vint(data, a, False)
    if at + 3 > b:
        raise Malformed(f"cut off block at {a}")
    (relative,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
    kind = flags >> 1 & 3
    sizes, at = frame_sizes(data, at + 3, b, kind)
    start = (time + relative) * movie.scale
    step = movie.tracks.get(track, {}).get("default_duration", 0)
    for i, size in enumerate(sizes):
        movie.packets.append((track, start + i * step, at, size, bool(flags & 0x80) if key is None else key, LACING[kind], place))
        at += size


def _cue(data: bytes, a: int, b: int, movie: Movie, base: int) -> None:
    time, where = 0, []
    for k, p, q, *_ in elements(data, a, b):
        if k == CUE_TIME:
            time = _uint(data, p, q) * movie.scale
        elif k == CUE_POSITIONS:
            found = {j: _uint(data, r, s) for j, r, s, *_ in elements(data, p, q)}
            where.append((found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
    movie.cues += [(time, track, place) for track, place in where]


# ---------------------------------------------------------------- writing


def size_vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def uint(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and the block's body after its flags, for one of the four kinds."""
    if kind == "none":
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if kind == "fixed":
        return 4, head + b"".join(frames)
    if kind == "xiph":
        return 2, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    marks = size_vint(sizes[0]) if len(sizes) > 1 else b""
    for before, n in zip(sizes, sizes[1:-1]):
        d = n - before
        width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
        marks += size_vint(d + (1 << 7 * width - 1) - 1, width)
    return 6, head + marks + b"".join(frames)


def simple_block(relative: int, frames: list[bytes], kind: str, track: int = 1) -> bytes:
    flags, body = lace(frames, kind)
    return element(SIMPLE_BLOCK, size_vint(track) + struct.pack(">hB", relative, 0x80 | flags) + body)


_FRAME_MS = FRAME // SAMPLES_A_MS
_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACK = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, _FRAME_MS * 1_000_000) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLES_A_MS * 1000.0)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A file that holds ``payload``, a positive multiple of 64 bytes, as its samples."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / SAMPLES_A_MS)) + element(0x4D80, b"ripplework") + element(0x5741, b"ripplework"))
    parts, cues, place = [info, _TRACK], [], len(info) + len(_TRACK)
    in_block, in_cluster = FRAME * FRAMES_IN_BLOCK, FRAME * FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for c in range(0, len(payload), in_cluster):
        body = [uint(CLUSTER_TIMESTAMP, c // SAMPLES_A_MS)]
        stop = min(c + in_cluster, len(payload))
        for b in range(c, stop, in_block):
            frames = [payload[f : min(f + FRAME, stop)] for f in range(b, min(b + in_block, stop), FRAME)]
            kind = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else "ebml"
            body.append(simple_block((b - c) // SAMPLES_A_MS, frames, kind))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c // SAMPLES_A_MS) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, place))))
        place += len(cluster)
        parts.append(cluster)
    return _HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def pad(raw: bytes, to: int = 64) -> bytes:
    return raw + bytes(max(to, -(-len(raw) // to) * to) - len(raw))


def samples(data: bytes, movie: Movie) -> bytes:
    return b"".join(data[at : at + n] for _, _, at, n, *_ in movie.packets)


def features(movie: Movie, payload: bytes) -> str:
    """Counts of the container and statistics of the samples, as one string."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    rises = int((x[1:] > x[:-1]).sum())
    ms = movie.packets[-1][1] // 1_000_000 if movie.packets else 0
    return f"packets={len(movie.packets)};clusters={movie.clusters};cues={len(movie.cues)};last_ms={ms};sum={total};squares={squares};peak={int(x.max(initial=0))};rises={rises}"


# ---------------------------------------------------------------- operators


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each packet of each file (and one with ``error`` where reading ends early)."""
    names = ("track", "timestamp_ns", "start", "size", "key_frame", "lacing", "cluster")

    def make():
        def step(x: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("media_id", "packet", *names, "error")}
            for id_, data in zip(x[id_col], x[media_col]):
                movie = read(data)
                rows = [*movie.packets, *([(None,) * 7] if movie.error else [])]
                for k, row in enumerate(rows):
                    out["media_id"].append(id_)
                    out["packet"].append(k if row[0] is not None else None)
                    out["error"].append(movie.error if row[0] is None else None)
                    for c, v in zip(names, row):
                        out[c].append(v)
            return out

        return step

    schema = "media_id long, packet int, track int, timestamp_ns long, start long, size long, key_frame boolean, lacing string, cluster long, error string"
    return map_rows(columns(df, id_col, media_col), make, schema)


def cue_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    def make():
        def step(x: dict) -> dict:
            rows = [(i, *cue) for i, data in zip(x[id_col], x[media_col]) for cue in read(data).cues]
            return {c: [r[k] for r in rows] for k, c in enumerate(("media_id", "time_ns", "track", "cluster"))}

        return step

    return map_rows(columns(df, id_col, media_col), make, "media_id long, time_ns long, track int, cluster long")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's UTF-8 bytes, padded, as a Matroska file."""

    def make():
        return lambda x: {"doc_id": x["doc_id"], "media": [write(pad((t or "").encode())) for t in x["text"]]}

    return map_rows(columns(docs, "doc_id", "text"), make, "doc_id long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back and describe what came back.

    One map without a shuffle: writing and reading meet in the same task, so the media bytes
    never leave it.
    """

    def make():
        def step(x: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in x["text"]:
                raw = (text or "").encode()
                media = write(pad(raw))
                movie = read(media)
                back = samples(media, movie)
                if movie.error or len(back) < len(raw):
                    raise Malformed(movie.error or "samples are missing")
                for c, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(movie, back))):
                    out[c].append(v)
            return {"doc_id": x["doc_id"], **out}

        return step

    return map_rows(
        columns(docs, "doc_id", "text"),
        make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
