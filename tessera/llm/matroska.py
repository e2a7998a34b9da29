"""Matroska: write 8-bit PCM tracks and parse files into packet tables.

The parser reads variable-length EBML elements, segments and clusters of known or unknown size, simple blocks and block
groups, all four kinds of lacing, and cues. A packet is one frame: its track, timestamp, byte range in the file, and the
block and cluster that it is in.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, LACING_FLAG = 0x23E383, 0x9C
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
#: Elements that end a cluster of unknown size.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACES = ("none", "xiph", "fixed", "ebml")

FRAME = 192
SAMPLE_RATE = 19200  # so that a frame lasts 10 ms
FRAMES_A_BLOCK, FRAMES_A_CLUSTER = 8, 128


class MatroskaError(ValueError):
    """The bytes aren't a file that the parser can read."""


# ---- writing -----------------------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size; the shortest form unless a width is given."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and body of a block's frames."""
    if kind == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("several frames need lacing")
        return 0, frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == "fixed":
        if len(set(sizes)) != 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, head + b"".join(frames)
    if kind == "xiph":
        return 0x02, head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + b"".join(frames)
    out = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
        out.append(vint(b - a + (1 << 7 * width - 1) - 1, width))
    return 0x06, head + b"".join(out) + b"".join(frames)


_PREAMBLE = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, 10_000_000)
        + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8)),
    ),
)


def write_pcm(payload: bytes, lacing: str = "fixed") -> bytes:
    """A file with one mono 8-bit track; the payload's length is a multiple of FRAME."""
    if len(payload) % FRAME:
        raise ValueError(f"the payload must be a multiple of {FRAME} bytes")
    n = len(payload) // FRAME
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"pcm") + element(WRITER, b"pcm") + element(DURATION, struct.pack(">d", 10.0 * n)))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for c in range(0, n, FRAMES_A_CLUSTER):
        body = [number(CLUSTER_TIME, 10 * c)]
        for b in range(c, min(c + FRAMES_A_CLUSTER, n), FRAMES_A_BLOCK):
            to = min(b + FRAMES_A_BLOCK, c + FRAMES_A_CLUSTER, n)
            if lacing == "fixed" and to - b > 1:
                flags, laced = 0x04, bytes([to - b - 1]) + payload[b * FRAME : to * FRAME]
            else:
                flags, laced = lace([payload[k * FRAME : (k + 1) * FRAME] for k in range(b, to)], lacing)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 10 * (b - c), 0x80 | flags) + laced))
        cues.append(element(CUE_POINT, number(CUE_TIME, 10 * c) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return _PREAMBLE + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# ---- parsing -----------------------------------------------------------------------------------------------------


@dataclass
class Media:
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time ns, track, byte of the cluster
    #: track, timestamp ns, first byte, bytes, block, cluster, keyframe, lacing
    packets: list[tuple[int, int, int, int, int, int, bool, str]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # byte of each
    scale: int = 1_000_000
    duration_ns: int | None = None


def _ident(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or data[at] < 0x10:
        raise MatroskaError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, None if unknown, and where it ends."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"a size is cut at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _children(data: bytes, at: int, end: int, stop: set[int] | None = None):
    """(id, body start, body end, start) of the elements in data[at:end]; with ``stop``, up to one of these ids."""
    while at < end:
        ident, body = _ident(data, at)
        if stop and ident in stop:
            return
        size, body = _size(data, body)
        if size is None:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"element {ident:x} at byte {at} has no size")
            to = end
            if ident == CLUSTER:
                to = body
                for _, _, to, _ in _children(data, body, end, _TOP):
                    pass
        else:
            to = body + size
        if to > end:
            raise MatroskaError(f"element {ident:x} at byte {at} goes beyond byte {end}")
        yield ident, body, to, at
        at = to


def _uint(data: bytes, at: int, to: int) -> int:
    return int.from_bytes(data[at:to], "big")


def _int64(n: float, what: str) -> int:
    """n rounded, if it is a number that a column of long can hold."""
    if isinstance(n, float) and not math.isfinite(n) or not -(1 << 63) <= round(n) < 1 << 63:
        raise MatroskaError(f"{what} is no 64-bit number")
    return round(n)


def _named(data: bytes, at: int, to: int) -> dict[int, tuple[int, int]]:
    """Body start and end of the last element of each id."""
    return {i: (a, t) for i, a, t, _ in _children(data, at, to)}


def _float(data: bytes, at: int, to: int) -> float:
    return struct.unpack(">f" if to - at == 4 else ">d", data[at:to])[0] if to - at in (4, 8) else 0.0


def _frames(data: bytes, at: int, to: int, kind: int) -> list[tuple[int, int]]:
    """First byte and bytes of a block's frames."""
    if kind == 0:
        return [(at, to - at)]
    if at >= to:
        raise MatroskaError("a lace has no count")
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (to - at) % n:
            raise MatroskaError("fixed lacing of unequal frames")
        return [(at + k * ((to - at) // n), (to - at) // n) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= to:
                    raise MatroskaError("a lace is cut")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            if at >= to or not data[at]:
                raise MatroskaError("a lace is cut")
            width = 9 - data[at].bit_length()
            value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
            at += width
        sizes.append(size)
    sizes.append(to - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Everything that the tables hold. Bytes that aren't a readable file raise MatroskaError and nothing else."""
    media = Media()
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MatroskaError("no EBML header")
    for ident, at, to, _ in top:
        if ident == SEGMENT:
            _segment(media, data, at, to)
    return media


def _segment(media: Media, data: bytes, base: int, end: int) -> None:
    defaults: dict[int, int] = {}
    for ident, at, to, start in _children(data, base, end):
        if ident == INFO:
            found = _named(data, at, to)
            media.scale = _uint(data, *found[TIMESTAMP_SCALE]) if TIMESTAMP_SCALE in found else 1_000_000
            if DURATION in found:
                media.duration_ns = _int64(_float(data, *found[DURATION]) * _int64(media.scale, "the timestamp scale"), "the duration")
        elif ident == TRACKS:
            for _, a, t, _ in (x for x in _children(data, at, to) if x[0] == TRACK_ENTRY):
                got = _named(data, a, t)
                audio = _named(data, *got[AUDIO]) if AUDIO in got else {}
                track = {"number": _uint(data, *got[TRACK_NUMBER]) if TRACK_NUMBER in got else 0, "type": _uint(data, *got[TRACK_TYPE]) if TRACK_TYPE in got else 0}
                track["codec"] = data[slice(*got[CODEC])].decode("ascii", "replace") if CODEC in got else ""
                track["rate"] = _float(data, *audio[RATE]) if RATE in audio else None
                track["depth"] = _uint(data, *audio[DEPTH]) if DEPTH in audio else None
                media.tracks.append(track)
                if DEFAULT_DURATION in got:
                    defaults[track["number"]] = _uint(data, *got[DEFAULT_DURATION])
        elif ident == CUES:
            for _, a, t, _ in (x for x in _children(data, at, to) if x[0] == CUE_POINT):
                time, places = 0, []
                for i, x, y, _ in _children(data, a, t):
                    if i == CUE_TIME:
                        time = _uint(data, x, y)
                    elif i == CUE_POSITIONS:
                        got = {i: _uint(data, *place) for i, place in _named(data, x, y).items()}
                        places.append((_track(got.get(CUE_TRACK, 0)), _int64(base + got.get(CUE_CLUSTER, 0), "a cue's position")))
                media.cues += [(_int64(time * media.scale, "a cue's time"), track, place) for track, place in places]
        elif ident == CLUSTER:
            media.clusters.append(start)
            _cluster(media, data, at, to, defaults)


def _track(n: int | None) -> int:
    if n is None or n >= 1 << 31:
        raise MatroskaError("a track's number is too large")
    return n


def _cluster(media: Media, data: bytes, start: int, end: int, defaults: dict[int, int]) -> None:
    time = 0
    cluster, block = len(media.clusters) - 1, media.packets[-1][4] + 1 if media.packets else 0
    for ident, at, to, _ in _children(data, start, end):
        key = True
        if ident == CLUSTER_TIME:
            time = _uint(data, at, to)
            continue
        if ident == BLOCK_GROUP:
            inside = _named(data, at, to)
            if BLOCK not in inside:
                continue
            (at, to), key = inside[BLOCK], REFERENCE not in inside
        elif ident != SIMPLE_BLOCK:
            continue
        track, at = _size(data, at)
        track = _track(track)
        if at + 3 > to:
            raise MatroskaError("a block is cut")
        relative, flags = struct.unpack_from(">hB", data, at)
        kind = flags >> 1 & 3
        frames = _frames(data, at + 3, to, kind)
        first, step = (time + relative) * media.scale, defaults.get(track, 0)
        for n in (first, first + (len(frames) - 1) * step):
            _int64(n, "a timestamp")
        for k, (a, n) in enumerate(frames):
            media.packets.append((track, first + k * step, a, n, block, cluster, key if ident == BLOCK_GROUP else bool(flags & 0x80), LACES[kind]))
        block += 1


def cue_rows(media: Media) -> list[tuple[int, int, int, int | None, int | None]]:
    """time ns, track, byte of the cluster, and the number of that cluster and of its first packet of the track at or
    after the time, counted over the file; None where the cue points to no cluster, or to none with such a packet."""
    number = {at: k for k, at in enumerate(media.clusters)}
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    aimed = {(number.get(place), track) for _, track, place in media.cues}
    for k, (track, time, _, _, _, cluster, *_) in enumerate(media.packets):
        if (cluster, track) in aimed:
            wanted.setdefault((cluster, track), []).append((time, k))
    out = []
    for time, track, place in media.cues:
        cluster = number.get(place)
        packet = min((k for t, k in wanted.get((cluster, track), ()) if t >= time), default=None)
        out.append((time, track, place, cluster, packet))
    return out


# ---- columns -----------------------------------------------------------------------------------------------------

PACKETS = "track int, timestamp_ns long, first_byte long, n_bytes long, block int, cluster int, keyframe boolean, lacing string"
CUE_ROWS = "time_ns long, track int, cluster_byte long, cluster int, packet long"


def store_text(text: str | None) -> bytes:
    """A text as PCM samples: its UTF-8 bytes, blanks up to a positive multiple of FRAME, in a file."""
    raw = (text or "").encode()
    return write_pcm(raw + b" " * (-len(raw) % FRAME if raw else FRAME))


def store_texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8 and its media file, for each row of docs (more columns are ignored).

    Null text is taken as empty, a null doc_id stays null, repeated rows are repeated, an empty table gives an empty one.
    """

    def run(it):
        for batch in slices(it):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(store_text, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), f"`{column}`").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _table(media: DataFrame, column: str, name: str, fields: str, rows_of: Callable[[Media], list[tuple]]) -> DataFrame:
    """One row for each of a file's rows, as the struct ``name``, beside the other columns and ``error``."""
    rest = [c for c in media.columns if c not in (column, name, "error")]
    source = media.select([f"`{c}`" for c in [*rest, column]])
    row_type = StructType.fromDDL(fields)
    kind, names = to_arrow_type(row_type), row_type.names
    out = StructType([*source.schema.fields[:-1], StructField(name, row_type), StructField("error", StringType())])

    def run(it):
        for batch in slices(it):
            at, found, errors = [], [], []
            for k, data in enumerate(batch.column(len(rest))):
                if not data.is_valid:
                    continue
                try:
                    own, error = [dict(zip(names, x)) for x in rows_of(parse(data.as_py()))], None
                except MatroskaError as e:
                    own, error = [None], str(e)
                at += [k] * len(own)
                found += own
                errors += [error] * len(own)
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind), pa.array(errors, pa.string())], names=[*rest, name, "error"])

    return source.mapInArrow(run, out)


def packet_table(media: DataFrame, column: str = "media") -> DataFrame:
    """Replace a binary column by ``packet`` (one row for each packet) and ``error``.

    A file that can't be parsed gives one row with a null packet and the reason; null or a file without packets gives no
    row, an empty table none. Other columns are repeated for each packet, but for those named packet or error, which are
    replaced. Repeated rows are repeated.
    """
    return _table(media, column, "packet", PACKETS, lambda found: found.packets)


def cue_table(media: DataFrame, column: str = "media") -> DataFrame:
    """As packet_table(), with ``cue``: one row for each position of a cue point, and the packet it leads to."""
    return _table(media, column, "cue", CUE_ROWS, cue_rows)


def feature(media: Media, payload: bytes) -> str:
    """Counts of the packet table, its checksum, and whole-number features of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    table = zlib.crc32(np.array([p[:6] for p in media.packets], np.int64).tobytes())
    cues = zlib.crc32(np.array([[-1 if v is None else v for v in c] for c in cue_rows(media)], np.int64).tobytes())
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};duration_ns={media.duration_ns};"
        f"table={table:08x};cue_table={cues:08x};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(np.diff(x >= 128))};peak={x.max(initial=0)}"
    )


def read_media(stored: DataFrame) -> DataFrame:
    """The digests of op2 from stored files (doc_id, n_bytes, media): every value comes from parsing the file.

    Null media gives nulls. A file that can't be parsed has its size and digest, no payload, and the reason as feature.
    Repeated rows are repeated, an empty table gives an empty one.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digests(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            media = parse(data)
        except MatroskaError as e:
            return None, None, None, len(data), sha256(data).hexdigest(), f"error={e}"
        payload = b"".join(data[a : a + n] for _, _, a, n, *_ in media.packets)
        return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), sha256(data).hexdigest(), feature(media, payload)

    def run(it):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(it):
            columns = list(zip(*map(digests, batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
