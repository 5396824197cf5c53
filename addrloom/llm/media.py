"""ISO media containers in a binary column.

``parse`` walks the nested boxes of a container and decodes its sample tables
into codec, duration, sample byte ranges and key frames; the runs of fragmented
files (``moof``) add theirs. It reads box headers and tables only, never the samples. ``encode_frames`` stores bytes losslessly as raw
8-bit gray video, 64 samples to a line and up to 64 lines to a frame, every frame
a key frame; ``payload`` reads the stored samples back through the tables.
"""

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

from . import textkit

#: Boxes that hold boxes, and the bytes before their children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
LINE, FRAME_LINES, TIMESCALE, TICKS = 64, 64, 1000, 40


class BrokenMedia(ValueError):
    """The bytes are no well-formed container."""


@dataclass
class Track:
    number: int = 0
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def boxes(raw: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, byte after it) of the boxes side by side in raw[start:end]."""
    while start < end:
        if end - start < 8:
            raise BrokenMedia(f"{end - start} bytes are left at {start}")
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise BrokenMedia(f"no room for a large size at {start}")
            size = struct.unpack_from(">Q", raw, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size < body or start + size > end:
            raise BrokenMedia(f"box {kind!r} at {start} has the size {size}")
        yield kind, body, start + size
        start += size


def _numbers(raw: memoryview, body: int, end: int, kind: str, per: int = 1) -> np.ndarray:
    """The entries of a full box with a count."""
    if end - body < 8:
        raise BrokenMedia("a table has no count")
    count, width = struct.unpack_from(">I", raw, body + 4)[0] * per, np.dtype(kind).itemsize
    if end - body - 8 < count * width:
        raise BrokenMedia("a table is cut off")
    return np.frombuffer(raw, kind, count, body + 8).astype(np.int64).reshape(-1, per)


def _tables(raw: memoryview, start: int, end: int, track: Track, found: dict[bytes, tuple[int, int]]) -> None:
    for kind, body, stop in boxes(raw, start, end):
        if kind in CONTAINERS:
            _tables(raw, body + CONTAINERS[kind], stop, track, found)
        else:
            found.setdefault(kind, (body, stop))


def _track(raw: memoryview, start: int, end: int) -> Track:
    track, at = Track(), {}
    _tables(raw, start, end, track, at)
    try:
        if b"tkhd" in at:
            body, _ = at[b"tkhd"]
            track.number = struct.unpack_from(">I", raw, body + (20 if raw[body] else 12))[0]
        if b"mdhd" in at:
            body, _ = at[b"mdhd"]
            track.timescale, track.duration = struct.unpack_from(">IQ" if raw[body] else ">II", raw, body + (20 if raw[body] else 12))
        if b"hdlr" in at:
            track.kind = bytes(raw[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1")
        if b"stsd" in at:
            body, stop = at[b"stsd"]
            for codec, entry, _ in boxes(raw, body + 8, stop):
                track.codec = codec.decode("latin-1")
                if track.kind == "vide" and stop - entry >= 28:
                    track.width, track.height = struct.unpack_from(">HH", raw, entry + 24)
                break
    except struct.error as e:
        raise BrokenMedia(str(e)) from None
    if b"stsz" not in at and b"stz2" not in at:
        return track
    if b"stsz" in at:
        body, stop = at[b"stsz"]
        if stop - body < 12:
            raise BrokenMedia("the size table is cut off")
        same, count = struct.unpack_from(">II", raw, body + 4)
        if same:
            # Samples of one size have no table, so their number is held against the file's length.
            if same * count > len(raw):
                raise BrokenMedia("the samples reach past the end")
            track.sizes = np.full(count, same, np.int64)
        else:
            track.sizes = _numbers(raw, body + 4, stop, ">u4").ravel()
    else:
        body, stop = at[b"stz2"]
        width, count = raw[body + 7], struct.unpack_from(">I", raw, body + 8)[0]
        packed = np.frombuffer(raw, np.uint8, stop - body - 12, body + 12)
        values = np.stack((packed >> 4, packed & 15), 1).ravel() if width == 4 else packed if width == 8 else packed[: len(packed) // 2 * 2].view(">u2")
        if len(values) < count:
            raise BrokenMedia("the size table is cut off")
        track.sizes = values[:count].astype(np.int64)
    n = len(track.sizes)
    if b"stco" in at or b"co64" in at:
        chunk = _numbers(raw, *at[b"co64" if b"co64" in at else b"stco"], ">u8" if b"co64" in at else ">u4").ravel()
        runs = _numbers(raw, *at[b"stsc"], ">u4", 3) if b"stsc" in at else np.zeros((0, 3), np.int64)
        if n and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
            raise BrokenMedia("the chunk runs don't start at 1 and grow")
        if n:
            last = np.clip(np.append(runs[1:, 0], len(chunk) + 1), None, len(chunk) + 1)
            held = np.repeat(runs[:, 1], np.maximum(last - np.minimum(runs[:, 0], len(chunk) + 1), 0))
            if int(held.sum()) != n:
                raise BrokenMedia(f"chunks hold {int(held.sum())} samples of {n}")
            begin = np.cumsum(track.sizes) - track.sizes
            first = np.cumsum(held) - held
            full = held > 0
            track.starts = np.repeat(chunk[: len(held)][full] - begin[first[full]], held[full]) + begin
    if b"stts" in at:
        steps = _numbers(raw, *at[b"stts"], ">u4", 2)
        if int(steps[:, 0].sum()) != n:
            raise BrokenMedia("the time table has another number of samples")
        ticks = np.repeat(steps[:, 1], steps[:, 0])
        track.times = np.cumsum(ticks) - ticks
    track.keys = _numbers(raw, *at[b"stss"], ">u4").ravel() - 1 if b"stss" in at else np.arange(n)
    if len(track.keys) and (track.keys.min() < 0 or track.keys.max() >= n):
        raise BrokenMedia("a key frame is no sample")
    if len(track.starts) and (track.starts.min() < 0 or int((track.starts + track.sizes).max()) > len(raw)):
        raise BrokenMedia("a sample lies outside the file")
    return track


def _runs_of(raw: memoryview, begin: int, body: int, end: int, tracks: dict[int, Track], usual: dict[int, tuple[int, int, int]]) -> None:
    """Add the samples of a fragment, which starts at ``begin``; ``usual`` has a track's duration, size and flags of a sample."""
    after = begin
    for kind, b, e in boxes(raw, body, end):
        if kind != b"traf":
            continue
        parts = list(boxes(raw, b, e))
        head = next((x for x in parts if x[0] == b"tfhd"), None)
        if head is None:
            raise BrokenMedia("a fragment of no track")
        flags, number = struct.unpack_from(">II", raw, head[1])
        flags &= 0xFFFFFF
        if (track := tracks.get(number)) is None:
            raise BrokenMedia(f"a fragment of track {number}, which is not there")
        at, base, own = head[1] + 8, begin if flags & 0x20000 else after, list(usual.get(number, (0, 0, 0)))
        if flags & 1:
            base = struct.unpack_from(">Q", raw, at)[0]
            at += 8
        at += 4 * bool(flags & 2)
        for k, bit in enumerate((8, 0x10, 0x20)):
            if flags & bit:
                own[k] = struct.unpack_from(">I", raw, at)[0]
                at += 4
        clock = next((x for x in parts if x[0] == b"tfdt"), None)
        time = track.duration if clock is None else struct.unpack_from(">Q" if raw[clock[1]] else ">I", raw, clock[1] + 4)[0]
        after = base
        for _, r, stop in (x for x in parts if x[0] == b"trun"):
            flags, count = struct.unpack_from(">II", raw, r)
            flags &= 0xFFFFFF
            at, first = r + 8, None
            if flags & 1:
                after = base + struct.unpack_from(">i", raw, at)[0]
                at += 4
            if flags & 4:
                first = struct.unpack_from(">I", raw, at)[0]
                at += 4
            there = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
            if stop - at < 4 * sum(there) * count or (not there[1] and own[1] * count > len(raw)):
                raise BrokenMedia("a run is cut off")
            table = np.frombuffer(raw, ">u4", sum(there) * count, at).astype(np.int64).reshape(count, -1)
            column = lambda k: table[:, sum(there[:k])] if there[k] else np.full(count, own[k], np.int64)  # noqa: B023, E731
            steps, sizes, marks = column(0), column(1), column(2).copy()
            if count and first is not None:
                marks[0] = first
            starts = after + np.cumsum(sizes) - sizes
            after += int(sizes.sum())
            if count and (starts.min() < 0 or after > len(raw)):
                raise BrokenMedia("a sample lies outside the file")
            track.keys = np.concatenate((track.keys, len(track.sizes) + np.flatnonzero(marks & 0x10000 == 0)))
            track.starts, track.sizes = np.concatenate((track.starts, starts)), np.concatenate((track.sizes, sizes))
            track.times = np.concatenate((track.times, time + np.cumsum(steps) - steps))
            time += int(steps.sum())
            track.duration = max(track.duration, time)


def parse(raw: bytes) -> list[Track]:
    """The tracks of a container, with the samples of its fragments; raises BrokenMedia for anything else."""
    view, tracks, seen, fragments, usual, begin = memoryview(raw), [], False, [], {}, 0
    for kind, body, end in boxes(view, 0, len(view)):
        if kind == b"moov":
            seen = True
            for k, b, e in boxes(view, body, end):
                if k == b"trak":
                    tracks.append(_track(view, b, e))
                elif k == b"mvex":
                    for name, x, stop in boxes(view, b, e):
                        if name == b"trex" and stop - x >= 24:
                            number, _, *rest = struct.unpack_from(">5I", view, x + 4)
                            usual[number] = tuple(rest)
        elif kind == b"moof":
            fragments.append((begin, body, end))
        begin = end
    if not seen:
        raise BrokenMedia("there is no moov box")
    known = {t.number: t for t in tracks}
    try:
        for fragment in fragments:
            _runs_of(view, *fragment, known, usual)
    except struct.error as e:
        raise BrokenMedia(str(e)) from None
    return tracks


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def encode_frames(payload: bytes) -> bytes:
    """A container whose single video track has the payload, a positive multiple of 64 bytes, as 8-bit samples."""
    if not payload or len(payload) % LINE:
        raise ValueError(f"the payload must be a positive multiple of {LINE} bytes")
    frame = LINE * FRAME_LINES
    sizes = [frame] * (len(payload) // frame) + ([len(payload) % frame] if len(payload) % frame else [])
    n, full = len(sizes), lambda kind, *parts: _box(kind, bytes(4), *parts)
    height = min(FRAME_LINES, len(payload) // LINE)
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, LINE, height, 0x480000, 0x480000, 0, 1, b"\x04gray", 40, -1)

    def moov(at: int) -> bytes:
        place = full(b"stco", struct.pack(">II", 1, at)) if at < 1 << 32 else full(b"co64", struct.pack(">IQ", 1, at))
        table = _box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)), full(b"stts", struct.pack(">3I", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", n), np.arange(1, n + 1, dtype=">u4").tobytes()), full(b"stsc", struct.pack(">4I", 1, 1, n, 1)),
            full(b"stsz", struct.pack(">II", 0, n), np.array(sizes, ">u4").tobytes()), place,
        )
        media = _box(
            b"mdia", full(b"mdhd", struct.pack(">4IHH", 0, 0, TIMESCALE, n * TICKS, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"),
            _box(b"minf", _box(b"vmhd", struct.pack(">IHHHH", 1, 0, 0, 0, 0)), _box(b"dinf", full(b"dref", struct.pack(">I", 1), _box(b"url ", struct.pack(">I", 1)))), table),
        )
        track = _box(b"trak", _box(b"tkhd", struct.pack(">6I8xHHHH", 7, 0, 0, 1, 0, n * TICKS, 0, 0, 0, 0), unity, struct.pack(">II", LINE << 16, height << 16)), media)
        return _box(b"moov", full(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, n * TICKS, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2)), track)

    head = _box(b"ftyp", b"qt  ", bytes(4), b"qt  ")
    start = len(head) + len(moov(0)) + 8
    return b"".join((head, moov(start), struct.pack(">I4s", 8 + len(payload), b"mdat"), payload))


def payload(raw: bytes, track: Track) -> bytes:
    """The samples of a track in order."""
    return b"".join(raw[a : a + n] for a, n in zip(track.starts.tolist(), track.sizes.tolist()))


def ranges(track: Track) -> list[tuple[int, int]]:
    """(first byte, size) of each key frame."""
    return list(zip(track.starts[track.keys].tolist(), track.sizes[track.keys].tolist())) if len(track.starts) else []


INFO = "kind string, codec string, timescale long, duration long, seconds double, width int, height int, n_samples long, keyframes array<struct<start: long, size: long>>"


def media_info(df: DataFrame, column: str, into: str = "media_info") -> DataFrame:
    """``df`` with ``into``: tracks (codec, duration, key frame byte ranges) and error of the container in ``column``.

    Null gives null; bytes that are no container give no tracks and the error.
    Other columns pass through under any names.
    """
    if into in df.columns:
        raise ValueError(f"{into} is a column already")

    def info(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            out = []
            for raw in batch:
                raw = raw.as_py()
                if raw is None:
                    out.append(None)
                    continue
                try:
                    out.append({"tracks": [{"kind": t.kind, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "seconds": t.seconds, "width": t.width, "height": t.height, "n_samples": len(t.sizes), "keyframes": [{"start": a, "size": n} for a, n in ranges(t)]} for t in parse(raw)], "error": None})
                except BrokenMedia as e:
                    out.append({"tracks": [], "error": str(e)})
            yield pa.array(out, kind)

    one = pa.struct([("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))])
    kind = pa.struct([("tracks", pa.list_(one)), ("error", pa.string())])
    return df.withColumn(into, F.arrow_udf(info, f"struct<tracks: array<struct<{INFO.replace(' string', ': string').replace(' long', ': long').replace(' double', ': double').replace(' int,', ': int,').replace('keyframes array', 'keyframes: array').replace(':: ', ': ')}>>, error: string>")(F.col(column)))


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every whole text: its UTF-8 bytes with zeros up to a positive multiple of 64, as a container.

    A null text is empty. Repeated rows give equal containers, rows without a doc_id
    keep their null, and an empty table gives no rows. Only doc_id and text are read,
    so other columns may have any names.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(1))
            for row, end, part, at in textkit.chunks(data, offsets):
                made = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = part[a:b].tobytes()
                    made.append(encode_frames(own + bytes(-len(own) % LINE or (0 if own else LINE))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(at)), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Checksums and features of (doc_id, n_bytes, media), read back through the sample tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for raw in batch.column(2):
                raw = raw.as_py()
                track = parse(raw)[0]
                own, keys = payload(raw, track), ranges(track)
                where = zlib.crc32(np.array(keys, "<i8").tobytes())
                feature = f"codec={track.codec.strip()} size={track.width}x{track.height} seconds={track.seconds:.3f} frames={len(track.sizes)} keyframes={len(keys)} first={keys[0][0]}+{keys[0][1]} last={keys[-1][0]}+{keys[-1][1]} ranges_crc32={where:08x}"
                for c, v in zip(columns, (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-LINE:]), len(raw), hashlib.sha256(raw).hexdigest(), feature)):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)
