"""Media columns: ISO base media files (MP4 and relatives) in binary columns.

`parse` walks the nested boxes of a file and decodes its sample tables (stts, stsc, stsz, stco or co64, stss) into
codec, duration and the byte ranges of key frames; sample payloads are never decoded. `write` builds a file with one
track of raw samples. `with_media` adds the parsed columns to a DataFrame.

Defined results: null content gives null columns and no error text; content without a movie box, or with truncated or
contradictory boxes, gives null columns and the reason in `media_error`; an empty table gives an empty table; a file
without a sync table has only key frames, as the format says. Other columns of the input pass unchanged; one named as
an output is replaced.
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
from pyspark.sql import types as T

BLOCK = 576
TIMESCALE = 25
KEY_EVERY = 12
#: Fixed values of ISO/IEC 14496-12: boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}


class MediaError(ValueError):
    """The bytes aren't a readable ISO media file."""


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def key_ranges(self) -> list[tuple[int, int]]:
        """(first byte, number of bytes) of each key frame."""
        return list(zip(self.starts[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the content) of the boxes between two positions; sizes of 64 bits and "to the end" too."""
    while at < end:
        if end - at < 8:
            raise MediaError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise MediaError("truncated box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise MediaError(f"box {kind.decode('latin-1')} leaves its parent")
        yield kind, at + head, at + size
        at += size


def _table(data: memoryview, at: int, end: int, width: int, kind: str = ">u4", skip: int = 8) -> np.ndarray:
    """The entries of a table box: rows of `width` big-endian numbers after version, flags and count."""
    if end - at < skip:
        raise MediaError("truncated table")
    n = struct.unpack_from(">I", data, at + skip - 4)[0]
    if at + skip + n * width * int(kind[-1]) > end:
        raise MediaError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, at + skip).astype(np.int64).reshape(n, width)


def _samples(track: Track, tables: dict[bytes, np.ndarray]) -> None:
    """Positions of all samples from the chunk offsets and the samples in each chunk."""
    chunks = tables.get(b"stco", tables.get(b"co64", np.zeros((0, 1), np.int64)))[:, 0]
    per = tables.get(b"stsc", np.zeros((0, 3), np.int64))
    n = len(track.sizes)
    if n and (not len(chunks) or not len(per) or per[0, 0] != 1):
        raise MediaError("samples without chunks")
    if n:
        counts = np.repeat(per[:, 1], np.diff(np.append(np.minimum(per[:, 0] - 1, len(chunks)), len(chunks))))
        if counts.sum() != n:
            raise MediaError("sample and chunk tables disagree")
        first = np.repeat(np.cumsum(counts) - counts, counts)
        before = np.cumsum(track.sizes) - track.sizes
        track.starts = np.repeat(chunks, counts) + before - before[first]
    if b"stss" in tables:
        track.keys = tables[b"stss"][:, 0] - 1
        if len(track.keys) and (track.keys.min() < 0 or track.keys.max() >= n):
            raise MediaError("a key frame isn't a sample")
    else:
        track.keys = np.arange(n)
    if b"stts" in tables and (x := tables[b"stts"])[:, 0].sum() == n:
        track.duration = int((x[:, 0] * x[:, 1]).sum()) if n else track.duration


def parse(content: bytes) -> list[Track]:
    """The tracks of a file."""
    data, tracks = memoryview(content), []

    def walk(at: int, end: int, track: Track | None, tables: dict[bytes, np.ndarray], depth: int = 0) -> None:
        if depth > 16:
            raise MediaError("boxes are nested too deeply")
        for kind, lo, hi in boxes(data, at, end):
            if kind == b"trak":
                own, found = Track(), {}
                walk(lo, hi, own, found, depth + 1)
                _samples(own, found)
                tracks.append(own)
            elif kind in CONTAINERS:
                walk(lo, hi, track, tables, depth + 1)
            elif track is None:
                continue
            elif kind == b"mdhd":
                wide = hi > lo and data[lo] == 1
                if hi - lo < (32 if wide else 20):
                    raise MediaError("truncated mdhd")
                track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, lo + (20 if wide else 12))
            elif kind == b"hdlr":
                track.kind = bytes(data[lo + 8 : min(lo + 12, hi)]).decode("latin-1")
            elif kind == b"stsd":
                if hi - lo < 16:
                    raise MediaError("truncated stsd")
                track.codec = bytes(data[lo + 12 : lo + 16]).decode("latin-1")
            elif kind == b"stsz":
                if hi - lo < 12:
                    raise MediaError("truncated stsz")
                same, n = struct.unpack_from(">II", data, lo + 4)
                track.sizes = np.full(n, same, np.int64) if same else _table(data, lo, hi, 1, skip=12)[:, 0]
            elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
                tables[kind] = _table(data, lo, hi, {b"stts": 2, b"stsc": 3}.get(kind, 1), ">u8" if kind == b"co64" else ">u4")

    walk(0, len(data), None, {})
    if not tracks:
        raise MediaError("no track")
    return tracks


def _box(kind: bytes, *content: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, content)), kind) + b"".join(content)


def _full(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *content)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write(payload: bytes, sample: int = BLOCK, key_every: int = KEY_EVERY, per_chunk: int = 64) -> bytes:
    """A file whose one video track stores the payload as raw 8-bit grey frames of `sample` bytes, every `key_every`-th a key frame.

    The payload's length must be a positive multiple of `sample`. The bytes depend on the arguments only.
    """
    n, rest = divmod(len(payload), sample)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the sample size")
    side = int(sample**0.5)
    keys = np.arange(0, n, key_every)
    chunks = np.arange(0, n, per_chunk)
    full, tail = divmod(n, per_chunk)
    per = [(1, per_chunk, 1)] * bool(full) + [(full + 1, tail, 1)] * bool(tail)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", side, side, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def movie(shift: int, wide: bool) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), (keys + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(per)), b"".join(struct.pack(">III", *x) for x in per)),
            _full(b"stsz", struct.pack(">II", sample, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), (chunks * sample + shift).astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _UNITY, struct.pack(">II", side << 16, side << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x0100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) >= 1 << 31
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    shift = len(ftyp) + len(movie(0, wide)) + len(head)
    return b"".join((ftyp, movie(shift, wide), head, payload))


def payload_of(content: bytes, track: Track) -> bytes:
    """The track's samples in order, cut out of the file by its sample tables; neighbouring samples are cut at once."""
    if not len(track.sizes):
        return b""
    ends = track.starts + track.sizes
    if track.starts.min() < 0 or ends.max() > len(content):
        raise MediaError("a sample lies outside the file")
    breaks = np.flatnonzero(track.starts[1:] != ends[:-1]) + 1
    return b"".join(content[a:b] for a, b in zip(track.starts[np.r_[0, breaks]].tolist(), ends[np.r_[breaks - 1, len(ends) - 1]].tolist(), strict=True))


RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("bytes", T.LongType())])
FIELDS = [
    T.StructField("codec", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(RANGE)),
    T.StructField("media_error", T.StringType()),
]


def _describe(content: bytes | None) -> tuple:
    if content is None:
        return None, None, None, None, None
    try:
        tracks = parse(content)
    except (MediaError, struct.error) as e:
        return None, None, None, None, str(e)
    track = next((t for t in tracks if t.kind == "vide"), tracks[0])
    keys = [{"start": a, "bytes": b} for a, b in track.key_ranges()]
    return track.codec, track.duration * 1000 // track.timescale if track.timescale else None, len(track.sizes), keys, None


def with_media(df: DataFrame, content: str) -> DataFrame:
    """df with codec, duration, sample count and key frame byte ranges of the files in a binary column."""
    from gemello.llm.text import appended

    return appended(df, [content], FIELDS, lambda cols: list(zip(*map(_describe, cols[0].to_pylist()), strict=True)) or [[]] * 5)


def stored(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `media`: each text (null: empty) as UTF-8, filled up with bytes 255 to a positive multiple of 576, stored as a file."""
    from gemello.llm.text import appended

    return appended(df, [text], [T.StructField("media", T.BinaryType())], lambda cols: [[write(padded(t)) for t in cols[0].to_pylist()]])


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


DIGEST = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def digest(text: str | None) -> tuple:
    """Store a text, read the stored bytes back and describe both."""
    media = write(padded(text))
    track = parse(media)[0]
    back = payload_of(media, track)
    keys = track.key_ranges()
    feature = f"codec={track.codec.strip()};duration_ms={track.duration * 1000 // track.timescale};samples={len(track.sizes)};keyframes={','.join(f'{a}+{b}' for a, b in keys)}"
    return len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the sizes, digests and features of each text's stored form; the files themselves are not kept."""
    from gemello.llm.text import appended

    def work(cols: list[pa.Array]) -> list:
        return list(zip(*map(digest, cols[0].to_pylist()), strict=True))

    return appended(df, [text], DIGEST, work, keep)
