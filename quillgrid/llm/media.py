"""Media columns: ISO base media files, written losslessly and read by their boxes.

``store`` keeps bytes as 8-bit PCM samples, 192 to an access unit, in a file of nested boxes with real sample
tables. ``probe`` walks the boxes of any such file and decodes the sample tables (durations, chunk runs, sizes,
chunk offsets, sync samples) into codec, duration and the byte ranges of keyframes, without touching the
media data; ``payload`` reads the samples back by these ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa

from .common import arrow_function, utf8

UNIT, PAD = 192, b" "
RATE, PER_CHUNK, SYNC_EVERY = 8000, 64, 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), PAD)


def store(payload: bytes) -> bytes:
    """A file that holds payload (a multiple of 192 bytes) as 8-bit samples."""
    units, length = len(payload) // UNIT, len(payload)
    chunks = -(-units // PER_CHUNK)
    matrix = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK)] if units % PER_CHUNK == 0 else [(1, PER_CHUNK), (chunks, units % PER_CHUNK)] if chunks > 1 else [(1, units)]
    syncs = np.arange(1, units + 1, SYNC_EVERY, dtype=">u4")
    wide = length + 64 * chunks + 4 * len(syncs) > 0xF0000000

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * UNIT)
        table = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", len(syncs)), syncs.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            table,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"text as samples\0")
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), hdlr, minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, length), struct.pack(">IH", 65536, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (8 if length + 8 < 1 << 32 else 16)
    return b"".join((ftyp, moov(head), box(b"mdat", payload)))


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start, end of the content) of every box, containers before what they hold."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"a box of {size} bytes at {at} ends beyond {end}")
        here = (*path, kind)
        yield here, at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, here)
        at += size


def probe(data: bytes | None) -> dict | None:
    """Codec, timescale, duration, number of samples, and byte ranges of all samples and of keyframes.

    Of the first track that has sample tables; None where there is none, or the boxes don't fit together.
    """
    found: dict[bytes, tuple[int, int]] = {}
    try:
        for path, start, end in walk(data or b""):
            if path[-1] == b"trak" and b"stsz" in found:
                break
            found[path[-1]] = (start, end)
        if not {b"stsd", b"stts", b"stsc", b"stsz", b"mdhd"} <= found.keys() or not found.keys() & {b"stco", b"co64"}:
            return None

        def numbers(kind: bytes, skip: int, count: int, code: str = ">u4") -> np.ndarray:
            start, end = found[kind]
            if start + skip + count * np.dtype(code).itemsize > end:
                raise ValueError(f"{kind!r} is too short")
            return np.frombuffer(data, code, count, start + skip).astype(np.int64)

        wide = data[found[b"mdhd"][0]] == 1
        at = found[b"mdhd"][0] + 4 + (16 if wide else 8)
        timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, at)
        codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
        fixed, count = map(int, numbers(b"stsz", 4, 2))
        sizes = np.full(count, fixed) if fixed else numbers(b"stsz", 12, count)
        kind, code = (b"co64", ">u8") if b"co64" in found else (b"stco", ">u4")
        chunks = numbers(kind, 8, int(numbers(kind, 4, 1)[0]), code)
        runs = numbers(b"stsc", 8, 3 * int(numbers(b"stsc", 4, 1)[0])).reshape(-1, 3)
        times = numbers(b"stts", 8, 2 * int(numbers(b"stts", 4, 1)[0])).reshape(-1, 2)
        each = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0] - 1, len(chunks)])) if len(runs) else np.zeros(0, np.int64)
        if each.sum() != count or times[:, 0].sum() != count:
            raise ValueError("the sample tables differ in their number of samples")
        before = np.r_[0, np.cumsum(sizes)[:-1]] if count else np.zeros(0, np.int64)
        firsts = np.r_[0, np.cumsum(each)[:-1]] if len(each) else np.zeros(0, np.int64)
        offsets = np.repeat(chunks, each) + before - np.repeat(before[firsts], each) if count else before
        keys = numbers(b"stss", 8, int(numbers(b"stss", 4, 1)[0])) - 1 if b"stss" in found else np.arange(count)
        return {"codec": codec, "timescale": timescale, "duration": duration, "samples": count, "ranges": np.stack([offsets, sizes], axis=1), "keyframes": np.stack([offsets[keys], sizes[keys]], axis=1), "chunks": chunks, "each": each}
    except (ValueError, struct.error, IndexError):
        return None


def payload(data: bytes, about: dict) -> bytes:
    """The samples in order; neighbours are read as one range."""
    r = about["ranges"]
    if not len(r):
        return b""
    cut = np.flatnonzero(r[1:, 0] != r[:-1, 0] + r[:-1, 1]) + 1
    starts, ends = r[np.r_[0, cut], 0], (r[:, 0] + r[:, 1])[np.r_[cut - 1, len(r) - 1]]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def feature(about: dict) -> str:
    keys = np.ascontiguousarray(about["keyframes"], dtype="<i8")
    return f"codec={about['codec'].strip()};rate={about['timescale']};duration={about['duration']};samples={about['samples']};keyframes={len(keys)};first={keys[0, 0]}+{keys[0, 1]};ranges={zlib.crc32(keys.tobytes()):08x}"


@arrow_function("struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>")
def round_trip(texts: pa.Array) -> pa.Array:
    """Each text stored, read back and described.

    A null text is empty; equal texts have equal files, repeated rows included. A text of any length is one file
    (offsets of 64 bits where it needs them), so a row must fit a task's memory a few times.
    """
    rows = []
    for text in utf8(texts):
        media = store(padded(text))
        about = probe(media)
        back = payload(media, about)
        rows.append((len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(about)))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


@arrow_function("binary")
def stored(texts: pa.Array) -> pa.Array:
    """The media files themselves, for writing a media column."""
    return pa.array([store(padded(t)) for t in utf8(texts)], pa.binary())


@arrow_function("struct<codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,length:long>>>")
def described(media: pa.Array) -> pa.Array:
    """Of a binary column: codec, duration and keyframe byte ranges; null for what isn't such a file."""
    out = []
    for value in media.to_pylist():
        about = probe(value)
        out.append(about and {k: about[k] for k in ("codec", "timescale", "duration", "samples")} | {"keyframes": [{"offset": a, "length": n} for a, n in about["keyframes"].tolist()]})
    pair = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
    return pa.array(out, pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pair))]))
