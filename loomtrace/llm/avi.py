"""AVI motion-JPEG media columns: RIFF writing and parsing, intra-frame decoding, shot detection.

Storage. A text's UTF-8 bytes, with bytes 255 up to a positive multiple of 576, are 8-bit grey samples
of 24 x 24 frames. Each frame is a lossless JPEG (process SOF3, predictor 1, no point transform) in a
``00dc`` chunk of an AVI file with an ``idx1`` index; baseline JPEG's quantised cosines would not
return the samples exactly. Reading parses the RIFF chunks and the index, then each frame's markers
and Huffman table, and decodes all frames of a block in step: one table look-up yields a symbol with
its extra bits for every frame at once.

Shots. Consecutive frames' 16-bin histograms are compared (half the sum of absolute differences);
a cut lies where the difference exceeds the mean of the preceding ``SPAN`` differences of the shot's
file by ``DEVIATIONS`` standard deviations and ``FLOOR``. Clips are timed at ``FPS`` frames a second.

Defined results: null and empty texts are one frame of 255s; a file of one frame is one clip, and so is one of two, as the
first difference of a file has none before it to exceed; equal
texts give equal bytes and features; very long texts are coded in blocks of frames; an empty table
gives an empty table; further columns are ignored. Bytes that are no such file raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import map_slices

SIDE, UNIT, FPS = 24, 576, 25
BINS, SPAN, DEVIATIONS, FLOOR = 16, 8, 2.0, 0.08
#: Frames coded or decoded at once.
BLOCK = 2048
#: Huffman code lengths of the difference categories 0 to 8; the all-ones code stays free.
LENGTHS = {7: 2, 3: 3, 4: 3, 5: 3, 0: 4, 1: 4, 2: 4, 6: 4, 8: 4}


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: category -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_SYMBOLS = sorted(LENGTHS, key=lambda c: (LENGTHS[c], c))
_COUNTS = [sum(v == n for v in LENGTHS.values()) for n in range(1, 17)]
_CODES = _codes(_COUNTS, _SYMBOLS)
_DHT = bytes([0, *_COUNTS, *_SYMBOLS])
HEADER = b"".join(
    [
        b"\xff\xd8",
        b"\xff\xc4" + struct.pack(">H", 2 + len(_DHT)) + _DHT,
        b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]),
        b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0]),
    ]
)


def _category() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255 to 255: the code with its extra bits, and their number."""
    bits, size = np.zeros(511, np.int32), np.zeros(511, np.int32)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, length = _CODES[c]
        bits[d + 255] = (code << c) | (d if d >= 0 else d + (1 << c) - 1)
        size[d + 255] = length + c
    return bits, size


_BITS, _SIZE = _category()


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def code_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded scans of frames given as (n, 576) samples."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    d = d.reshape(n, UNIT) + 255
    bits, size = _BITS[d], _SIZE[d]
    ends = np.cumsum(size, axis=1, dtype=np.int32)
    length = (ends[:, -1] + 7) >> 3
    first = np.cumsum(length) - length
    at = (ends - size).astype(np.int64) + (first << 3)[:, None]
    word = (bits << (24 - (at & 7).astype(np.int32) - size)).ravel()
    byte = (at >> 3).ravel()
    total = int(length.sum())
    data = np.zeros(total + 2)
    for k, shift in enumerate((16, 8, 0)):
        data[k:] += np.bincount(byte, weights=(word >> shift) & 255, minlength=total + 2)[: total + 2 - k]
    out = data[:total].astype(np.uint8)
    out[first + length - 1] |= ((1 << (length * 8 - ends[:, -1])) - 1).astype(np.uint8)  # a scan ends in ones
    stuffed = out == 255
    moved = np.arange(total) + np.cumsum(stuffed) - stuffed
    scan = np.zeros(total + int(stuffed.sum()), np.uint8)
    scan[moved] = out
    raw = scan.tobytes()
    cuts = [*moved[first].tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def write_avi(scans: list[bytes]) -> bytes:
    """An AVI file of the frames with their index."""
    n, movi, index, at = len(scans), [], [], 4
    for scan in scans:
        size = len(HEADER) + len(scan) + 2
        movi += [b"00dc", size.to_bytes(4, "little"), HEADER, scan, b"\xff\xd9", b"\0" * (size & 1)]
        index.append((at, size))
        at += 8 + size + (size & 1)
    entries = np.zeros((n, 4), "<u4")
    entries[:, 0], entries[:, 1], entries[:, 2:] = int.from_bytes(b"00dc", "little"), 16, index
    most = max(size for _, size in index)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 16, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    part = lambda kind, data: kind + struct.pack("<I", len(data)) + data
    strl = part(b"LIST", b"strl" + part(b"strh", strh) + part(b"strf", strf))
    body = part(b"LIST", b"hdrl" + part(b"avih", avih) + strl) + part(b"LIST", b"movi" + b"".join(movi)) + part(b"idx1", entries.tobytes())
    return part(b"RIFF", b"AVI " + body)


def index(media: bytes) -> list[tuple[int, int]]:
    """(start, size) of each frame, from the file's idx1."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, entries = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            entries = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or entries is None:
        raise ValueError("no movi list or idx1 chunk")
    entries = entries[entries[:, 0] == int.from_bytes(b"00dc", "little")]
    return [(movi + 8 + int(o), int(s)) for o, s in entries[:, 2:]]


@lru_cache(maxsize=64)
def tables(header: bytes) -> tuple[np.ndarray, np.ndarray]:
    """From a frame's markers: for every 16 bits, the bits used by the first symbol and its difference."""
    at, codes = 2, {}
    if header[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while at + 4 <= len(header):
        mark, size = header[at + 1], int.from_bytes(header[at + 2 : at + 4], "big")
        body = header[at + 4 : at + 2 + size]
        if mark == 0xC4:
            codes = _codes(list(body[1:17]), list(body[17:]))
        elif mark == 0xC3 and (body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]) != (8, SIDE, SIDE, 1):
            raise ValueError("only 8-bit grey frames of 24 x 24 are stored here")
        elif mark == 0xDA and body[3] != 1:
            raise ValueError("only predictor 1 is stored here")
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC3, 0xC4):
            raise ValueError("only lossless frames are stored here")
        at += 2 + size
    used, diff = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int16)
    for c, (code, length) in codes.items():
        if length + c > 16:
            raise ValueError("a symbol and its extra bits exceed 16 bits")
        for extra in range(1 << c):
            value = extra if not c or extra >> (c - 1) else extra - (1 << c) + 1
            low = ((code << c) | extra) << (16 - length - c)
            used[low : low + (1 << (16 - length - c))] = length + c
            diff[low : low + (1 << (16 - length - c))] = value
    return used, diff


def decode_frames(media: bytes, frames: list[tuple[int, int]]) -> np.ndarray:
    """(n, 576) samples of the frames at the given places of a file."""
    parts, sizes, header = [], [], b""
    for start, size in frames:
        if not header or media[start : start + len(header)] != header:
            at = start + 2
            while media[at + 1] != 0xDA:
                at += 2 + int.from_bytes(media[at + 2 : at + 4], "big")
            header = media[start : at + 2 + int.from_bytes(media[at + 2 : at + 4], "big")]
            used, diff = tables(header)
        parts.append(media[start + len(header) : start + size - 2])
        sizes.append(len(parts[-1]))
    return decode_scans(parts, sizes, used, diff)


def decode_scans(parts: list[bytes], sizes: list[int], used: np.ndarray, diff: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8)
    stuffing = np.zeros(len(raw), bool)
    stuffing[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    first = np.cumsum(sizes) - np.asarray(sizes)
    gone = np.cumsum(stuffing)
    at = (first - np.where(first > 0, gone[first - 1], 0)) << 3
    data = np.concatenate([raw[~stuffing], np.full(3, 255, np.uint8)]).astype(np.int32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    out = np.empty((UNIT, len(parts)), np.int16)
    last = len(window) - 1
    for k in range(UNIT):
        symbol = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7))) & 0xFFFF
        out[k] = diff[symbol]
        at += used[symbol]
    x = np.ascontiguousarray(out.T).reshape(-1, SIDE, SIDE)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return (np.cumsum(x, axis=2, dtype=np.int16) & 255).astype(np.uint8).reshape(-1, UNIT)


def encode(texts: list[str | None]) -> list[bytes]:
    """The stored form of each text; frames are coded in blocks across texts."""
    loads = [payload(t) for t in texts]
    samples = np.frombuffer(b"".join(loads), np.uint8).reshape(-1, UNIT)
    scans: list[bytes] = []
    for at in range(0, len(samples), BLOCK):
        scans += code_frames(samples[at : at + BLOCK])
    out, at = [], 0
    for x in loads:
        n = len(x) // UNIT
        out.append(write_avi(scans[at : at + n]))
        at += n
    return out


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The samples (n, 576) of each file; frames are decoded in blocks across files."""
    parts, counts, table = [], [], None
    for media in files:
        frames = index(media)
        counts.append(len(frames))
        for start, size in frames:
            if media[start : start + len(HEADER)] == HEADER:
                parts.append(media[start + len(HEADER) : start + size - 2])
            else:
                table = "own"
    if table:  # other writers' tables: file by file
        return [np.concatenate([decode_frames(m, index(m)[a : a + BLOCK]) for a in range(0, len(index(m)), BLOCK)]) for m in files]
    used, diff = tables(HEADER)
    blocks = [decode_scans(parts[a : a + BLOCK], [len(p) for p in parts[a : a + BLOCK]], used, diff) for a in range(0, len(parts), BLOCK)]
    samples = np.concatenate(blocks) if blocks else np.zeros((0, UNIT), np.uint8)
    return np.split(samples, np.cumsum(counts)[:-1]) if counts else []


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past last) frame of each clip."""
    n = len(samples)
    if n < 2:
        return [(0, n)]
    bins = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(bins, axis=0)).sum(axis=1) / (2 * UNIT)
    c, c2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    k = np.arange(len(d))
    low = np.maximum(0, k - SPAN)
    count = np.maximum(1, k - low)
    mean = (c[k] - c[low]) / count
    deviation = np.sqrt(np.maximum(0, (c2[k] - c2[low]) / count - mean * mean))
    cuts = (np.flatnonzero((k > 0) & (d > mean + DEVIATIONS * deviation + FLOOR)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, the AVI file of each text."""

    def task():
        return lambda p: pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(encode(p.column("text").to_pylist()), pa.binary())], names=["doc_id", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, media binary")


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of the media column: doc_id, clip, start_ms, end_ms, n_frames, mean_sample. Null media: no rows."""

    def task():
        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            files = p.column("media").to_pylist()
            have = [i for i, m in enumerate(files) if m is not None]
            rows = []
            for i, x in zip(have, decode([files[i] for i in have]), strict=True):
                rows += [(i, k, a * 1000 // FPS, b * 1000 // FPS, b - a, float(x[a:b].mean())) for k, (a, b) in enumerate(shots(x))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([p.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.float64())], names=["doc_id", "clip", "start_ms", "end_ms", "n_frames", "mean_sample"])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")), task, f"doc_id {kind}, clip long, start_ms long, end_ms long, n_frames long, mean_sample double", "media")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and keep their digests and the clips as a feature."""

    def task():
        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            texts = p.column("text").to_pylist()
            files = encode(texts)
            rows = []
            for t, m, x in zip(texts, files, decode(files), strict=True):
                back = x.tobytes()
                found = ",".join(f"{a * 1000 // FPS}-{b * 1000 // FPS}" for a, b in shots(x))
                rows.append((len((t or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), found))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([p.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

        return each

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
