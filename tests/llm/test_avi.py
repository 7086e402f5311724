import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from loomtrace.llm import avi

HARD = ["", None, "a", "x" * 576, "y" * 577, "\xff" * 900, "日本語🙂" * 400, "word " * 5000, "same", "same", "\0" * 600]


def slow_decode(scan: bytes) -> list[int]:
    """One frame, bit by bit."""
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
    codes = {f"{code:0{n}b}": c for c, (code, n) in avi._CODES.items()}
    at, out = 0, []
    for k in range(576):
        n = next(n for n in range(1, 17) if bits[at : at + n] in codes)
        c = codes[bits[at : at + n]]
        extra = int(bits[at + n : at + n + c] or "0", 2)
        at += n + c
        d = extra if not c or extra >> (c - 1) else extra - (1 << c) + 1
        pred = 128 if k == 0 else out[k - 24] if k % 24 == 0 else out[k - 1]
        out.append((pred + d) & 255)
    return out


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (300, 576), dtype=np.uint8)
    x[:50] = 255
    x[50:100] = rng.choice([0, 255], (50, 576))
    media = avi.write_avi(avi.code_frames(x))
    assert (avi.decode([media])[0] == x).all()
    frames = avi.index(media)
    assert (avi.decode_frames(media, frames) == x).all()
    for k in (0, 60, 200):
        start, size = frames[k]
        assert slow_decode(media[start + len(avi.HEADER) : start + size - 2]) == x[k].tolist()


def test_file_form():
    media = avi.encode(["word " * 300])[0]
    assert struct.unpack("<I", media[4:8])[0] == len(media) - 8
    start, size = avi.index(media)[0]
    assert media[start - 8 : start - 4] == b"00dc" and media[start : start + 2] == b"\xff\xd8" and media[start + size - 2 : start + size] == b"\xff\xd9"
    with pytest.raises(ValueError):
        avi.index(b"RIFFxxxxWAVE")


def test_shots_find_a_change():
    x = np.full((40, 576), 100, np.uint8)
    x[25:] = 30
    assert avi.shots(x) == [(0, 25), (25, 40)]
    assert avi.shots(x[:1]) == [(0, 1)]


def test_digests(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(chr(rng.randint(32, 255)) for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in avi.digests(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        full = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[8][1:] == got[9][1:]
    media = avi.to_media(df)
    stored = {r.doc_id: r.media for r in media.collect()}
    assert all(hashlib.sha256(stored[i]).hexdigest() == got[i].media_sha256 and len(stored[i]) == got[i].media_bytes for i in stored)
    rows = avi.clips(media).collect()
    for i in stored:
        own = sorted((r.clip, r.start_ms, r.end_ms) for r in rows if r.doc_id == i)
        assert ",".join(f"{a}-{b}" for _, a, b in own) == got[i].feature


def test_empty_table(spark):
    assert avi.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
