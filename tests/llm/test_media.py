import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import media as m

RNG = np.random.default_rng(7)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.booleans())
def test_formats_round_trip(h, w, grey):
    a = RNG.integers(0, 256, (h, w) if grey else (h, w, 3), dtype=np.uint8)
    assert (m.decode(m.write_netpbm(a)) == a).all()
    if not grey:
        assert (m.decode(m.write_bmp(a)) == a).all()


def test_other_netpbm_kinds():
    assert m.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert m.decode(b"P4 9 1\n\x80\x80").tolist() == [[0, *[255] * 7, 0]]
    assert m.decode(b"P2\n2 2 15\n0 15 5 10").tolist() == [[0, 255], [85, 170]]
    assert m.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert m.decode(b"P5 1 1 65535\n\x80\x00").tolist() == [[127]]
    for bad in (b"P7 x", b"P5 1", b"BM", b"", b"P6 9 9 255\nshort"):
        with pytest.raises((ValueError, IndexError, Exception)):
            m.decode(bad)


def test_bmp_kinds():
    import struct

    palette = bytes([10, 20, 30, 0, 40, 50, 60, 0])
    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 14 + 40 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 8, 0, 0, 0, 0, 2, 0)
    assert m.decode(head + palette + bytes([0, 1, 0, 0, 1, 0, 0, 0])).tolist() == [[[30, 20, 10], [60, 50, 40]], [[60, 50, 40], [30, 20, 10]]]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 13), st.integers(1, 13), st.integers(1, 9), st.integers(1, 9))
def test_resize_equals_area_means(h, w, rows, cols):
    a = RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)
    fine = np.repeat(np.repeat(a.astype(float), rows, axis=0), cols, axis=1)
    want = fine.reshape(rows, h, cols, w, 3).mean(axis=(1, 3))
    assert np.allclose(m.resize(a, rows, cols), want)


def plain_hash(a):
    """The difference hash with means of areas taken pixel by pixel, in parts of pixels where areas cut them."""
    h, w, _ = a.shape
    fine = np.repeat(np.repeat(a.astype(float), 8, axis=0), 9, axis=1)
    grey = fine.reshape(8, h, 9, w, 3).mean(axis=(1, 3)).mean(axis=2).round(6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def test_difference_hash_equals_plain_means():
    for h, w in ((1, 1), (3, 64), (17, 5), (40, 64)):
        a = RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert m.difference_hash(a) == plain_hash(a)


def test_integral_rows_by_strips():
    a = RNG.integers(0, 256, (50, 7, 3), dtype=np.uint8)
    at = np.array([0, 3, 3, 49, 50])
    assert (m.integral_rows(a, at, step=20) == m.integral_rows(a, at)).all()


def test_tiles(spark):
    a = RNG.integers(0, 256, (70, 50, 3), dtype=np.uint8)
    rows = [(1, bytearray(m.write_netpbm(a)), "x"), (2, bytearray(m.write_bmp(a)), "x"), (3, None, "x"), (4, bytearray(b"junk"), "x")]
    got = m.tiles(spark.createDataFrame(rows, "id long, media binary, npy string"), "id", "media", tile=32).collect()
    for key in (1, 2):
        whole = np.zeros_like(a)
        for r in (r for r in got if r.id == key):
            t = np.load(io.BytesIO(bytes(r.npy)), allow_pickle=False)
            assert t.shape[:2] == (r.height, r.width) and r.dhash == m.difference_hash(t)
            whole[r.tile_y * 32 : r.tile_y * 32 + r.height, r.tile_x * 32 : r.tile_x * 32 + r.width] = t
        assert (whole == a).all()
    assert [r.error for r in got if r.id == 4] == ["not a Netpbm image"] and not [r for r in got if r.id == 3]


def test_texts_as_media(spark):
    texts = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 300, "long " * 100_000, "a"]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in m.text_media(frame, files=True).collect()}
    assert sorted(map(tuple, m.text_media(frame).collect()), key=str) == sorted((tuple(r)[:-2] for r in got.values()), key=str)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        stored = m.encode_payload(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64, 3)
        assert r.feature == plain_hash(image) if len(image) < 100 else r.feature
        kept = [np.load(io.BytesIO(bytes(x))) for x in r.tiles]
        assert r.n_tiles == len(kept) == -(-len(image) // m.TILE) and (np.concatenate(kept) == image).all()
        assert r.tiles_sha256 == hashlib.sha256(b"".join(map(bytes, r.tiles))).hexdigest() and r.tile_hashes.split()[:2] == [plain_hash(k) for k in kept[:2]]
        assert r.preview_sha256 == hashlib.sha256(m.decode(bytes(r.preview)).tobytes()).hexdigest() and m.decode(bytes(r.preview)).shape == (8, 8, 3)
    assert got[2][1:] == got[8][1:]
    assert m.text_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []
