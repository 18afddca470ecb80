"""Media columns: Netpbm and BMP images in, NPY tiles and difference hashes out.

Images are binary columns. decode() turns them into numpy arrays; resize()
averages areas by integral images; tiles() writes NPY tiles of bounded size
with a difference hash each. Work is per row, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import named

#: Bytes of a payload row: 64 pixels of 3 samples.
ROW = 192
#: Bytes that an answer batch holds at most, beyond its last row.
BATCH = 16 << 20


# --- formats ---------------------------------------------------------------


def write_netpbm(a: np.ndarray) -> bytes:
    """P5 of a (h, w) array, P6 of a (h, w, 3) array of 8-bit samples."""
    kind = b"P6" if a.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, a.shape[1], a.shape[0]) + a.tobytes()


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """The next n numbers after the magic, comments skipped, and where the samples start."""
    found, at = [], 2
    while len(found) < n:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise ValueError("unended comment")
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("number expected in the header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3); bitmaps as 0 (black) and 255; maxima other than 255 are scaled to it."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        if kind == b"P4":
            rows = np.frombuffer(data, np.uint8, h * (-(-w // 8)), at).reshape(h, -(-w // 8))
            bits = np.unpackbits(rows, axis=1)[:, :w]
        else:
            bits = np.array([c - 48 for c in data[at - 1 :] if c in b"01"][: h * w], np.uint8).reshape(h, w)
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    (w, h, most), at = _header(data, 3)
    if not 0 < most < 65536:
        raise ValueError("maximum out of range")
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = int(np.prod(shape))
    if kind in (b"P2", b"P3"):
        a = np.array(data[at - 1 :].split()[:n], np.int64)
    else:
        a = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at)
    a = a.reshape(shape)
    return a.astype(np.uint8, copy=False) if most == 255 else (a.astype(np.int64) * 255 // most).astype(np.uint8)


def write_bmp(a: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of a (h, w, 3) array of RGB samples."""
    h, w, _ = a.shape
    stride = -(-w * 3 // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = a[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + h * stride, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP, bottom-up or top-down, as (h, w, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("this kind of BMP is not supported")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    if h > 0:
        rows = rows[::-1]
    if bits == 8:
        colors = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colors * 4, 14 + size).reshape(colors, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


# --- features --------------------------------------------------------------


def integral_rows(a: np.ndarray, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The rows of the image's integral image that at names. Only a strip of about step pixels is summed at a time."""
    rows, cols, depth = a.shape
    out = np.zeros((len(at), cols + 1, depth), np.int64)
    above = np.zeros((cols, depth), np.int64)
    high = max(1, step // cols)
    for lo in range(0, rows, high):
        sums = np.cumsum(a[lo : lo + high], axis=0, dtype=np.int64) + above
        above = sums[-1]
        here = np.flatnonzero((at > lo) & (at <= lo + len(sums)))
        out[here, 1:] = np.cumsum(sums[at[here] - lo - 1], axis=1)
    return out


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of each of h x w areas of the image, by integral images; pixels on a border count in part."""
    a = a if a.ndim == 3 else a[:, :, None]
    rows, cols, _ = a.shape

    def ends(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(parts + 1) * (n / parts)
        lo = np.minimum(x.astype(int), n - 1)
        return lo, x - lo

    (y, fy), (x, fx) = ends(rows, h), ends(cols, w)
    fy, fx = fy[:, None, None], fx[None, :, None]
    table = integral_rows(a, np.concatenate([y, y + 1]))
    across = table[: h + 1] * (1 - fy) + table[h + 1 :] * fy
    at = across[:, x] * (1 - fx) + across[:, x + 1] * fx
    total = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return total / (rows / h * cols / w)


def difference_hash(a: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 areas is darker than its right neighbour."""
    grey = resize(a, 8, 9).mean(axis=2).round(6)  # areas of equal brightness are equal
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


#: Pixels on a tile's side.
TILE = 256


def cut_tiles(a: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row of tiles, column of tiles, samples) of an image's tiles."""
    for y in range(0, a.shape[0], tile):
        for x in range(0, a.shape[1], tile):
            yield y // tile, x // tile, np.ascontiguousarray(a[y : y + tile, x : x + tile])


def tiles(df: DataFrame, id_col: str, media_col: str, tile: int = TILE) -> DataFrame:
    """(id, tile_y, tile_x, height, width, npy, dhash, error): every image cut into NPY tiles of at most tile x tile pixels.

    A null image gives no rows; one that can't be read, as an empty one, gives
    one row with the reason in error and nulls elsewhere. Repeated rows
    repeat; images of any size are cut, a batch of tiles at a time; an empty
    table gives no rows; other columns are not read.
    """
    schema = "id long, tile_y long, tile_x long, height long, width long, npy binary, dhash string, error string"

    def rows(key: int, data: bytes) -> Iterator[tuple]:
        try:
            a = decode(data)
            for y, x, t in cut_tiles(a, tile):
                yield key, y, x, *t.shape[:2], npy(t), difference_hash(t), None
        except (ValueError, struct.error, IndexError) as e:
            yield key, None, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.string(), pa.string()]
        names = ["id", "tile_y", "tile_x", "height", "width", "npy", "dhash", "error"]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for b in batches:
            found, size = [], 0
            column = b.column("media")
            for i, key in enumerate(b.column("id").to_pylist()):
                if (data := column[i].as_py()) is None:
                    continue
                for row in rows(key, data):
                    found.append(row)
                    size += len(row[5] or b"")
                    if size >= BATCH:
                        yield batch(found)
                        found, size = [], 0
            if found:
                yield batch(found)

    return df.select(named(id_col).cast("long").alias("id"), named(media_col).alias("media")).mapInArrow(run, schema)


# --- texts as images -------------------------------------------------------


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of ROW bytes."""
    return text + b" " * (ROW - len(text) % ROW if len(text) % ROW or not text else 0)


def encode_payload(data: bytes) -> bytes:
    """A P6 image, 64 pixels wide, whose samples are the payload."""
    return write_netpbm(np.frombuffer(data, np.uint8).reshape(-1, ROW // 3, 3))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: bool = False) -> DataFrame:
    """One row per row of docs: its text stored as an image, read back, and measured.

    feature is the difference hash of the whole image. The image is cut into
    NPY tiles, of which there are the count, the digest of their bytes, in
    order, and their difference hashes; an 8 x 8 BMP is made of the resized
    image, and preview_sha256 is the digest of its samples, read back. With
    files, the BMP and the tiles come too, in preview and tiles. A null
    text counts as empty; empty texts give one row of spaces; long ones as
    many rows as they take; equal texts, and so repeated rows, give equal
    values; bytes that are no UTF-8 are stored as they are; an empty table
    gives an empty one; other columns are not read.
    """
    stored_files = {"preview": pa.binary(), "tiles": pa.list_(pa.binary())} if files else {}
    names = {
        "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
        "n_tiles": pa.int64(), "tiles_sha256": pa.string(), "tile_hashes": pa.string(), "preview_sha256": pa.string(), **stored_files,
    }

    def measured(text: bytes) -> tuple:
        media = encode_payload(payload(text))
        image = decode(media)
        back = image.tobytes()
        whole, n_tiles, hashes, stored = hashlib.sha256(), 0, [], []
        for _, _, tile in cut_tiles(image):
            whole.update(data := npy(tile))
            n_tiles += 1
            hashes.append(difference_hash(tile))
            if files:
                stored.append(data)
        preview = write_bmp(np.round(resize(image, 8, 8)).astype(np.uint8))
        seen = hashlib.sha256(np.ascontiguousarray(decode(preview)).tobytes()).hexdigest()
        values = len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image)
        return *values, n_tiles, whole.hexdigest(), " ".join(hashes), seen, *((preview, stored) if files else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = list(names.values())[1:]

        def batch(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], list(names))

        for b in batches:
            column, found, size, lo = b.column("text").cast(pa.binary()), [], 0, 0
            for i in range(b.num_rows):
                found.append(measured(column[i].as_py() or b""))
                size += found[-1][1]
                if size >= BATCH:
                    yield batch(b.column("doc_id").slice(lo, len(found)), found)
                    found, size, lo = [], 0, i + 1
            if found:
                yield batch(b.column("doc_id").slice(lo), found)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles_sha256 string, tile_hashes string, preview_sha256 string" + (", preview binary, tiles array<binary>" if files else "")
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, schema)
