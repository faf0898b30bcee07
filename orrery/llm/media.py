"""Operator 5, media columns: Netpbm and BMP images, NPY tiles and difference hashes.

Images decode to ``uint8`` arrays of shape (height, width, 3 or 1). Areas are averaged with an
integral image (a summed-area table), so a tile costs one pass over the pixels and four look-ups
a cell, whatever the scale. Tiles are written in the NPY format.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize, quoted, text_chunks

#: Bytes of a row of pixels, 64 of 3 samples each: payloads are padded to whole rows.
ROW_BYTES, WIDTH = 192, 64
TILE = 16

# ---------------------------------------------------------------- formats


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P6 for three samples a pixel, P5 for one."""
    h, w, depth = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if depth == 3 else 5, w, h) + pixels.astype(np.uint8).tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, 8 or 16 bits a sample; samples are scaled to 0..255, bitmaps to 0 and 255."""
    if not re.match(rb"P[1-6]", data):
        raise ValueError("not a Netpbm image")
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if m is None:
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = w * h * depth
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[:n] - 48
        out = (1 - bits) * 255
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\n\r]*", b" ", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        out = (1 - np.unpackbits(rows, axis=1)[:, :w]).reshape(-1) * 255
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(out) != n:
        raise ValueError("Netpbm image ends early")
    if kind not in (1, 4) and top != 255:
        out = (out.astype(np.int64) * 255 + top // 2) // top
    return out.astype(np.uint8).reshape(h, w, depth)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP, bottom row first, blue first, rows padded to 4 bytes."""
    h, w, depth = pixels.shape
    rgb = pixels if depth == 3 else np.repeat(pixels, 3, axis=2)
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    size = h * stride
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMPs of 8 (palette), 24 or 32 bits a pixel, in either row order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h = struct.unpack_from("<IIii", data, 10)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if bits not in (8, 24, 32) or packing not in (0, 3):
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        out = palette[rows][:, :, 2::-1]
    else:
        out = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- features


def area_resize(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over an h by w grid of equal areas, fractions of pixels weighed by their share."""
    rows, cols = gray.shape
    table = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])

    def lines(t: np.ndarray, n: int, m: int) -> np.ndarray:
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return t[low] * (1 - part) + t[low + 1] * part

    grid = lines(lines(table, rows, h).T, cols, w).T
    return np.diff(np.diff(grid, axis=0), axis=1) / (rows / h * cols / w)


def luma(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, 0].astype(np.float64) if pixels.shape[2] == 1 else pixels @ np.array([0.299, 0.587, 0.114])


def tile_npy(pixels: np.ndarray, size: int = TILE) -> bytes:
    """A ``size`` by ``size`` tile of area means, in the NPY format."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(luma(pixels), size, size)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: whether each of 8 x 9 area means exceeds its left neighbour."""
    small = area_resize(luma(pixels), 8, 9)
    return np.packbits(np.diff(small, axis=1) > 1e-9).tobytes().hex()


# ---------------------------------------------------------------- the operator


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b" ")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", form: str = "ppm") -> DataFrame:
    """Media column ``media`` (``ppm`` or ``bmp``) of every text's bytes, written as a table.

    The UTF-8 bytes (null: none), padded with spaces to whole rows of 64 pixels, are the samples
    of the image. Returns the written table ``doc_id, n_bytes, media``. Narrow.
    """
    if form not in ("ppm", "bmp"):
        raise ValueError(form)
    put = encode_ppm if form == "ppm" else encode_bmp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch, "t"):
                part = batch.slice(a, b - a)
                texts = part.column("t").to_pylist()
                size = [len((t or "").encode("utf-8")) for t in texts]
                media = [put(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH, 3)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(quoted(key).alias("k"), quoted(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """Digests of the payload read back from each image, its difference hash and its NPY tile's hash."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch, "media"):
                part, out = batch.slice(a, b - a), []
                for data in part.column("media").to_pylist():
                    pixels = decode(data)
                    back = pixels.tobytes()
                    out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), hashlib.sha256(tile_npy(pixels)).hexdigest()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
