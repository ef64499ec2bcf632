"""Media columns: Netpbm and BMP images as bytes, decoded to numpy arrays, resized by area with an integral
image, and written as NPY tiles with a difference hash."""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, texts

#: Bytes of one image row: 576 grey pixels, or 192 pixels of three samples (so that BMP rows need no padding).
ROW = 576
FORMATS = ("pgm", "ppm", "bmp")
#: Rows of pixels that are summed up at a time.
STRIP = 1024


def encode_image(pixels: np.ndarray, kind: str) -> bytes:
    """A (height, width) or (height, width, 3) array of uint8 as a file of that kind."""
    height, width = pixels.shape[:2]
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (width, height) + pixels.tobytes()
    if kind == "ppm":
        return b"P6\n%d %d\n255\n" % (width, height) + pixels.tobytes()
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _fields(data: bytes, n: int) -> tuple[list[int], int]:
    """The next n numbers of a Netpbm header, comments left out, and where they end."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("no number where the header needs one")
        out.append(int(data[at:end]))
        at = end
    return out, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = int(data[1:2])
    bitmap, colour, plain = kind in (1, 4), kind in (3, 6), kind < 4
    numbers, at = _fields(data, 2 if bitmap else 3)
    width, height, most = *numbers[:2], 1 if bitmap else numbers[2]
    if not 0 < most < 65536:
        raise ValueError("a maximum that Netpbm does not know")
    shape = (height, width, 3) if colour else (height, width)
    count = math.prod(shape)
    if plain:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.frombuffer(bytes(x for x in body if x in b"01"), np.uint8) - 48 if bitmap else np.array(body.split(), np.int64)
    elif bitmap:
        line = -(-width // 8)
        values = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(values) < count:
        raise ValueError("fewer samples than the header says")
    values = values[:count].reshape(shape)
    if bitmap:
        return ((1 - values) * 255).astype(np.uint8)  # ones are black
    return values.astype(np.uint8) if most == 255 else np.rint(values.astype(np.float64) * (255 / most)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    at, size, width, height, _, depth, packed = *struct.unpack_from("<I", data, 10), *struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or depth not in (1, 4, 8, 24, 32) or packed not in (0, 3) or packed and depth != 32:
        raise ValueError("only BMP of 1, 4, 8, 24 or 32 bits without compression is read")
    line, rows = -(-width * depth // 32) * 4, abs(height)
    body = np.frombuffer(data, np.uint8, line * rows, at).reshape(rows, line)
    if depth >= 24:
        pixels = body[:, : width * depth // 8].reshape(rows, width, depth // 8)
        if packed:
            masks = struct.unpack_from("<III", data, 54)
            whole = pixels.view("<u4")[:, :, 0]
            pixels = np.stack([whole >> (8 * (m.bit_length() // 8 - 1)) & 255 for m in masks], axis=2).astype(np.uint8)
        else:
            pixels = pixels[:, :, 2::-1]
    else:
        places = np.unpackbits(body, axis=1).reshape(rows, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        palette = np.frombuffer(data, np.uint8, at - 14 - size, 14 + size)
        pixels = palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1][places[:, :width]]
    return pixels[::-1] if height > 0 else pixels


def decode_image(data: bytes) -> np.ndarray:
    """The pixels as uint8: Netpbm P1 to P6 (samples scaled to 255), or BMP of 1, 4, 8, 24 or 32 bits (the last without
    its alpha); ValueError for anything else."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else ((pixels.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(axis=2) // 1000).astype(np.uint8)


def integral_rows(pixels: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Rows of the integral image of the grey pixels at the given heights, which may lie within a row of pixels.

    The image is summed up strip by strip, so memory is that of a strip and of the rows asked for.
    """
    height, width = pixels.shape[:2]
    out = np.zeros((len(ys), width + 1))
    whole = np.minimum(ys.astype(int), height - 1)
    above = np.zeros(width, np.int64)
    for top in range(0, height, STRIP):
        strip = grey(pixels[top : top + STRIP]).astype(np.int64)
        sums = np.vstack([np.zeros(width, np.int64), strip.cumsum(axis=0)])
        for i in np.flatnonzero((whole >= top) & (whole < top + STRIP)):
            out[i, 1:] = (above + sums[whole[i] - top] + (ys[i] - whole[i]) * strip[whole[i] - top]).cumsum()
        above = above + sums[-1]
    return out


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, cells that cut pixels included: bilinear samples of the integral image, differenced."""
    ys, xs = np.linspace(0, pixels.shape[0], height + 1), np.linspace(0, pixels.shape[1], width + 1)
    rows = integral_rows(pixels, ys)
    x = np.minimum(xs.astype(int), pixels.shape[1] - 1)
    at = rows[:, x] * (1 - (xs - x)) + rows[:, x + 1] * (xs - x)
    return np.diff(np.diff(at, axis=0), axis=1) / ((ys[1] - ys[0]) * (xs[1] - xs[0]))


def difference_hash(pixels: np.ndarray) -> str:
    small = area_resize(pixels, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store(data: bytes) -> tuple[int, bytes]:
    """(length of the payload, the image that holds it). The kind follows from the number of rows: equal texts, equal files."""
    payload = data + b"\xff" * (-len(data) % ROW or (0 if data else ROW))
    kind = FORMATS[len(payload) // ROW % 3]
    flat = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return len(payload), encode_image(flat if kind == "pgm" else flat.reshape(len(flat), ROW // 3, 3), kind)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_sha256", pa.string())])
FILES = SCHEMA + ", media binary, tile_npy binary"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 32, files: bool = True) -> DataFrame:
    """Each text as an image (media), its NPY tile and its digests; ``files=False`` leaves the two files out.

    Null and empty text give one row of bytes 255; equal texts equal values; repeated and null ids a row each; other
    columns are not read. One pass without a shuffle; a row needs memory for its own image.
    An empty table gives an empty result.
    """
    schema = pa.schema([*FIELDS, ("media", pa.binary()), ("tile_npy", pa.binary())]) if files else FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                _, media = store(data)
                pixels = decode_image(media)
                back = pixels.tobytes()
                tile = npy_tile(pixels, side)
                kind = {b"P5": "pgm", b"P6": "ppm", b"BM": "bmp"}[media[:2]]
                row = (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind}:{pixels.shape[1]}x{pixels.shape[0]}:{difference_hash(pixels)}", hashlib.sha256(tile).hexdigest())
                rows.append((*row, media, tile) if files else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, FILES if files else SCHEMA)
