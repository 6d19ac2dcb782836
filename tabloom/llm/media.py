"""Media columns: lossless Netpbm and BMP images, decoded to numpy arrays, area-resized and hashed.

A payload of bytes is stored as 8-bit RGB samples, 64 pixels a row: as binary Netpbm (P6) where the number of rows is
odd and as 24-bit BMP (bottom-up, blue first) where it is even.  The decoders read the stored bytes alone and take
P5, P6 and uncompressed 8- or 24-bit BMP, so columns of such files from elsewhere work as well.

Resizing averages over areas: the integral image is interpolated at the fractional edges of each target cell, which
is exact for any ratio of sizes.  A tile is written in the NPY format; the difference hash compares neighbouring cells
of a 9 x 8 grid of mean brightness, 64 bits as 16 hex digits.

Sums are taken a strip of STRIP samples at a time, so a text of any length needs its payload and stored form in memory and little more.

Defined results: a null text is empty; an empty payload is padded to one row; equal texts and repeated rows give equal values; a
null doc_id is carried along; bytes that are no such image raise ValueError in :func:`decode`; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = 64
ROW_BYTES = 3 * PIXELS
TILE = 16
#: Samples of an image that are summed at once.
STRIP = 1 << 20


def pad(data: bytes) -> bytes:
    """The bytes and as many spaces as make a positive multiple of ROW_BYTES."""
    size = max(ROW_BYTES, -(-len(data) // ROW_BYTES) * ROW_BYTES)
    return data.ljust(size, b" ")


def encode(payload: bytes) -> bytes:
    """A payload of whole rows as an image file."""
    rows = len(payload) // ROW_BYTES
    if rows % 2:
        return b"P6\n%d %d\n255\n" % (PIXELS, rows) + payload
    pixels = np.frombuffer(payload, np.uint8).reshape(rows, PIXELS, 3)[::-1, :, ::-1]
    head = struct.pack("<2sIHHI", b"BM", 54 + len(payload), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, PIXELS, rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + pixels.tobytes()


def decode(media: bytes) -> np.ndarray:
    """The samples of an image file: (rows, columns, channels) of uint8."""
    if media[:2] in (b"P5", b"P6"):
        return _netpbm(media)
    if media[:2] == b"BM":
        return _bmp(media)
    raise ValueError("neither binary Netpbm nor BMP")


def _netpbm(media: bytes) -> np.ndarray:
    at, numbers = 2, []
    while len(numbers) < 3:
        while media[at : at + 1].isspace():
            at += 1
        if media[at : at + 1] == b"#":
            at = media.index(b"\n", at)
            continue
        end = at
        while media[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header without its numbers")
        numbers.append(int(media[at:end]))
        at = end
    columns, rows, most = numbers
    channels = 3 if media[1:2] == b"6" else 1
    if most != 255 or len(media) - at - 1 < rows * columns * channels:
        raise ValueError("not 8-bit samples, or too few of them")
    return np.frombuffer(media, np.uint8, rows * columns * channels, at + 1).reshape(rows, columns, channels)


def _bmp(media: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", media, 10)[0]
    columns, rows, _, bits, packed = struct.unpack_from("<iiHHI", media, 18)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP with 8 or 24 bits is read")
    channels = bits // 8
    stride = (columns * channels + 3) // 4 * 4
    lines = np.frombuffer(media, np.uint8, abs(rows) * stride, start).reshape(abs(rows), stride)
    pixels = lines[:, : columns * channels].reshape(abs(rows), columns, channels)[:, :, ::-1]
    return pixels[::-1] if rows > 0 else pixels


def _weights(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(cells + 1) * (size / cells)
    low = np.minimum(edges.astype(np.int64), size - 1)
    return low, edges - low


def _samples(strip: np.ndarray) -> np.ndarray:
    return strip.astype(np.float64)


def _brightness(strip: np.ndarray) -> np.ndarray:
    return strip.mean(2, dtype=np.float64)


def _integral_lines(pixels: np.ndarray, at: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The integral image's lines ``at``, summed up a strip of rows at a time, so no image of floats is held."""
    total = np.zeros(of(pixels[:1]).shape[1:])
    lines = np.zeros((len(at), total.shape[0] + 1, *total.shape[1:]))
    size = max(1, STRIP // pixels[0].size)
    for low in range(0, len(pixels), size):
        strip = of(pixels[low : low + size])
        strip[0] += total
        strip = np.cumsum(strip, 0)
        inside = np.flatnonzero((at > low) & (at <= low + len(strip)))
        lines[inside, 1:] = strip[at[inside] - low - 1]
        total = strip[-1]
    return np.cumsum(lines, 1)


def resize(pixels: np.ndarray, rows: int, columns: int, of: Callable[[np.ndarray], np.ndarray] = _samples) -> np.ndarray:
    """Mean samples of rows x columns cells, float64; ``of`` makes the samples of some rows."""
    height, width = pixels.shape[:2]
    y, fy = _weights(height, rows)
    x, fx = _weights(width, columns)
    found = _integral_lines(pixels, np.concatenate([y, y + 1]), of)
    above, below = found[: rows + 1], found[rows + 1 :]
    fy, fx = fy.reshape(-1, *[1] * (found.ndim - 1)), fx.reshape(1, -1, *[1] * (found.ndim - 2))
    lines = above * (1 - fy) + below * fy
    at = lines[:, x] * (1 - fx) + lines[:, x + 1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((height / rows) * (width / columns))


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), allow_pickle=False)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """A bit for each cell of an 8 x 9 grid that is brighter than its left neighbour; means are compared in 1/256."""
    grid = np.rint(resize(pixels, 8, 9, _brightness) * 256)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every text's bytes as an image file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, data), pa.int64()), pa.array((encode(pad(d)) for d in data), pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored images hold: the payload's digests, the file's, the difference hash and an NPY tile."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(7)]
            for media in batch.column(2).to_pylist():
                pixels = decode(media)
                payload = pixels.tobytes()
                tile = np.rint(resize(pixels, TILE, TILE)).astype(np.uint8)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), npy(tile))
                for column, value in zip(made, row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [f.split()[0] for f in schema.split(", ")])

    return stored.mapInArrow(run, schema)
