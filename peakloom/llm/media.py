"""Operator 4: media columns as numpy arrays.

Netpbm (P1 to P6) and BMP (8-bit palette, 24 and 32 bit, either row order, 32 bit with channel masks) bytes are
decoded to arrays of height x width x channels, resized by area averages read off an integral image, cut into
NPY tiles, and hashed by the signs of horizontal differences. Each row is handled alone in Arrow batches, so
nothing is shuffled and a task holds one batch.

Sizes in a header are held against the number of bytes before anything is allocated, and samples against the
header's maximum.

Cases: null or undecodable media give null columns (``decode`` itself raises ValueError): that is any wrong or
cut header, an image without pixels, too few bytes, a sample over the maximum or that is no number, and a palette
index or a channel mask that BMP doesn't have. An empty text is stored as one 64-byte row of zeros. Ids may be
null or repeated; other columns, however named, are not looked at; an empty table gives an empty result.
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

from .shared import materialize, texts

ROW = 64  # samples in a row of a stored text
TILE = 256
_GAP = rb"(?:\s|#[^\n]*\n)+"
_BITMAP_HEADER = re.compile(rb"(P[14])" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,9})(?=\s|#)")
_HEADER = re.compile(rb"(P[2356])" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,5})(?=\s|#)")
_PLAIN = re.compile(rb"\d{1,5}")
_BYTE_MASKS = {0xFF << shift: shift // 8 for shift in (0, 8, 16, 24)}


def _enough(data: bytes, start: int, size: int) -> None:
    if start < 0 or start + size > len(data):
        raise ValueError(f"{len(data)} bytes where {start + size} are needed")


def decode_netpbm(data: bytes) -> np.ndarray:
    """Height x width x channels of a plain or raw bitmap, greymap or pixmap; bitmaps come as 0 (black) and 255."""
    kind = data[:2]
    head = (_BITMAP_HEADER if kind in (b"P1", b"P4") else _HEADER).match(data)
    if not head:
        raise ValueError("not a Netpbm header")
    width, height = int(head[2]), int(head[3])
    if not width or not height:
        raise ValueError("an image without pixels")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n, start = width * height * channels, head.end() + 1
    if kind == b"P4":
        stride = (width + 7) // 8
        _enough(data, start, height * stride)
        rows = np.frombuffer(data, np.uint8, height * stride, start).reshape(height, stride)
        return (255 * (1 - np.unpackbits(rows, axis=1)[:, :width]))[:, :, None].astype(np.uint8)
    if kind == b"P1":
        _enough(data, start, n)
        bits = re.sub(rb"#[^\n]*\n|\s", b"", data[head.end() :])[:n]
        if len(bits) < n or bits.strip(b"01"):
            raise ValueError("a short bitmap, or one with other samples than 0 and 1")
        return (255 * (1 - (np.frombuffer(bits, np.uint8) - 48))).reshape(height, width, 1).astype(np.uint8)
    most = int(head[4])
    if not 0 < most < 65536:
        raise ValueError("bad maximum value")
    sample = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    if kind in (b"P5", b"P6"):
        _enough(data, start, n * sample.itemsize)
        values = np.frombuffer(data, sample, n, start)
    else:
        _enough(data, start, 2 * n - 1)  # a digit each and what stands between
        parts = re.sub(rb"#[^\n]*\n", b" ", data[head.end() :]).split()[:n]
        if len(parts) < n or not all(map(_PLAIN.fullmatch, parts)):
            raise ValueError("too few samples, or one that is no number")
        values = np.array(parts, np.int64)
    if values.max() > most:
        raise ValueError("a sample over the maximum")
    return values.astype(sample.newbyteorder("=")).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Height x width x channels (grey for a grey palette, else RGB) of an uncompressed BMP."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP header")
    _enough(data, 0, 54)
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if size < 40 or (packing, depth) not in ((0, 8), (0, 24), (0, 32), (3, 32)) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    _enough(data, start, stride * abs(height))
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        if n > 256 or rows.max() >= n:
            raise ValueError("a palette index out of range")
        _enough(data, 14 + size, 4 * n)
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        image = palette[rows]
        return image[:, :, :1] if (palette == palette[:, :1]).all() else image
    at = [2, 1, 0]
    if packing == 3:
        _enough(data, 54, 12)
        masks = struct.unpack_from("<III", data, 54)
        if len(set(masks)) < 3 or not set(masks) <= set(_BYTE_MASKS):
            raise ValueError("channel masks that are not one byte each")
        at = [_BYTE_MASKS[m] for m in masks]
    return rows.reshape(abs(height), width, depth // 8)[:, :, at]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % grey.shape[1::-1] + np.ascontiguousarray(grey, np.uint8).tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, parts of pixels by their share, from an integral image."""
    h, w = image.shape[:2]
    whole = np.zeros((h + 1, w + 1, image.shape[2]), np.float64)
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=whole[1:, 1:])

    def cut(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.linspace(0, n, parts + 1)
        low = np.minimum(at.astype(np.int64), n - 1)
        share = (at - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - share) + table[low + 1] * share

    lines = cut(whole, h, height)
    corners = cut(lines.transpose(1, 0, 2), w, width).transpose(1, 0, 2)
    return np.diff(np.diff(corners, axis=0), axis=1) / (h / height * (w / width))


def difference_hash(image: np.ndarray, bits: int = 8) -> str:
    """Hex of the signs of horizontal differences over a bits x (bits + 1) grey area resize; near ties are no rise."""
    small = area_resize(image, bits, bits + 1).mean(axis=2)
    return np.packbits(np.diff(small, axis=1).ravel() > 1e-9).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> list[bytes]:
    """The image in row-major tiles of at most tile x tile, each as the bytes of an .npy file."""
    out = []
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            np.save(to := io.BytesIO(), np.ascontiguousarray(image[y : y + tile, x : x + tile]), allow_pickle=False)
            out.append(to.getvalue())
    return out


def untile(tiles: list[bytes], height: int, width: int, tile: int = TILE) -> np.ndarray:
    """The image again from its tiles."""
    parts = [np.load(io.BytesIO(t), allow_pickle=False) for t in tiles]
    across = max(1, -(-width // tile))
    return np.concatenate([np.concatenate(parts[i : i + across], axis=1) for i in range(0, len(parts), across)], axis=0)


def decode_media(df: DataFrame, id_col: str, media_col: str, height: int, width: int, tile: int = TILE) -> DataFrame:
    """(id, height, width, channels, tiles, difference_hash): tiles of the image resized to height x width.

    The first three are the image's own; a row that can't be decoded has nulls but for its id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    small = np.rint(area_resize(image, height, width)).astype(image.dtype)
                    row = (*image.shape, npy_tiles(small, tile), difference_hash(image))
                except ValueError:
                    row = (None,) * 5
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int32()] * 3 + [pa.list_(pa.binary()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["id", "height", "width", "channels", "tiles", "difference_hash"])

    schema = f"id {dict(df.dtypes)[id_col]}, height int, width int, channels int, tiles array<binary>, difference_hash string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(rows, schema)


def pad(text: bytes) -> np.ndarray:
    """Zero bytes up to a positive multiple of ROW, as rows of ROW samples."""
    out = np.zeros(max(1, -(-len(text) // ROW)) * ROW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, ROW)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as the samples of a raw greymap."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in data], pa.int64()), pa.array([encode_pgm(pad(t)) for t in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def tile_table(media: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, height, width, tiles, difference_hash) of stored texts.

    The tiles are those of the whole image, without a change of size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                image = decode(data)
                out.append((len(data), hashlib.sha256(data).hexdigest(), *image.shape[:2], npy_tiles(image, tile), difference_hash(image)))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "height", "width", "tiles", "difference_hash"])

    return media.mapInArrow(rows, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, height int, width int, tiles array<binary>, difference_hash string")


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Texts are stored as greymaps in one table, and these, decoded, as NPY tiles in another; the payload is read
    off the tiles' table; feature is the image's difference hash.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            payloads = [untile(tiles, *hw).tobytes() for tiles, hw in zip(batch.column(6).to_pylist(), size, strict=True)]
            own = [pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-ROW:]) for p in payloads], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, batch.column(2), batch.column(3), batch.column(7)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    tiles = materialize(tile_table(materialize(store_texts(docs), "media")), "tiles")
    return tiles.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
