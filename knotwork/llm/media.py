"""Media columns: Netpbm and BMP images decoded to arrays, area-resized tiles, difference hashes.

Decoders read binary Netpbm (P5 grey, P6 colour, 8 bits) and uncompressed BMP (8-bit palette or
24-bit). Resizing averages each target cell's exact source area: with an integral image (a table of running
sums in both directions) the sum over any cell, cut at fractions of pixels, is four lookups interpolated. The
tile is written in NPY format; the difference hash compares neighbouring cells of a 9 x 8 reduction.

Only the table's rows at the borders of target cells are kept; those in between are summed up strip by strip.

An image that cannot be decoded gives null results and is kept as a row. Everything runs row by row in a
scan; no shuffle. Images are taken from a batch about a megabyte at a time and results leave as Arrow buffers; one image is held
a few times over, and a strip of it as floats. Equal images give equal results.

Defined results for texts stored as images (:func:`text_features`): a null or empty text is one block of 255s;
other columns pass through; input columns named like a result are replaced.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from knotwork.llm.textblocks import text_blocks, utf8

WIDTH, UNIT, FILL = 24, 576, 255
STRIP = 1 << 16
BINARY = (BinaryType(), pa.binary())
FEATURES = ["samples", "tile_npy", "dhash"]


def decode_netpbm(raw: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples of a P5 or P6 image."""
    fields, at = [], 2
    if raw[:2] not in (b"P5", b"P6"):
        raise ValueError("neither P5 nor P6")
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, most = fields
    if most > 255:
        raise ValueError("only 8-bit samples")
    shape = (height, width) if raw[1:2] == b"5" else (height, width, 3)
    return np.frombuffer(raw, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def encode_netpbm(image: np.ndarray) -> bytes:
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + image.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """(height, width) for a grey palette, else (height, width, 3) in RGB order."""
    magic, data_at, header, width, height, _, bits, packing = struct.unpack_from("<2s8xIIiiHHI", raw)
    if magic != b"BM" or packing or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), data_at).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1]
    colours = np.frombuffer(raw, np.uint8, (data_at - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    image = colours[rows]
    return image[:, :, 0] if (colours == colours[:, :1]).all() else image


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour."""
    bits = 8 if image.ndim == 2 else 24
    height, width = image.shape[:2]
    rows = image if bits == 8 else image[:, :, ::-1].reshape(height, width * 3)
    stride = (rows.shape[1] + 3) // 4 * 4
    padded = np.zeros((height, stride), np.uint8)
    padded[:, : rows.shape[1]] = rows[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1) * np.array([1, 1, 1, 0], np.uint8) if bits == 8 else np.empty((0, 4), np.uint8)
    at = 54 + palette.size
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + padded.size, 0, 0, at, 40, width, height, 1, bits, 0, padded.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + padded.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def _borders(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For each border between ``cells`` equal cells of 0..n: the whole place before it, and how far beyond that it is."""
    at = np.arange(cells + 1) * n / cells
    low = np.minimum(at.astype(np.int64), n - 1)
    return low, at - low


def _rows_summed(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sums of the first i rows of the integral image's columns for each i of ``wanted`` (ascending)."""
    out = np.zeros((len(wanted), image.shape[1]))
    step, done = max(1, STRIP // image.shape[1]), np.zeros(image.shape[1])
    for begin in range(0, len(image), step):
        strip = image[begin : begin + step]
        table = done + np.cumsum(strip if strip.ndim == 2 else strip.mean(axis=2), axis=0, dtype=np.float64)
        own = slice(*np.searchsorted(wanted, [begin + 1, begin + len(strip) + 1]))
        out[own] = table[wanted[own] - begin - 1]
        done = table[-1]
    return np.cumsum(out, axis=1)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's exact area (float64); colour channels are averaged first."""
    h, w = image.shape[:2]
    if not h or not w:
        return np.zeros((height, width))
    low, part = _borders(h, height)
    wanted = np.unique(np.concatenate((low, low + 1)))
    table = _rows_summed(image, wanted)
    table = table[np.searchsorted(wanted, low)] * (1 - part)[:, None] + table[np.searchsorted(wanted, low + 1)] * part[:, None]
    table = np.concatenate((np.zeros((height + 1, 1)), table), axis=1)
    low, part = _borders(w, width)
    sums = table[:, low] * (1 - part) + table[:, low + 1] * part
    return np.diff(np.diff(sums, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: is a cell darker than its right neighbour?"""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def features(raw: bytes | None, tile: int) -> tuple[bytes | None, bytes | None, str | None]:
    """The decoded samples of an image file, its NPY tile and its difference hash; nulls for what cannot be decoded."""
    try:
        image = decode(raw)
        small = np.clip(np.rint(np.round(area_resize(image, tile, tile), 6)), 0, 255).astype(np.uint8)
        return image.tobytes(), npy(small), difference_hash(image)
    except (ValueError, TypeError, IndexError, struct.error):
        return None, None, None


def _by_row(rows: DataFrame, column: str, names: list[str], of: Callable[[list], Iterator[tuple]]) -> DataFrame:
    """``rows`` with columns ``names``, worked out from ``column`` some rows at a time."""
    types = {"dhash": (StringType(), pa.string())}
    own = rows.drop(*names)
    at = own.columns.index(column)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, values in text_blocks(batch.column(at)):
                found = list(zip(*of(values), strict=True))
                arrays = [pa.array(v, types.get(n, BINARY)[1]) for n, v in zip(names, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, *arrays], names=[*batch.schema.names, *names])

    schema = StructType([*own.schema.fields, *(StructField(n, types.get(n, BINARY)[0]) for n in names)])
    return own.mapInArrow(mapped, schema)


def image_features(images: DataFrame, media_col: str = "media", tile: int = 32) -> DataFrame:
    """``images`` with ``samples`` (the decoded bytes), ``tile_npy`` and ``dhash``."""
    return _by_row(images, media_col, FEATURES, lambda media: (features(raw, tile) for raw in media))


def stored_text(raw: bytes | None, kind: str = "netpbm") -> bytes:
    """An image file of a text's bytes as grey samples, 24 wide, filled up to blocks of 576 by 255."""
    raw = raw or b""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    encode = {"netpbm": encode_netpbm, "bmp": encode_bmp}[kind]
    return encode(np.frombuffer(raw.ljust(size, bytes([FILL])), np.uint8).reshape(-1, WIDTH))


def text_images(docs: DataFrame, text_col: str = "text", kind: str = "netpbm") -> DataFrame:
    """``docs`` with ``media``, the image file of each text's UTF-8 bytes."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return _by_row(docs, text_col, ["media"], lambda texts: ((stored_text(raw, kind),) for raw in utf8(texts)))


def text_features(docs: DataFrame, text_col: str = "text", kind: str = "netpbm", tile: int = 32) -> DataFrame:
    """``docs`` with ``media``, and ``samples``, ``tile_npy`` and ``dhash`` of what is read back from these same bytes."""

    def of(texts: list[str | None]) -> Iterator[tuple]:
        for raw in utf8(texts):
            media = stored_text(raw, kind)
            yield media, *features(media, tile)

    return _by_row(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, ["media", *FEATURES], of)
