"""Words and word-sequence hashes of many texts at once, as numpy arrays.

A *word* is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 this is the pattern
``[^\\x20\\x09-\\x0D]+`` on characters. Hashes are polynomials modulo 2**64 over random byte
values, finished by a 64-bit mixer, so that equal words and word sequences get equal values in every
process and at every place of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64."""
    key = int(base)
    if key not in _tables or len(_tables[key][0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        inverse = np.uint64(pow(key, -1, 1 << 64))
        both = []
        for b in (base, inverse):
            factors = np.full(size, b, dtype=np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        _tables[key] = (both[0], both[1])
    power, inverse_power = _tables[key]
    return power[:n], inverse_power[:n]


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together (a longer text stands alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """The words of consecutive texts: byte bounds, hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.joined = b" ".join(t or b"" for t in texts)
        data = np.frombuffer(self.joined, dtype=np.uint8)
        if lower:
            data = _LOWER[data]
        self.data = data
        inside = ~_IS_SPACE[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        lengths = np.array([len(t) + 1 if t else 1 for t in texts], dtype=np.int64)
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        power, inverse = _powers(_BASE, len(self.data))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE_VALUE[self.data] * power, dtype=np.uint64)))
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


class Prefix:
    """Prefix sums over a sequence of hashes, from which any run's hash follows."""

    def __init__(self, hashes: np.ndarray):
        power, self.inverse = _powers(_GRAM_BASE, max(1, len(hashes)))
        self.total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, end), which must not be empty; equal runs, equal values."""
        raw = (self.total[end] - self.total[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def concat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The integers of the ranges [start, start + length), one range after another."""
    if not len(start) or not length.sum():
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of a text column as ``blocks`` makes them, with their texts; only one range is held as Python strings."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > limit:
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(column):
        yield begin, len(column), column.slice(begin).to_pylist()


def utf8(texts: list[str | None]) -> list[bytes | None]:
    return [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows (but for row 0) whose key differs from that of the row before."""
    differ = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for key in keys:
        differ |= np.diff(table.column(key).to_numpy()) != 0
    return np.flatnonzero(differ) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, in tables cut only between groups of equal keys."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept and any(kept[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(kept).combine_chunks()
            kept = []
        change = changes(table, keys)
        if len(change):
            yield pa.concat_tables([*kept, table.slice(0, int(change[-1]))]).combine_chunks()
            kept = [table.slice(int(change[-1]))]
        else:
            kept.append(table)
    if kept:
        yield pa.concat_tables(kept).combine_chunks()
