"""Hashed byte-trigram counts by class, gathered over a whole table into a model of fixed size.

The trigram around every byte of a word (white space counts as one blank, digits as 0) is hashed to one of
``BUCKETS``. Each partition adds up its counts and sends them once, in slices, so what is shuffled is of fixed size for
each partition and what the driver receives is of fixed size for each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm.textblocks import Words, text_blocks

BUCKETS = 1 << 16
SLICE = 1 << 13
_SEEN_AS = np.arange(256, dtype=np.uint32)
_SEEN_AS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_SEEN_AS[0x30:0x3A] = 0x30


def trigrams(words: Words) -> np.ndarray:
    """The bucket of the trigram around each byte; bytes between words belong to none and get ``BUCKETS``."""
    seen = np.concatenate(([np.uint32(0x20)], _SEEN_AS[words.data], [np.uint32(0x20)]))
    code = (seen[:-2] << np.uint32(16)) | (seen[1:-1] << np.uint32(8)) | seen[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    bucket[seen[1:-1] == 0x20] = BUCKETS
    return bucket


def class_counts(rows: DataFrame, n_classes: int, lower: bool, shift: int = 0) -> np.ndarray:
    """Counts (class, bucket) over ``rows(class int, text string)``, with buckets joined 2**``shift`` at a time."""
    buckets = BUCKETS >> shift
    width = min(SLICE, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes, buckets), dtype=np.int64)
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, raw in text_blocks(batch.column(1)):
                words = Words([(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in raw])
                bucket = trigrams(words) >> shift
                of_byte = np.repeat(kind[a:b], np.diff(words.text_start))[: len(bucket)].astype(np.int32)
                inside = bucket < buckets
                code, k = np.unique(of_byte[inside].astype(np.int64) * buckets + bucket[inside], return_counts=True) if n_classes > 64 else (slice(None), np.bincount(of_byte[inside] * buckets + bucket[inside], minlength=n_classes * buckets))
                total.reshape(-1)[code] += k
        if total.any():
            slices = total.reshape(n_classes, -1, width)
            at = [(c, s) for c in range(n_classes) for s in range(slices.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in at], pa.int32()), pa.array([s for _, s in at], pa.int32()), pa.array([slices[x].tobytes() for x in at], pa.binary())], ["class", "slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, s, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                more = np.frombuffer(raw, dtype=np.int64)
                total[c, s] = total[c, s] + more if (c, s) in total else more
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["class", "slice", "counts"])

    schema = "class int, slice int, counts binary"
    summed = rows.mapInArrow(count, schema).repartition("class", "slice").mapInArrow(add, schema)
    out = np.zeros((n_classes, buckets // width, width), dtype=np.int64)
    for row in summed.collect():  # n_classes * buckets numbers, whatever the input
        out[row["class"], row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.reshape(n_classes, buckets)


def log_shares(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Smoothed log shares (class, bucket), with a last column of zeros for bytes outside of words."""
    shares = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1]))
    return np.concatenate((shares, np.zeros((len(counts), 1))), axis=1).astype(np.float32)
