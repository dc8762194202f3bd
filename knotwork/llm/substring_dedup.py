"""Substring dedup by relative Lempel-Ziv parsing against reference blocks spread over the cluster.

The reference is cut into blocks by *anchors*: of each window of ``window`` consecutive words, the smallest hash among its
short word sequences (leftmost on ties). Equal windows have equal anchors, and consecutive windows mostly share one, so a
run of windows travels as one row: anchor, document, first word, and six hash bytes for each window. All rows of an anchor are one reference
block, in the order of their ids.

Within a block every row is factored greedily against the rows of smaller ids. At a window, the index of the block names the
first place with the same window; from there the factor is extended word by word (so many windows on) as far as both rows go on alike. A factor
is (place in the document, place in the reference, length). The words that end a factor may begin another one, so the parse goes on at the first window
that crosses its border, and not behind it: no repeated window is lost between two factors.
Factors of ``window`` words or more are the duplicate spans. Hashes only find them: a digest (128 bits) of the words that a factor refers to, from border to
border, is taken where that text is, and a span is removed only if its own words have the same digest.

Skew: anchors with more than ``block_rows`` rows are split by document into salted blocks of about that many rows, whatever the size
of the table. A salted block settles what repeats within it, and passes on one row for each of its distinct windows and the
document that holds it first, with all its places there; these meet once more by anchor and window, at most
one document for each salt. No block grows with a hot passage, and no row is dropped.

Defined results: a null text has no words and stays null; a text without words stays as it is with
zero counts; rows with a null id lose nothing and cause no removal; repeated ids never remove each
other's words (only a *smaller* id does); a repeated row is judged like its twin; an empty table gives
an empty result. Other columns pass through; input columns named like a result are replaced. Nothing is removed on a hash alone; a repeat is
missed only where a window of other words and a smaller id has the same anchor and the same 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.textblocks import BLOCK_BYTES, Prefix, Words, changes, concat_ranges, mix, sliding_min, text_blocks, utf8, whole_groups
from knotwork.plans.materialize import written

HASH_BYTES = 6
_ORDER_BITS = np.uint64(31)
_RUNS = "anchor long, doc_id long, text_key long, start int, windows binary"
_FOUND = "doc_id long, text_key long, start int, end int, ref_id long, ref_key long, ref_start int, anchor long, seen long, places array<int>"
_SPAN = ["doc_id", "text_key", "start", "end", "ref_id", "ref_key", "ref_start"]
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_GROUP = ["anchor", "salt"]


def window_runs(words: Words, window: int, gram: int):
    """Per run of windows with one anchor: text, anchor, first word in it, number of windows; and the windows' hashes."""
    texts_with = np.flatnonzero(words.count >= window)
    none = np.empty(0, dtype=np.int64)
    if not len(texts_with):
        return none, none, none, none, np.empty(0, dtype=np.uint64)
    prefix = Prefix(words.hashes())
    at = np.arange(len(words.start) - gram + 1)
    grams = prefix.runs(at, at + gram)
    ranked = (grams >> _ORDER_BITS << _ORDER_BITS) | at.astype(np.uint64)
    best = sliding_min(ranked, window - gram + 1)
    anchor_at = (best & ((np.uint64(1) << _ORDER_BITS) - np.uint64(1))).astype(np.int64)
    n_windows = words.count[texts_with] - window + 1
    start = concat_ranges(words.first[texts_with], n_windows)
    text = np.repeat(texts_with, n_windows)
    anchor_at = anchor_at[start]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor_at) != 0) | (np.diff(text) != 0))))
    size = np.diff(np.concatenate((first, [len(start)])))
    return text[first], grams[anchor_at[first]].view(np.int64), start[first] - words.first[text[first]], size, prefix.runs(start, start + window)


def _runs(window: int, gram: int, anchors_only: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, texts in text_blocks(batch.column(2)):
                text, anchor, start, size, hashes = window_runs(Words(utf8(texts)), window, gram)
                if anchors_only:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                    continue
                cut = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                ends = np.concatenate(([0], np.cumsum(size) * HASH_BYTES)).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(cut)])
                columns = [pa.array(anchor), pa.array(ids[a:b][text], pa.int64()), pa.array(keys[a:b][text], pa.int64()), pa.array(start, pa.int32()), packed]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "text_key", "start", "windows"])

    return of


def _match(window: int):
    """In each reference block: factors of at least ``window`` words, and what salted blocks pass on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _GROUP):
            group = np.zeros(table.num_rows, dtype=np.int64)
            group[changes(table, _GROUP)] = 1
            group = np.cumsum(group)
            rows = np.flatnonzero((np.bincount(group)[group] > 1) | table.column("salted").to_numpy())
            size = np.cumsum(pc.binary_length(table.column("windows")).to_numpy()[rows].astype(np.int64))
            begin = 0
            while begin < len(rows):  # about a megabyte of hashes at a time, cut only between groups
                end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BLOCK_BYTES)) + 1
                end = int(np.searchsorted(group[rows], group[rows[min(end, len(rows)) - 1]], side="right"))
                yield from _match_rows(window, group[rows[begin:end]], table.take(pa.array(rows[begin:end])))
                begin = end

    return of


def _match_rows(window: int, group: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
    doc, key, start, anchor, salted = (table.column(c).to_numpy() for c in ("doc_id", "text_key", "start", "anchor", "salted"))
    block = Block(group, doc, table.column("windows").combine_chunks())
    row, at, windows, ref_row, ref_at = block.factors()
    if len(row):
        begin, none = start[row] + at, pa.nulls(len(row), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(key[row]), pa.array(begin, pa.int32()), pa.array(begin + windows + window - 1, pa.int32()), pa.array(doc[ref_row]), pa.array(key[ref_row]),
             pa.array(start[ref_row] + ref_at, pa.int32()), none, none, pa.nulls(len(row), pa.list_(pa.int32()))], names=_NAMES,
        )
    own = block.order[(~block.hit & salted[block.row])[block.order]]
    if len(own):
        # One row for each window that no smaller id of the block holds, and each text with that id: all its places there.
        row = block.row[own]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(block.ref[own]) != 0) | (np.diff(key[row]) != 0))))
        places = pa.ListArray.from_arrays(pa.array(np.append(new, len(own)), pa.int32()), pa.array((start[row] + block.at[own]).astype(np.int32)))
        none = pa.nulls(len(new), pa.int32())
        wide = none.cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[row[new]]), pa.array(key[row[new]]), none, none, wide, wide, none, pa.array(anchor[row[new]]), pa.array(block.hashes[own[new]].view(np.int64)), places], names=_NAMES)


class Block:
    """Rows of some reference blocks, in order of group and id, and an index of their windows.

    ``row`` and ``at`` say where each window is; ``ref`` is the first window of its group with the same hash; ``hit``, whether that one
    belongs to a smaller id; ``order`` puts windows with the same hash together, the first first.
    """

    def __init__(self, group: np.ndarray, doc: np.ndarray, windows: pa.Array):
        offsets = np.frombuffer(windows.buffers()[1], dtype=np.int32)[windows.offset : windows.offset + len(windows) + 1].astype(np.int64)
        raw = np.frombuffer(windows.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, HASH_BYTES)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :HASH_BYTES] = raw
        self.hashes = wide.view(np.uint64).ravel()
        n = np.diff(offsets) // HASH_BYTES
        self.row = np.repeat(np.arange(len(n)), n)
        self.last = np.cumsum(n)
        self.first = self.last - n
        self.at = np.arange(len(self.row)) - self.first[self.row]
        name = mix(self.hashes + (group[self.row].astype(np.uint64) << np.uint64(48)) + (group[self.row] >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.order = np.argsort(name, kind="stable")
        new = np.concatenate(([True], np.diff(name[self.order]) != 0))
        self.ref = np.empty(len(name), dtype=np.int64)
        self.ref[self.order] = self.order[np.flatnonzero(new)][np.cumsum(new) - 1]
        self.hit = doc[self.row] > doc[self.row[self.ref]]
        self.prefix = Prefix(self.hashes)

    def factors(self) -> tuple[np.ndarray, ...]:
        """Greedy factors as (row, first window in it, windows, row referred to, first window in that)."""
        n = len(self.row)
        onward = np.where(self.hit, np.arange(n), n)
        onward = np.append(np.minimum.accumulate(onward[::-1])[::-1], n)  # the next repeated window from each
        p = onward[self.first]
        p = p[p < self.last]
        found = []
        while len(p):  # one factor of every row at a time
            r = self.ref[p]
            most = np.minimum(self.last[self.row[p]] - p, self.last[self.row[r]] - r)
            windows = self._alike(p, r, most)
            found.append(np.stack((self.row[p], self.at[p], windows, self.row[r], self.at[r])))
            row, p = self.row[p], onward[p + windows]
            p = p[p < self.last[row]]
        return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, dtype=np.int64),) * 5

    def _alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many windows, one at least and up to ``most``, the sequences from ``a`` and ``b`` have in common at their start."""
        low, high = np.ones(len(a), dtype=np.int64), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.prefix.runs(a[open_], a[open_] + middle) == self.prefix.runs(b[open_], b[open_] + middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def find_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 12, block_rows: int = 2_000) -> DataFrame:
    """Word spans [start, end) of a document (doc_id, text_key) whose windows have the hashes of those from word ``ref_start`` of (ref_id, ref_key).

    ``gram`` sets the length of anchors (any value up to ``window`` gives the same covered words). Anchors
    with more than ``block_rows`` rows are salted.
    """
    source = _keyed(docs, id_col, text_col)
    heavy = written(source.mapInArrow(_runs(window, gram, True), "anchor long").groupBy("anchor").agg(F.count("*").alias("rows")).where(F.col("rows") > block_rows), "heavy-anchors")
    runs = source.mapInArrow(_runs(window, gram, False), _RUNS)
    salts = F.ceil(F.col("rows") / block_rows).cast("long")
    runs = runs.join(heavy, "anchor", "left").select(
        "anchor",
        F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("doc_id", "text_key"), salts)).otherwise(F.lit(0)).cast("int").alias("salt"),
        F.col("rows").isNotNull().alias("salted"), "doc_id", "text_key", "start", "windows",
    )
    found = written(runs.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "doc_id", "text_key", "start").mapInArrow(_match(window), _FOUND), "factors")
    least = F.min(F.struct("doc_id", "text_key", F.col("places")[0].alias("place"))).over(Window.partitionBy("anchor", "seen"))
    across = found.where("seen is not null").withColumn("least", least).where(F.col("doc_id") > F.col("least.doc_id")).withColumn("start", F.explode("places"))
    across = across.select("doc_id", "text_key", "start", (F.col("start") + window).alias("end"), F.col("least.doc_id").alias("ref_id"), F.col("least.text_key").alias("ref_key"), F.col("least.place").alias("ref_start"))
    return found.where("seen is null").select(_SPAN).unionByName(across)


def _digest(words: list[bytes], start: int, end: int) -> bytes:
    return blake2b(b" ".join(words[start:end]), digest_size=16).digest()


def _digests(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Of each text the digests of its word spans."""
    out = []
    for a, b, some in text_blocks(texts):
        for text, own in zip(some, spans.slice(a, b - a).to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            out.append([{**s, "digest": _digest(words, s["ref_start"], s["ref_start"] + s["length"])} for s in own])
    return pa.array(out, pa.list_(pa.struct([("ref_start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())])))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """:func:`find_factors` with ``digest``, that of the words referred to."""
    factors = written(find_factors(docs, id_col, text_col, **options).withColumn("length", F.col("end") - F.col("start")), "spans")
    place = ["ref_id", "ref_key", "ref_start", "length"]
    asked = factors.groupBy("ref_id", "ref_key").agg(F.collect_set(F.struct("ref_start", "length")).alias("spans"))
    held = asked.join(_keyed(docs, id_col, text_col), (F.col("ref_id") == F.col("doc_id")) & (F.col("ref_key") == F.col("text_key")))
    digests = F.arrow_udf(_digests, "array<struct<ref_start:int,length:int,digest:binary>>").asNondeterministic()
    held = held.select("ref_id", "ref_key", F.explode(digests("text", "spans")).alias("s")).select("ref_id", "ref_key", "s.*")
    held = written(held.groupBy(*place).agg(F.first("digest").alias("digest")), "digests")
    return factors.join(held, place).select(*_SPAN, "digest")


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n_words, n_removed, kept_texts = [], [], []
    for a, b, some in text_blocks(texts):
        kept_of_block = []
        for text, covered in zip(some, spans.slice(a, b - a).to_pylist(), strict=True):
            words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if covered:
                kept, done = [], 0
                for start, end in sorted((s["start"], s["end"]) for s in covered if _digest(words, s["start"], s["end"]) == s["digest"]):
                    if start > done:
                        kept += words[done:start]
                    done = max(done, end)
                words = kept + words[done:]
            n_removed.append(n_words[-1] - len(words))
            kept_of_block.append(None if text is None else b" ".join(words))
        kept_texts.append(pa.array(kept_of_block, pa.binary()).cast(pa.string()))
    kept_text = pa.concat_arrays(kept_texts) if kept_texts else pa.array([], pa.string())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept_text], ["n_words", "n_removed", "kept_text"])


def remove_duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space)."""
    results = ["n_words", "n_removed", "kept_text"]
    spans = duplicate_spans(docs, id_col, text_col, **options).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", "digest")).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__spans")
    own = docs.drop(*results)
    # So marked, it runs once for each row: a filter on its results would else run it again.
    without = F.arrow_udf(_without, "n_words long, n_removed long, kept_text string").asNondeterministic()
    found = own.join(spans.hint("shuffle_hash"), (own[id_col].cast("long") == spans["__id"]) & (F.xxhash64(own[text_col]) == spans["__key"]), "left")
    return found.select(*own.columns, without(F.col(text_col).cast("string"), F.col("__spans")).alias("__out")).select(*own.columns, *(F.col(f"__out.{c}").alias(c) for c in results))
