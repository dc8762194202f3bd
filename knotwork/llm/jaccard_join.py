"""Exact Jaccard join on word shingles, filtered under several global token orders.

A document's set holds the hashes of its distinct shingles (words lower-cased in A-Z). Two sets of
similarity ``t`` or more share a token among the first ``n - ceil(t n) + 1`` of each, *whatever* the
order of tokens. So every set's prefixes under all orders are written once, by set. The first order is an index: sets that meet at a
token are candidates. The other orders' prefixes are then looked up by set, and only candidates that share a prefix token under each of them
too are left: the filters are intersected on keys and prefixes, before any text of a candidate is read. The first order puts
tokens last that many documents hold, going by counters over all documents (a fixed number of
counters, which collide harmlessly: any order gives the same links); within a level, and in the other
orders, tokens are ordered by different hashes. Prefixes of the other orders are kept as 16-bit values, with the place where they end, and
must share not one token but as many as the similarity asks for, given how many tokens come after them (:func:`_enough_shared`): documents that share a passage fall here, long ones too.

Groups of copies cost few pairs. Equal sets are one class. Each token's documents are first
compared with ``CENTRES`` of them only; the links found are contracted to components; then just those pairs
of a token's documents remain that still lie in different components. Before the prefixes, most fall to a bound from
bitmaps: every set folds its tokens into 512 bits by parity, and as many bits as differ between two
bitmaps, so many tokens at least are in one set only. What is left is compared exactly, so the components are those of
all links. Links inside a component are not all looked for: neither pairs nor each document's number of links can be had
from the results.

Skew: equal sets are dropped within each partition before the shuffle; tokens with many holders are
salted, by the same counters; where many components meet at a token, their sets are dealt to a grid of cells of bounded size. For the exact
comparison a set's text travels once to each block of its candidates, not once for each pair.

Defined results: null text, or one without words: empty set, component is its own id; fewer words than
``size``: the sequence is its only shingle; a null id links nothing and has a null component; rows
with one id are separate documents whose components are named alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.textblocks import Prefix, Words, changes, mix, text_blocks, utf8, whole_groups
from knotwork.operators.components import connected_components
from knotwork.plans.materialize import dropped, written

COUNTER_BITS = 21
SLICES = 64
CENTRES = 8
BITMAP_LONGS = 8
_SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC3A5C85C97CB3127)
CELL = 1_024
ASKED_BUCKETS = 1 << 26
#: Buckets whose bits are in one row of a map; ``bitmap_construct_agg`` holds so many.
MAP_BITS = 15
_SETS = "doc_id long, text_key long, set_key long, n int, bits array<long>, second array<smallint>, third array<smallint>, second_end long, third_end long, slice int, counters binary"
#: What travels with a set for the filters under the second and third order.
_LATER = ("second", "third", "second_end", "third_end")
_PREFIX = "token long, salt int, set_key long, n int, pos int"
_MET = "token long, set_key long, n int, pos int, a long, b long"


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words = Words(texts, lower=True)
    prefix = Prefix(words.hashes())
    n = len(words.start)
    at = np.arange(max(0, n - size + 1))
    grams = prefix.runs(at, at + size) if len(at) else np.empty(0, dtype=np.uint64)
    out = []
    for first, count in zip(words.first.tolist(), words.count.tolist(), strict=False):
        if count >= size:
            out.append(np.unique(grams[first : first + count - size + 1]))
        elif count:
            out.append(prefix.runs(np.array([first]), np.array([first + count])))
        else:
            out.append(grams[:0])
    return out


def set_key(tokens: np.ndarray) -> int:
    """One value for equal sets; 0 is never a key."""
    total = mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64))
    return int(total.view(np.int64)[0]) or 1


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITMAP_LONGS int64: for each of their bits, whether an odd number of tokens falls on it."""
    bits = BITMAP_LONGS * 64
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def order_prefix(tokens: np.ndarray, seed: int, percent: int) -> tuple[np.ndarray, int]:
    """The first tokens of a set under the order that ``seed`` gives, as 16-bit values, each once; and where they end in that order (63 bits of it)."""
    order = mix(tokens ^ np.uint64(seed))
    length = prefix_length(len(tokens), percent)
    first = order if length == len(order) else np.partition(order, length - 1)[:length]
    return np.unique(first.astype(np.uint16)).view(np.int16), int(first.max() >> np.uint64(1))


def _lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = [0 if v is None else len(v) for v in values]
    flat = np.concatenate([np.empty(0, kind.to_pandas_dtype()), *(v for v in values if v is not None)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, kind), mask=pa.array([v is None for v in values]))


def _sets(size: int, percent: int):
    """Each document's set key, size and bitmap, a new set's prefixes, and at the end the partition's token counters."""
    lists = [("bits", pa.list_(pa.int64())), ("second", pa.list_(pa.int16())), ("third", pa.list_(pa.int16()))]
    ends = [("second_end", pa.int64()), ("third_end", pa.int64())]
    kinds = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.int64()), ("n", pa.int32()), *lists, *ends, ("slice", pa.int32()), ("counters", pa.binary())]
    schema = pa.schema(kinds)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(1 << COUNTER_BITS, dtype=np.int64), set()
        for batch in batches:
            for begin, end, texts in text_blocks(batch.column(2)):
                keys, sizes, fresh = [], [], []
                bitmaps: list[np.ndarray | None] = []
                prefixes: list[list[np.ndarray | None]] = [[], []]
                prefix_ends: list[list[int | None]] = [[], []]
                for tokens in shingle_sets(utf8(texts), size):
                    key = set_key(tokens) if len(tokens) else 0
                    new = key != 0 and key not in seen
                    keys.append(key)
                    sizes.append(len(tokens))
                    bitmaps.append(parity_bitmap(tokens) if new else None)
                    for own, own_ends, seed in zip(prefixes, prefix_ends, _SEEDS[1:], strict=True):
                        first, last = order_prefix(tokens, seed, percent) if new else (None, None)
                        own.append(first)
                        own_ends.append(last)
                    if new:
                        seen.add(key)
                        fresh.append(tokens)
                if fresh:
                    np.add.at(counters, (np.concatenate(fresh) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
                own_rows = batch.slice(begin, end - begin)
                lists = [_lists(bitmaps, pa.int64()), *(_lists(p, pa.int16()) for p in prefixes), *(pa.array(e, pa.int64()) for e in prefix_ends)]
                yield pa.RecordBatch.from_arrays([own_rows.column(0), own_rows.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), *lists, pa.nulls(end - begin, pa.int32()), pa.nulls(end - begin, pa.binary())], schema=schema)
        if counters.any():
            cut = np.minimum(counters, (1 << 16) - 1).astype(np.uint16).reshape(SLICES, -1)
            none = [pa.nulls(SLICES, kind) for _, kind in kinds[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], schema=schema)

    return of


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(raw, dtype=np.uint16).astype(np.uint64)
            total[at] = total[at] + more if at in total else more
    sums = [np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums, pa.binary())], ["slice", "counters"])


def _prefixes(size: int, percent: int, tables):
    """Each distinct set's prefix under the first order, with places and salts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, salts = tables.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0)):
                token, key, n, pos = [], [], [], []
                for tokens in shingle_sets(utf8(texts), size):
                    if not len(tokens) or (own := set_key(tokens)) in seen:
                        continue
                    seen.add(own)
                    length = prefix_length(len(tokens), percent)
                    first = tokens[np.argsort(_first_order(tokens, level))[:length]]
                    token.append(first)
                    key.append(own)
                    n.append(len(tokens))
                    pos.append(np.arange(length, dtype=np.int32))
                if token:
                    sizes = [len(x) for x in token]
                    token = np.concatenate(token)
                    key, n = np.repeat(np.array(key, dtype=np.int64), sizes), np.repeat(np.array(n, dtype=np.int32), sizes)
                    parts = salts[(token >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    salt = np.where(parts > 1, (key.view(np.uint64) % parts.astype(np.uint64)).astype(np.int32) + 1, 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(key), pa.array(n), pa.array(np.concatenate(pos))], ["token", "salt", "set_key", "n", "pos"])

    return of


def _first_order(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    return level[at].astype(np.uint64) << np.uint64(58) | mix(tokens ^ np.uint64(_SEEDS[0])) >> np.uint64(6)


def _met(percent: int):
    """Per token and salt: pairs of its first CENTRES sets with the others; and the rows, where these are not all pairs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["token", "salt"]):
            own = np.concatenate(([0], changes(table, ["token", "salt", "set_key"])))
            token, salt, key, n, pos = (table.column(c).to_numpy()[own] for c in ("token", "salt", "set_key", "n", "pos"))
            first = np.flatnonzero(np.concatenate(([True], (np.diff(token) != 0) | (np.diff(salt) != 0))))
            count = np.diff(np.concatenate((first, [len(token)])))
            first, count = np.repeat(first, count), np.repeat(count, count)
            place = np.arange(len(token)) - first
            keep = np.flatnonzero((count > CENTRES) | (salt > 0))
            if len(keep):
                none = pa.nulls(len(keep), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (token, key, n, pos)), none, none], names=["token", "set_key", "n", "pos", "a", "b"])
            pairs = []
            for centre in range(min(CENTRES, int(count.max()) - 1)):
                y = np.flatnonzero(place > centre)
                x = first[y] + centre
                small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                least = ((small + large) * percent + 99 + percent) // (100 + percent)
                good = (100 * small >= percent * large) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least)
                pairs.append(np.stack((np.minimum(key[x], key[y])[good], np.maximum(key[x], key[y])[good]), axis=1))
            if pairs and len(pairs := np.unique(np.concatenate(pairs), axis=0)):
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), none.cast(pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["token", "set_key", "n", "pos", "a", "b"])

    return of


def _similar(size: int, percent: int):
    """Rows sorted by (a, part), where b is null for the text of ``a`` itself: the pairs whose sets are similar."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set = None, None
        for batch in batches:
            for begin, end, texts in text_blocks(batch.column(3)):
                a_key, b_key = (batch.column(i).slice(begin, end - begin).to_pylist() for i in (0, 2))
                found = []
                for a, b, own in zip(a_key, b_key, shingle_sets(utf8(texts), size), strict=True):
                    if b is None:
                        centre, centre_set = a, own
                    elif a == centre:
                        shared = len(np.intersect1d(centre_set, own, assume_unique=True))
                        if 100 * shared >= percent * (len(centre_set) + len(own) - shared):
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return of


def _possible(x: str, y: str, percent: int):
    """Sizes, places of a shared token, and bitmaps that allow the similarity, for rows with prefixes ``x`` and ``y``."""
    n_x, n_y, bits_x, bits_y = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}bits"), F.col(f"{y}bits")
    least = F.floor(((n_x + n_y) * percent + 99 + percent) / (100 + percent))
    most = F.least(n_x - F.col(f"{x}pos"), n_y - F.col(f"{y}pos"))
    differ = reduce(Column.__add__, (F.bit_count(bits_x[i].bitwiseXOR(bits_y[i])) for i in range(BITMAP_LONGS)))
    return (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent) & (most >= least) & (n_x + n_y - differ >= 2 * least)


def _enough_shared(order: str, percent: int) -> Column:
    """Whether the prefixes of ``a`` and ``b`` under an order share as many tokens as sets of the similarity must.

    Up to where the first of both prefixes ends, every shared token is in both prefixes; beyond, that set has only its other tokens to
    share. Tokens of a prefix that have one 16-bit value are counted once, so as many may be missing from the shared values as one
    of the prefixes lost; values that meet by chance only add.
    """
    n = {x: F.col(f"{x}_n").cast("long") for x in "ab"}
    later = {x: F.floor((n[x] * percent + 99) / 100) - 1 for x in "ab"}
    lost = F.least(*(n[x] - later[x] - F.size(f"{x}_{order}") for x in "ab"))
    a_end, b_end = F.col(f"a_{order}_end"), F.col(f"b_{order}_end")
    beyond = F.when(a_end < b_end, later["a"]).when(b_end < a_end, later["b"]).otherwise(F.greatest(later["a"], later["b"]))
    least = F.floor(((n["a"] + n["b"]) * percent + 99 + percent) / (100 + percent))
    return F.size(F.array_intersect(f"a_{order}", f"b_{order}")) >= F.greatest(F.lit(1), least - beyond - lost)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, hot_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Links are pairs with ``100 * intersection >= percent * union``. Tokens that counters put at over
    ``hot_rows`` holders are salted.
    """
    labelled = similarity_groups(docs, id_col, text_col, size, percent, hot_rows)
    named = written(labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "names")
    return labelled.join(named, "label", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, hot_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (``xxhash64`` of the text), n_shingles, and the label of its group (null without shingles)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    first_pass = written(source.mapInArrow(_sets(size, percent), _SETS), "sets")
    sets = first_pass.where("slice is null").select("doc_id", "text_key", "set_key", F.col("n").cast("long").alias("n_shingles"))
    summed = first_pass.where("slice is not null").select("slice", "counters").repartition("slice").mapInArrow(_add_counters, "slice int, counters binary")
    counters = np.zeros((SLICES, (1 << COUNTER_BITS) // SLICES), dtype=np.uint32)
    for row in summed.collect():  # of fixed size, whatever the input
        counters[row["slice"]] = np.frombuffer(row["counters"], dtype=np.uint32)
    counters = counters.ravel()
    usual = max(1.0, counters.mean())
    level = np.clip(np.floor(4 * np.log2(np.maximum(counters, 1) / usual)), 0, 63).astype(np.uint8)
    hot = max(hot_rows, 4 * usual)
    tables = spark.sparkContext.broadcast((level, np.minimum(np.ceil(np.maximum(counters, 1) / hot), (1 << 16) - 1).astype(np.uint16)))

    prefixes = source.where("text is not null").select("text").mapInArrow(_prefixes(size, percent, tables), _PREFIX)
    met = written(prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "set_key").mapInArrow(_met(percent), _MET), "met")
    shingled = first_pass.where("slice is null and n > 0 and doc_id is not null")
    named = shingled.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"))
    first_seen = first_pass.where("bits is not null").select("set_key", "n", "bits", *_LATER)
    kept = first_seen.groupBy("set_key").agg(*(F.first(c).alias(c) for c in ("n", "bits", *_LATER)))
    reps = written(named.select("set_key", "rep.doc_id", "rep.text_key").join(kept, "set_key"), "reps")
    sets = written(sets, "sets")
    dropped(first_pass)
    tried = written(met.where("a is not null").select("a", "b").distinct(), "pairs")
    links = _verified(source, tried, reps, size, percent)
    parts = connected_components(links, "a", "b")
    rest = written(_across(met.where("a is null"), parts, reps, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    dropped(met, tried)
    more = None
    if not rest.isEmpty():
        more = _verified(source, rest, reps, size, percent)
        parts = connected_components(links.unionByName(more), "a", "b")

    labelled = sets.join(parts.withColumnRenamed("id", "set_key"), "set_key", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_key")).alias("label"))
    labelled = written(labelled, "labels")
    dropped(reps, rest, links, more, sets)
    return labelled


def _across(met: DataFrame, parts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs of a token's sets in different components, as far as sizes, places and bitmaps let them pass.

    Of a token's components the largest is not compared with itself. Its ``k`` sets, and the ``s`` outside of the largest component, are
    dealt to a grid of cells of about CELL by CELL.
    """
    rows = met.join(parts.withColumnRenamed("id", "set_key"), "set_key", "left").select("token", "set_key", "n", "pos", F.coalesce("component", "set_key").alias("part"))
    rows = written(rows, "met")
    sizes = rows.groupBy("token", "part").agg(F.count("*").alias("k"))
    several = sizes.groupBy("token").agg(F.max(F.struct("k", "part")).alias("main"), F.sum("k").alias("k"), F.count("*").alias("parts")).where("parts > 1")
    several = several.select("token", F.col("main.part").alias("main"), F.ceil(F.col("k") / CELL).cast("int").alias("high"), F.ceil((F.col("k") - F.col("main.k")) / CELL).cast("int").alias("wide"))
    several = written(several, "tokens")  # read back, so that Spark may split a hot token's rows at the join
    rows = written(rows.join(several, "token").join(reps.select("set_key", "bits"), "set_key"), "across")
    small = rows.where("part <> main").withColumn("x", F.pmod(F.xxhash64("set_key"), "wide")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("high") - 1)))
    small = small.select("token", "x", "y", *(F.col(c).alias(f"x_{c}") for c in ("set_key", "n", "pos", "part", "bits")))
    large = rows.withColumn("y", F.pmod(F.xxhash64("set_key"), "high")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    once = (F.col("part") == F.col("main")) | (F.col("x_set_key") < F.col("set_key"))
    pairs = large.join(small, ["token", "x", "y"]).where((F.col("part") != F.col("x_part")) & once & _possible("", "x_", percent))
    return pairs.select(F.least("set_key", "x_set_key").alias("a"), F.greatest("set_key", "x_set_key").alias("b")).distinct()


def apart_by_buckets(rows: DataFrame, asked: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``keys`` some row of ``asked`` may have, for an exact join to follow, and those whose ``keys`` none has; no row travels for it.

    What is broadcast is a bit for each bucket of the asked keys: ASKED_BUCKETS bits (8 MB) at most, whatever the input.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(ASKED_BUCKETS))
    split = {"__map": F.shiftright(bucket, MAP_BITS), "__place": bucket.bitwiseAND((1 << MAP_BITS) - 1)}
    maps = asked.select(*(c.alias(name) for name, c in split.items())).groupBy(F.col("__map").alias("__own")).agg(F.bitmap_construct_agg("__place").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = (F.col("__map") == F.col("__own")) & (F.getbit(byte, F.col("__place").bitwiseAND(7)) == 1)
    may, cannot = (rows.withColumns(split).join(F.broadcast(maps), held, how).drop(*split) for how in ("left_semi", "left_anti"))
    return may, cannot


def _in_buckets_of(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    return apart_by_buckets(rows, asked, key)[0]


def _candidates(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that pass every filter; sizes and bitmaps first, then the prefixes of the other orders.

    Sets that no pair names are left out before the four joins.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("set_key"))
    reps = written(_in_buckets_of(reps.drop("doc_id", "text_key"), named, "set_key"), "named")
    for columns in (("n", "bits"), ("n", *_LATER)):
        for side in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("set_key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
        if "bits" in columns:
            pairs = pairs.withColumns({"a_pos": F.lit(0), "b_pos": F.lit(0)}).where(_possible("a_", "b_", percent))
        else:
            pairs = pairs.where(_enough_shared("second", percent) & _enough_shared("third", percent))
        pairs = pairs.select("a", "b")
    found = written(pairs, "candidates")
    dropped(reps)
    return found


def _verified(source: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = _candidates(pairs, reps, percent)
    texts = source.where("doc_id is not null")
    blocks_of = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    pairs = pairs.join(blocks_of, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    centres = pairs.select("a", "part", F.lit(None).cast("long").alias("b")).distinct()
    asked = pairs.unionByName(centres).withColumn("set_key", F.coalesce("b", "a"))
    asked = written(asked.join(reps.select("set_key", "doc_id", "text_key"), "set_key").drop("set_key"), "asked")
    asked = asked.join(_in_buckets_of(texts, asked, "text_key"), ["doc_id", "text_key"]).select("a", "part", "b", "text")
    # A repeated row of the table gives its text several times, and a pair with it.
    grouped = asked.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(grouped.mapInArrow(_similar(size, percent), "a long, b long").distinct(), "links")
