"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``virtual`` nodes on a ring, and every row a place on it by a hash of its id and text. A row goes to the first node clockwise from its
place; where that node's shard is full it continues clockwise to the next shard with room. The room is ``(1 + slack)`` times an even share, and with
no slack exactly an even share, so that counts are at most one apart. One more shard takes rows mostly into itself: only rows whose first node changes, and
those that full shards pass on, move.

The ring is cut into ``arcs`` of equal length, whose rows share their first node. Shards fill arc by arc, the arcs in an order by hash, so that
where a row stands on the ring has nothing to do with how early it comes. Only the arcs' counts (a table of fixed size) reach the
driver, which says what runs of an arc's rows each shard takes; an arc that fills a shard is cut there. At most ``arcs + shards`` such runs go back to
the rows by broadcast. Rows know their rank within the arc by a range-partitioned sort of ids, sizes and checksums (no texts) and the sums of its
partitions; no group of rows is ever in one task. Rows alike in id, size and checksum are counted first and are one row until the end.

Defined results: null ids and texts are values like others (a null text has the bytes of an empty one); repeated rows may lie in different shards; with
fewer rows than shards, the first shards hold one each; an empty table gives no rows; other input columns do not pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans.materialize import written
from knotwork.plans.ranking import running_sums

PLACE_BITS = 60
#: Copies of a row that one task writes out at a time.
RUN = 4096


def _place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[: PLACE_BITS // 4], 16)


def clockwise(shards: int, virtual: int, arcs: int) -> np.ndarray:
    """Of each arc the shards in the order in which their first nodes are met from it."""
    nodes: list[list[tuple[int, int]]] = [[] for _ in range(arcs)]
    for place, shard in ((_place(f"{s}:{v}"), s) for s in range(shards) for v in range(virtual)):
        nodes[place * arcs >> PLACE_BITS].append((place, shard))
    met, out = list(range(shards)), np.zeros((arcs, shards), dtype=np.int64)
    for turn in range(2):  # against the clock; the second turn knows what lies beyond the start
        for arc in reversed(range(arcs)):
            for _, shard in sorted(nodes[arc], reverse=True):
                met.remove(shard)
                met.insert(0, shard)
            out[arc] = met
    return out


def rooms(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard takes at most."""
    if slack > 0:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def filled(counts: list[int], order: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(arc, first, end, shard, slot)``: rows ``first`` to ``end - 1`` of an arc go to the shard's places from ``slot`` on."""
    load, runs = [0] * len(room), []
    for arc in sorted(range(len(counts)), key=lambda a: _place(f"arc:{a}")):
        at = 0
        for shard in order[arc].tolist():
            if at == counts[arc]:
                break
            take = min(room[shard] - load[shard], counts[arc] - at)
            if take:
                runs.append((arc, at, at + take, shard, load[shard]))
                load[shard], at = load[shard] + take, at + take
    return runs


def ring_shards(docs: DataFrame, shards: int = 40, virtual: int = 64, arcs: int = 1 << 12, slack: float = 0.0, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, home)`` of every row; ``home`` is the shard that it would be in if none were full.

    ``size``: UTF-8 bytes of the text and ``overhead``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "text_crc32")), 1, PLACE_BITS // 4), 16, 10).cast("long")
    sums = running_sums(rows.withColumn("place", place), ["place", "doc_id", "size", "text_crc32"], {"copies": "before"})
    sums = written(sums.withColumn("arc", F.expr(f"cast(shiftright(place, {PLACE_BITS - (arcs.bit_length() - 1)}) as int)")), "ring")
    held = {r["arc"]: r["k"] for r in sums.groupBy("arc").agg(F.sum("copies").alias("k")).collect()}
    counts = [held.get(a, 0) for a in range(arcs)]
    order = clockwise(shards, virtual, arcs)
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    runs = [(arc, starts[arc] + first, starts[arc] + end, shard, slot, int(order[arc][0])) for arc, first, end, shard, slot in filled(counts, order, rooms(sum(counts), shards, slack))]
    table = F.broadcast(spark.createDataFrame(runs, "arc int, first long, end long, shard int, slot long, home int"))
    single = sums.where("copies = 1").withColumn("rank", F.col("before"))
    many = sums.where("copies > 1").withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {RUN}L)"))).repartition("doc_id", "text_crc32", "from")
    copied = many.withColumn("rank", F.explode(F.expr(f"sequence(before + `from`, before + least(copies, `from` + {RUN}) - 1)"))).drop("from")
    ranked = single.unionByName(copied)
    within = (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["end"])
    found = ranked.join(table, (ranked["arc"] == table["arc"]) & within)
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"), "home")
