"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source queues its documents in a shuffled order (MD5 of a seed and the id; ties by id and size), three times in
a row at most (``max_repeats``). A document's virtual finish time is the number of words its source
has sent with it, divided by the source's weight. The mix takes documents by finish time until the
total budget is used up; a source that has sent all its repeats stops, and the others share the rest
by weight, so what is taken of each source comes within a document of its target.

The targets are the fixed point of that sharing: with sources in order of the virtual time at which they
run dry (``max_repeats`` times their size over their weight), a source below the common end time
gives all it has.

Skew: a source may hold most rows, so no window runs over a source. Places in a queue, and places in the
global order of finish times, are cut into ranges of about ``range_rows`` rows; windows run within a range,
and over the ranges' sums. Only per-source and per-range sums are brought together. Sources may be as many as hosts are: their places, and their sums in
the order in which they run dry, come from range-partitioned sorts and the sums of their partitions.

Defined results: a null text has size 0, and documents of size 0 are taken 0 words; null sources are a source of their
own, last in order; null ids are shuffled like others; equal rows are told apart by nothing and get
their places in any order, with the same set of results; with no words at all every target is 0. ``mixed_rows`` tells rows apart by
id, source and text; repeats of all three are counted off against the copies that the mix takes of them, those with most copies first.
Input columns named like a result are replaced; other columns do not pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans.materialize import written
from knotwork.plans.ranking import ranked, running_sums

WEIGHTS = (5, 2, 1)
#: At most so many ranges of a queue, or of the global order, so that their sums stay a small table.
MOST_RANGES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """``(source, source_size, weight, target)``, one row per source, nulls included."""
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.col("place") % len(weights)
    per_source = ranked(per_source, F.col("source").asc_nulls_last(), into="place")
    per_source = per_source.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    most = (F.col("source_size") * max_repeats).cast("double")
    queue = per_source.select("source", "source_size", "weight", most.alias("most"), (most / F.col("weight")).alias("dry_at"))
    queue = running_sums(queue, ["dry_at", F.col("source").asc_nulls_last()], {"most": "spent", "weight": "gone"})
    whole = queue.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("weights"))
    # The end time, were this source the first not to run dry; it is right where the source really outlasts it.
    queue = written(queue.crossJoin(whole).withColumn("end_at", (F.col("budget") - F.col("spent")) / (F.col("weights") - F.col("gone"))), "sources")
    lasting = queue.where("dry_at >= end_at").agg(F.min(F.struct("dry_at", "end_at"))["end_at"].alias("lasting"))
    return queue.crossJoin(lasting).select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("weight") * F.col("lasting"), F.col("most"))).alias("target"))


def _running(rows: DataFrame, group: list[str], bucket: str, order: list[Column], amount: str, into: str) -> DataFrame:
    """Inclusive running sums of ``amount`` in a group, by ranges whose sums are added up apart."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"__{c}") for c in (*group, bucket)), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for c in (*group, bucket):
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.withColumn(into, F.sum(amount).over(within)).join(starts, same).withColumn(into, F.col(into) + F.col("__start")).drop(*starts.columns)


def fair_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
    range_rows: int = 2_000,
) -> DataFrame:
    """Per document: doc_id, source, row_key (digest of id, source and text), size, source_size, target, finish (of its first copy),
    cycle (what each further copy adds to it), taken_copies, taken.

    ``share`` times the total size is the budget. The full mix is each row ``taken_copies`` times, in
    order of finish times.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _row_key(F.col(id_col), F.col(source_col).cast("string"), text).alias("row_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    sized = written(sized.withColumn("key", key), "sizes")
    targets = written(source_targets(sized, weights, share, max_repeats), "targets")
    per_source = written(sized.groupBy("source").agg(F.count("*").alias("source_rows")).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "sources")

    # Places in a queue: the key is uniform, so its first hex digits cut a source into even ranges.
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(F.col("source_rows") / range_rows))
    uniform = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = sized.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.select("d.*", "source_size", "weight", "target", F.floor(uniform * ranges / float(1 << 32)).alias("part"))
    rows = _running(rows, ["source"], "part", [F.col("key"), F.col("doc_id"), F.col("size")], "size", "sent")
    rows = written(rows.withColumn("finish", F.col("sent") / F.col("weight")), "queue")

    # The global order is by finish time; running sums over ranges of it find the last copy within the budget.
    known = rows.agg(
        F.coalesce(F.max(F.when(F.col("target") < F.col("source_size") * max_repeats, F.col("target") / F.col("weight"))), F.max(F.col("source_size") * max_repeats / F.col("weight"))).alias("end"),
        F.count("*").alias("rows"), F.sum("size").alias("words"),
    ).first()
    end, budget = known["end"] or 1.0, float(known["words"] or 0) * share
    pieces = min(MOST_RANGES, max(1, known["rows"] * max_repeats // range_rows))

    def copy(i: int) -> Column:
        at = (F.col("sent") + i * F.col("source_size")) / F.col("weight")
        slot = F.least(F.floor(at / F.lit(end) * pieces), F.lit(2 * MOST_RANGES)).cast("long")
        return F.struct(slot.alias("slot"), at.alias("at"), F.col("key").alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.lit(i).alias("copy"), F.col("size").alias("size"))

    rows = rows.withColumn("copies", F.array(*(copy(i) for i in range(max_repeats))))
    copies = rows.where("size > 0").select(F.explode("copies").alias("c")).select("c.*", "c")
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    over = slots.where(F.col("upto") > budget).agg(F.min(F.struct("slot", "words", "upto")).alias("x")).first()["x"]
    if over is None:
        within = lambda c: F.lit(True)
    else:
        in_slot = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("slot") == over["slot"]).withColumn("upto", F.sum("size").over(in_slot) + (over["upto"] - over["words"]))
        last = last.where(F.col("upto") <= budget).agg(F.max("c").alias("c")).first()["c"]
        if last is None:
            within = lambda c: c["slot"] < over["slot"]
        else:
            bound = F.struct(*(F.lit(v).cast(copies.schema["c"].dataType[n].dataType).alias(n) for n, v in last.asDict().items()))
            within = lambda c: c <= bound
    n_copies = F.size(F.filter("copies", within)).cast("long")
    return rows.select("doc_id", "source", "row_key", "size", "source_size", "target", "finish", (F.col("source_size") / F.col("weight")).alias("cycle"), n_copies.alias("taken_copies"), (n_copies * F.col("size")).alias("taken"))


def _row_key(id_col: Column, source: Column, text: Column) -> Column:
    named = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit("\n"), named, F.lit("\n"), text))


def mixed_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, range-sorted by each copy's finish time."""
    own = docs.columns
    key = _row_key(F.col(id_col), F.col(source_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    takes = mixed.groupBy("row_key", F.col("taken_copies").cast("int").alias("copies")).agg(F.count("*").alias("rows"), F.min("finish").alias("finish"), F.max("cycle").alias("cycle"))
    takes = takes.groupBy(F.col("row_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("copies", "rows", "finish", "cycle")), asc=False).alias("__takes"))
    takes = written(takes.where(F.col("__takes")[0]["copies"] > 0), "takes")
    found = docs.withColumn("__key", key).join(takes, "__key")
    take = F.col("__takes")[0]
    if not takes.where(F.size("__takes") > 1).isEmpty():  # repeated rows of which the mix takes some more often than others
        number = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))))
        found = found.withColumn("__number", number)
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast(takes.schema["__takes"].dataType.elementType).alias("take"))
        step = lambda acc, t: F.struct((acc["upto"] + t["rows"]).alias("upto"), F.when(acc["take"].isNull() & (F.col("__number") <= acc["upto"] + t["rows"]), t).otherwise(acc["take"]).alias("take"))
        take = F.aggregate("__takes", start, step, lambda acc: acc["take"])
    found = found.withColumn("__take", take).where(F.col("__take.copies") > 0)
    repeated = found.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__take.copies") - 1)))
    return repeated.orderBy(F.col("__take.finish") + F.col("__copy") * F.col("__take.cycle"), id_col).select(*own)
