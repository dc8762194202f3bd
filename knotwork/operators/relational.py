"""Relational operators: dictionary encoding, multiway and annotated joins, breadth-first closure, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.plans.materialize import written
from knotwork.plans.ranking import ranked
from knotwork.plans.turns import coded, in_turns, marks, may_hold


def dictionary(values: DataFrame, col: str, by: str = "value") -> DataFrame:
    """``(value, code)``: codes from 0 by value, or by frequency ascending with ties by value; nulls get none."""
    counts = values.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("k"))
    order = {"value": ["value"], "frequency": ["k", "value"]}[by]
    return ranked(counts, *order, into="code").select("value", "code")


def encode(rows: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """``rows`` with ``col`` replaced by its code (null for unknown values)."""
    own = rows.columns
    found = rows.join(codes.select(F.col("value").alias(col), F.col("code").alias("__code")), col, "left")
    return found.select(*(F.col("__code").alias(c) if c == col else F.col(c) for c in own))


def decode(rows: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    own = rows.columns
    found = rows.join(codes.select(F.col("code").alias(col), F.col("value").alias("__value")), col, "left")
    return found.select(*(F.col("__value").alias(c) if c == col else F.col(c) for c in own))


def multiway_join(relations: list[DataFrame], turns: int = 1) -> DataFrame:
    """Natural join of relations by shared column names, each joined as soon as it shares a column.

    Where a later relation closes a cycle, marks of what it holds travel with the rows and drop most that it would drop, before these are shuffled.
    In ``turns``, the first relation's rows go a share at a time, by its first column.
    """
    if turns > 1:
        return in_turns(relations[0], relations[0].columns[0], turns, lambda part: multiway_join([part, *relations[1:]]), "joined")
    out, rest = relations[0], list(relations[1:])
    while rest:
        at = next((i for i, r in enumerate(rest) if set(r.columns) & set(out.columns)), None)
        if at is None:
            raise ValueError("relations without a shared column")
        nxt = rest.pop(at)
        shared = [c for c in nxt.columns if c in out.columns]
        new = [c for c in nxt.columns if c not in out.columns]
        closing = _closing(rest, [c for c in out.columns if c not in shared], new, {*out.columns, *new})
        if not new:
            out = out.join(nxt, shared, "left_semi")
        elif closing is None:
            out = out.join(nxt, shared)
        else:
            columns = [*shared, *(c for c in out.columns if c not in shared), *new]
            relation, near, far = closing
            out = out.join(marks(relation, near, far), near).join(coded(nxt, far), shared).where(may_hold()).select(*columns)
    return out


def _closing(rest: list[DataFrame], here: list[str], new: list[str], known: set[str]) -> tuple[DataFrame, str, str] | None:
    """A relation that adds no column, and one of its columns on either side of the next join; none if there is none."""
    for r in rest:
        near, far = [c for c in r.columns if c in here], [c for c in r.columns if c in new]
        if near and far and set(r.columns) <= known:
            return r, near[0], far[0]
    return None


def annotated_join(left: DataFrame, right: DataFrame, on: list[str], keep: list[str], left_value: str = "value", right_value: str = "value", plus: str = "sum", times: str = "product") -> DataFrame:
    """Join, multiply the annotations, and add them up by ``keep``: an aggregate in a semiring."""
    a = left.withColumnRenamed(left_value, "__a")
    b = right.withColumnRenamed(right_value, "__b")
    value = {"product": F.col("__a") * F.col("__b"), "sum": F.col("__a") + F.col("__b"), "min": F.least("__a", "__b"), "max": F.greatest("__a", "__b")}[times]
    add = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[plus]
    return a.join(b, on).select(*keep, value.alias("value")).groupBy(*keep).agg(add("value").alias("value"))


def select_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values."""
    for col, value in values.items():
        rows = rows.where(F.col(col) == F.lit(value))
    return rows


def bfs_levels(edges: DataFrame, sources: DataFrame, max_level: int | None = None, directed: bool = False) -> DataFrame:
    """``(id, level)`` of what ``sources(id)`` reach, in at most ``max_level`` steps; sources have level 0."""
    out = edges.select("src", "dst")
    if not directed:
        out = out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    front = written(sources.select("id").distinct().withColumn("level", F.lit(0).cast("long")), "front")
    seen, level = front, 0
    while not front.isEmpty() and (max_level is None or level < max_level):
        level += 1
        step = out.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = written(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level).cast("long")), "front")
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = written(seen, "seen")
    return seen


def insert_absent(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` and those of ``more`` whose key is not there yet (one for each new key)."""
    return rows.unionByName(more.join(rows, key, "left_anti").dropDuplicates(key))


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def array_sets(a: Column, b: Column) -> dict[str, Column]:
    """The set operations on array columns, by name."""
    common = F.array_intersect(a, b)
    return {"intersection": common, "intersection_count": F.size(common), "union": F.array_union(a, b), "difference": F.array_except(a, b)}
