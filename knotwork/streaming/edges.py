"""Edges from a stream: canonical, without repeats within the watermark, with running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_edges(pairs: DataFrame, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``(src, dst, time)`` from a stream of ``src, dst`` pairs; an edge is told once within ``delay``."""
    rows = pairs.where("src is not null and dst is not null and src <> dst")
    rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col(time_col).alias("time"))
    return rows.withWatermark("time", delay).dropDuplicatesWithinWatermark(["src", "dst"])


def windowed_degrees(edges: DataFrame, window: str = "1 day") -> DataFrame:
    """``(start, id, deg)``: edges by vertex and time window."""
    ends = edges.select("time", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.window("time", window).alias("w"), "id").agg(F.count("*").alias("deg")).select(F.col("w.start").alias("start"), "id", "deg")


def run_to_end(rows: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what its source holds now and returns the rows it tells, kept below ``folder``.

    ``mode``: ``append`` (rows told once), or ``complete`` (the whole result after the last batch).
    """

    def keep(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces itself.
        place = f"{folder}/rows/batch={number}" if mode == "append" else f"{folder}/rows/batch=0"
        batch.write.mode("overwrite").parquet(place)

    stream = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    told = rows.sparkSession.read.schema(rows.schema)
    return told.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select(rows.columns)
