"""CSR files as a Spark data source: ``spark.read.format("csr")`` and ``write.format("csr")`` of rows ``(src, dst)``.

A folder holds ``degree`` and ``adjacency`` parts, which laid end to end are the two binary files of :func:`formats.write_csr_binary`, and ``index.json``, which names
each part's first vertex, number of vertices and number of entries. Parts are the partitions of a read, and filters on ``src`` leave parts out, and within a part the entries of other vertices, before they
are read (with ``spark.sql.python.filterPushdown.enabled``). A vertex's list lies in one part.

A write takes partitions of ascending ``(src, dst)`` that do not share a ``src``; a null ``dst`` names a vertex without neighbours. Tasks write drafts; the driver moves
those of the tasks that succeeded to their places and writes the index last, so a write that fails leaves nothing that can be read, and no drafts. Option ``base`` (0 or 1): the id of the first vertex in
the adjacency file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph, InvalidGraph
from knotwork.sources.formats import HEAD, PART

ITEM = np.dtype("<i4")
CHUNK = 1 << 20
INDEX = "index.json"


@dataclass
class Part(ds.InputPartition):
    """Part ``number`` of the files; vertices from ``low`` up to, not with, ``high`` are wanted."""

    number: int
    first: int
    low: int
    high: int


@dataclass
class Draft(ds.WriterCommitMessage):
    name: str
    first: int
    vertices: int
    entries: int


def _read_index(path: str) -> list[list[int]]:
    system, root = pafs.FileSystem.from_uri(path)
    try:
        with system.open_input_file(f"{root}/{INDEX}") as f:
            return json.loads(f.read())["parts"]
    except FileNotFoundError:
        raise InvalidGraph(f"{path} has no {INDEX}") from None


class CsrReader(ds.DataSourceReader):
    def __init__(self, path: str, base: int):
        self.path, self.base, self.low, self.high = path, base, 0, 1 << 62

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            at = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if at == ("src",) and isinstance(value, int) or isinstance(f, ds.In) and at == ("src",) and value and all(isinstance(v, int) for v in value):
                low, high = {
                    ds.EqualTo: lambda v: (v, v + 1), ds.EqualNullSafe: lambda v: (v, v + 1), ds.GreaterThan: lambda v: (v + 1, self.high), ds.GreaterThanOrEqual: lambda v: (v, self.high),
                    ds.LessThan: lambda v: (0, v), ds.LessThanOrEqual: lambda v: (0, v + 1), ds.In: lambda v: (min(v), max(v) + 1),
                }.get(type(f), lambda v: (0, self.high))(value)
                self.low, self.high = max(self.low, low), min(self.high, high)
            yield f  # Spark looks at the rows again: a range holds all rows that the filters let pass, not only these

    def partitions(self) -> list[Part]:
        parts = [(at, first, n, k) for at, (first, n, k) in enumerate(_read_index(self.path))]
        return [Part(at, first, max(first, self.low), min(first + n, self.high)) for at, first, n, k in parts if k and first < self.high and first + n > self.low] or [Part(-1, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        system, root = pafs.FileSystem.from_uri(self.path)
        name = PART.format(partition.number)
        with system.open_input_file(f"{root}/degree/{name}") as f:
            ends = np.cumsum(np.frombuffer(f.read(), dtype=ITEM), dtype=np.int64)
        begin, end = partition.low - partition.first, partition.high - partition.first
        entry = int(ends[begin - 1]) if begin else 0
        stop = int(ends[end - 1]) if end else 0
        with system.open_input_file(f"{root}/adjacency/{name}") as f:
            while entry < stop:
                n = min(CHUNK, stop - entry)
                raw = f.read_at(n * ITEM.itemsize, entry * ITEM.itemsize)
                if len(raw) != n * ITEM.itemsize:
                    raise InvalidGraph(f"adjacency/{name} is shorter than its degrees say")
                src = np.searchsorted(ends, np.arange(entry, entry + n), side="right") + partition.first
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(np.frombuffer(raw, dtype=ITEM).astype(np.int64) - self.base)], names=["src", "dst"])
                entry += n


class CsrWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, base: int, overwrite: bool):
        self.path, self.base, self.overwrite = path, base, overwrite
        self.drafts = f".drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Draft:
        system, root = pafs.FileSystem.from_uri(self.path)
        name = uuid.uuid4().hex
        folder = f"{root}/{self.drafts}/{name}"
        system.create_dir(folder, recursive=True)
        first, vertex, degree, last, entries = -1, -1, 0, -1, 0
        with system.open_output_stream(f"{folder}/degree") as degrees, system.open_output_stream(f"{folder}/adjacency") as lists:

            def vertices_until(following: int) -> None:
                """The degree of ``vertex``, and zeros of those between it and the following one."""
                if vertex >= 0:
                    degrees.write(np.array([degree], dtype=ITEM).tobytes())
                    for start in range(vertex + 1, following, CHUNK):
                        degrees.write(bytes(ITEM.itemsize * min(CHUNK, following - start)))

            for batch in iterator:
                for src, group in _lists(batch):
                    if src < vertex or src < 0:
                        raise InvalidGraph("rows out of order" if src >= 0 else "a negative id")
                    if src != vertex:
                        vertices_until(src)
                        first, vertex, degree, last = src if first < 0 else first, src, 0, -1
                    if len(group) and (group[0] <= last or (np.diff(group) <= 0).any()):
                        raise InvalidGraph("neighbours out of order, or with repeats")
                    if len(group):
                        last = int(group[-1])
                        lists.write((group + self.base).astype(ITEM).tobytes())
                    degree, entries = degree + len(group), entries + len(group)
            vertices_until(vertex + 1)
        return Draft(name, first, vertex + 1 - first if first >= 0 else 0, entries)

    def commit(self, messages: list[Draft | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        drafts = sorted((m for m in messages if m and m.vertices), key=lambda m: m.first)
        for one, two in zip(drafts, drafts[1:], strict=False):
            if one.first + one.vertices > two.first:
                self._clear(system, root)
                raise InvalidGraph("partitions share vertices; sort the rows by ranges of src")
        if self.overwrite:
            for old in (INDEX, "degree", "adjacency"):
                self._remove(system, f"{root}/{old}")
        for folder in ("degree", "adjacency"):
            system.create_dir(f"{root}/{folder}", recursive=True)
        parts, here = [], 0
        for m in drafts:
            if here < m.first:  # vertices that no row names
                with system.open_output_stream(f"{root}/degree/{PART.format(len(parts))}") as f:
                    for start in range(here, m.first, CHUNK):
                        f.write(bytes(ITEM.itemsize * min(CHUNK, m.first - start)))
                with system.open_output_stream(f"{root}/adjacency/{PART.format(len(parts))}"):
                    pass
                parts.append([here, m.first - here, 0])
            for folder in ("degree", "adjacency"):
                system.move(f"{root}/{self.drafts}/{m.name}/{folder}", f"{root}/{folder}/{PART.format(len(parts))}")
            parts.append([m.first, m.vertices, m.entries])
            here = m.first + m.vertices
        with system.open_output_stream(f"{root}/degree/{HEAD}") as f:
            f.write(np.array([ITEM.itemsize, here, sum(p[2] for p in parts) & 0xFFFFFFFF], dtype="<u4").tobytes())
        self._clear(system, root)
        with system.open_output_stream(f"{root}/{INDEX}") as f:
            f.write(json.dumps({"parts": parts}).encode())

    def abort(self, messages: list[Draft | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        self._clear(system, root)

    def _clear(self, system: pafs.FileSystem, root: str) -> None:
        self._remove(system, f"{root}/{self.drafts}")

    @staticmethod
    def _remove(system: pafs.FileSystem, place: str) -> None:
        kind = system.get_file_info(place).type
        if kind == pafs.FileType.Directory:
            system.delete_dir(place)
        elif kind == pafs.FileType.File:
            system.delete_file(place)


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """``(src, neighbours)`` of stretches of rows with one ``src``."""
    if batch.column(0).null_count:
        raise InvalidGraph("a null src")
    src = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(src)) + 1).tolist(), len(src)] if len(src) else []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        yield int(src[begin]), batch.column(1).slice(begin, end - begin).drop_null().to_numpy(zero_copy_only=False)


class CsrDataSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src long, dst long"

    def _place(self) -> tuple[str, int]:
        base = int(self.options.get("base", "0"))
        if "path" not in self.options or base not in (0, 1):
            raise ValueError("a path, and a base of 0 or 1")
        return self.options["path"], base

    def reader(self, schema) -> CsrReader:
        return CsrReader(*self._place())

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        path, base = self._place()
        system, root = pafs.FileSystem.from_uri(path)
        if not overwrite and system.get_file_info(f"{root}/{INDEX}").type != pafs.FileType.NotFound:
            raise InvalidGraph(f"{path} holds a graph already; overwrite it, or take another path")
        return CsrWriter(path, base, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``csr`` known to the session, with filters pushed down to it, and the session active in this thread: Spark looks sources up by that."""
    spark.dataSource.register(CsrDataSource)
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def csr_rows(graph: Graph, parts: int | None = None) -> DataFrame:
    """Rows as a write takes them: both directions of every edge, and vertices without neighbours, by ``parts`` ranges of ``src`` (None: as many as Spark finds fit)."""
    lone = graph.vertices.join(graph.degrees(isolated=False), "id", "left_anti").select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    return graph.symmetric().unionByName(lone).repartitionByRange(*([parts] if parts else []), "src").sortWithinPartitions("src", F.asc_nulls_first("dst"))
