"""Cutting lineage through tables in the shared checkpoint folder.

Executors can be lost at any time and share no local disk, so an intermediate result that several
jobs read is written as Parquet below ``spark.checkpoint.dir`` and read back. The cluster sets that folder. Only where
driver and executors are one machine (a ``local`` master, as in tests) may it be unset: then a folder of this process is used.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="knotwork-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


#: Lets Spark delete a write's shuffle files as soon as the write ends, and not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = Lock()
_writing: dict[str, tuple[int, str | None]] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def _early_cleanup(spark: SparkSession):
    """The setting is on while any thread of the session writes; what it was before comes back with the last of them."""
    session = str(spark._jsparkSession.sessionUUID())
    with _lock:
        count, before = _writing.get(session, (0, spark.conf.get(_CLEANUP, None)))
        _writing[session] = (count + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writing.pop(session)
            if count > 1:
                _writing[session] = (count - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once below the shared folder and read back; the table goes when Spark ends, or with :func:`dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _early_cleanup(spark):
        df.select("*").write.parquet(path)
    system, folder = _folder(spark, path)
    system.deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def kept(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` itself if it is a table of :func:`written`, else written: for what is read many times."""
    return df if df in _paths else written(df, label)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`written` that nothing will read again; others are left alone."""
    for table in tables:
        path = None if table is None else _paths.pop(table, None)
        if path is not None:
            system, folder = _folder(table.sparkSession, path)
            system.delete(folder, True)
