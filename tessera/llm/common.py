"""Helpers shared by the training-data operators: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files as soon as it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data directory (any file system that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only where driver and executors are one process may it be unset: then it is a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^-\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir names no folder; set it to one that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of this module's, on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What ``stored`` wrote and hasn't been removed: (path, weak reference to the file index that every plan over it holds).
_kept: list[tuple[str, Any]] = []
_at_exit: set[str] = set()


def _sweep(spark: SparkSession) -> None:
    """Removes stored tables that no plan can read any more."""
    global _kept
    kept = []
    for path, index in _kept:
        if index.get() is None:
            delete(spark, path)
        else:
            kept.append((path, index))
    _kept = kept


def _last_sweep(spark: SparkSession) -> None:
    try:
        for path, _ in _kept:
            delete(spark, path)
    except Exception:  # the session has ended; the shared folder's owner cleans up
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and no executor is needed for it.

    The files go when ``forget`` is called, or once no plan refers to them any more and another table is stored.
    """
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what the job shuffled is of no more use
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _kept.append((path, spark._jvm.java.lang.ref.WeakReference(index)))
    if _scopes.open:
        _scopes.open[-1].made.append(out)
    application = spark.sparkContext.applicationId
    if application not in _at_exit:
        _at_exit.add(application)
        atexit.register(_last_sweep, spark)
    out._stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote for these tables; nothing may read them, or what was derived from them, any more."""
    global _kept
    known = {path for path, _ in _kept}
    gone = {t._stored_path for t in tables} & known
    for path in gone:
        delete(tables[0].sparkSession, path)
    _kept = [(path, index) for path, index in _kept if path not in gone]


class Scope:
    """The tables that were stored within it, and those that outlive it."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> DataFrame:
        """These stay after the scope (they belong to the next one outside then); gives the first."""
        self.kept += tables
        return tables[0]


class _Scopes(threading.local):
    def __init__(self) -> None:
        self.open: list[Scope] = []


_scopes = _Scopes()


@contextmanager
def scope() -> Iterator[Scope]:
    """Owner of the tables that are stored within: at its end, or when it fails, all are removed but those it keeps."""
    own = Scope()
    _scopes.open.append(own)
    try:
        yield own
    except BaseException:
        own.kept = []
        raise
    finally:
        _scopes.open.pop()
        kept = {t._stored_path for t in own.kept}
        if gone := [t for t in own.made if t._stored_path not in kept]:
            forget(*gone)
        if _scopes.open:
            _scopes.open[-1].made += [t for t in own.made if t._stored_path in kept]


def column_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names not taken by a column of ``df`` (case aside), made from ``wanted`` with underscores in front."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


_tables: dict[tuple, Any] = {}


def worker_tables(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` builds, kept in the worker process until another operator's tables take the place: workers are reused."""
    if key not in _tables:
        release_tables()
        _tables[key] = make()
    return _tables[key]


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the search for cyclic garbage, which goes through large tables again and again where no cycles are made."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def release_tables() -> None:
    """Frees what another operator left in the worker process."""
    _tables.clear()


#: Bytes that an Arrow batch to a worker holds (one row at least), where the session doesn't say: texts are long.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Arrays from this size on go back to the system when they are freed.
MAPPED_BYTES = 8 << 20
_M_MMAP_THRESHOLD = -3


@cache
def _libc() -> Any:
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)
        return libc if hasattr(libc, "malloc_trim") else None
    except (AttributeError, OSError):
        return None


@contextmanager
def lean(keeps: bool = False) -> Iterator[None]:
    """For a task's work in a worker, which is reused and idle in between: what was freed goes back to the system.

    ``keeps``: the operator has tables in the worker, which stay; else those of others go first.
    """
    libc = _libc()
    if not keeps:
        release_tables()
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes and lean workers."""
    small_batches(df.sparkSession)

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean(keeps):
            yield from run(batches)

    return df.mapInArrow(leanly, schema)


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
