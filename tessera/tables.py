"""Tables written to the shared folder to cut lineage, with an owner that removes them."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files as soon as it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share; a temporary one only where driver and executors are one process."""
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
    """Removes a folder on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class _Kept(threading.local):
    def __init__(self) -> None:
        self.scopes: list[list[str]] = []


_kept = _Kept()
#: Tables outside of any scope: (path, weak reference to the file index that every plan over it holds).
_loose: list[tuple[str, Any]] = []


_at_exit: set[str] = set()


def _last_sweep(spark: SparkSession) -> None:
    try:
        for path, _ in _loose:
            delete(spark, path)
    except Exception:  # the session has ended; the shared folder's owner cleans up
        pass


def _sweep(spark: SparkSession) -> None:
    """Removes loose tables that no plan can read any more."""
    for entry in [e for e in _loose if e[1].get() is None]:
        _loose.remove(entry)
        delete(spark, entry[0])


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends there.  It goes with the scope it was written in, else once no plan reads it."""
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _kept.scopes:
        _kept.scopes[-1].append(path)
    else:
        _loosen(out)
    return out


def _loosen(table: DataFrame) -> None:
    index = table._jdf.queryExecution().analyzed().relation().location()
    application = table.sparkSession.sparkContext.applicationId
    if application not in _at_exit:
        _at_exit.add(application)
        atexit.register(_last_sweep, table.sparkSession)
    _loose.append((table._written_path, table.sparkSession._jvm.java.lang.ref.WeakReference(index)))


@contextmanager
def working(spark: SparkSession, *kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Owner of what is ``written`` within: all goes at its end, or when it fails, but the tables put into the list that it gives."""
    paths: list[str] = []
    keep: list[DataFrame] = list(kept)
    _kept.scopes.append(paths)
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        _kept.scopes.pop()
        stay = {t._written_path for t in keep}
        for path in paths:
            if path not in stay:
                delete(spark, path)
        for t in keep:
            _kept.scopes[-1].append(t._written_path) if _kept.scopes else _loosen(t)
