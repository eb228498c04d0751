"""Intermediate tables and cut lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: Writes under way in each session, and what the option was before the first of them.
_writing: dict[int, tuple[int, str]] = {}
#: Scopes of this thread, the innermost last.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder is set if driver and executors are one
    process; on a cluster each machine would write to a folder of its own and
    rows would be lost, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def owned_tables() -> Iterator[None]:
    """Tables written inside, by this thread, are deleted at the end; results that read them must be written or collected before."""
    mine: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        discard(*mine)


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when they have ended; the session's own setting comes back after the last of several at once."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _writing.get(key, (0, None))
        if not n:
            before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing[key] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, owned: bool = True) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with replicated storage: a lost executor loses no
    part of the table. Shuffle files of the write go when it has ended. The
    table goes with the scope it is written in, if there is one and it is ``owned``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if owned and (scopes := _scopes.get()):
        scopes[-1].append(out)
    return out


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table of :func:`materialize` as it was read back."""
    return hasattr(df, "_shared_path")


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing lazy reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
