"""Shared folder, written tables and column names used by the operators here."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..partitions import spread

#: Largest number of rows that a side may have for an explicit broadcast.
BROADCAST_ROWS = 200_000

_local_dirs: dict[str, str] = {}
#: Tables that ``written`` made and that are still there.
_tables: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, as the session names it.

    Only a session in local mode without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="vecframe-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return "file://" + _local_dirs[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecframe_path = path
    _tables[path] = out
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made and that no later plan reads."""
    for t in tables:
        path = getattr(t, "_vecframe_path", None)
        if path:
            _tables.pop(path, None)
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(keep: Callable[[], DataFrame | None] = lambda: None) -> Iterator[None]:
    """Deletes the tables that are written within, but ``keep()``: for results that are written or collected within."""
    before = set(_tables)
    try:
        yield
    finally:
        kept = getattr(keep(), "_vecframe_path", None)
        forget(*[t for p, t in _tables.items() if p not in before and p != kept])


@atexit.register
def forget_all() -> None:
    """Delete all tables that are still there; at the end of the driver, since results are lazy and read them."""
    for t in list(_tables.values()):
        try:
            forget(t)
        except Exception:  # the session has ended before, and its folder with it
            return


def fresh(taken: list[str] | DataFrame, *names: str) -> list[str]:
    """Names like these that no column has yet, whatever the case."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``rows``, which the caller counted, is within the limit; else AQE decides."""
    return F.broadcast(df) if rows <= limit else df


def name(column: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, whatever the names of the columns are; ``run`` finds them by position."""
    return spread(df).toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(releasing(run), schema)


def release() -> None:
    """Give memory that a Python worker has freed back to the machine: workers stay for later stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a partition, with ``release`` behind it."""

    def then(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return then


def table(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{of}.parquet")
