"""What the operators of this subpackage share: scans, written cuts of a plan's lineage, and models sent to tasks."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_OWN: list[str] = []
#: What `written` returned inside each open scratch of this thread, the innermost last.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())
#: Removes a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidegauge-"))
    return _OWN[0]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, **options) -> DataFrame:
    """df written to the shared folder as Parquet and read again: its lineage ends at files every executor can read, and its shuffles are dropped. Options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegauge-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    if _OPEN.get():
        _OPEN.get()[-1].append(out)
    return out


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left.join(right, on, how) as a sort-merge join, neither side broadcast: for rows that an explode or a Python function makes
    of fewer, or that files hold far smaller than memory. Spark takes their size from what they are made of, and would send them through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that `written` returned, once all that was made from them is written."""
    for df in frames:
        for made in _OPEN.get():
            made[:] = [x for x in made if x is not df]
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, at its end or when it fails, the files of what `written` returned inside it, but for the frames that are put into the list it gives.

    Those belong to the scratch around it, if there is one. What other threads write is their own. A query's result reads such files:
    put the query and what uses its rows inside.
    """
    made: list[DataFrame] = []
    keep: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        _OPEN.reset(token)
        held = [x for x in made if any(x is y for y in keep)]
        if _OPEN.get():
            _OPEN.get()[-1].extend(held)
        discard(*[x for x in made if not any(x is y for y in held)])


def shared(spark: SparkSession, value: T) -> Callable[[], T]:
    """A function that gives `value` inside tasks. Its classes travel by value, so executors need no package of ours; each task reads it once."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


