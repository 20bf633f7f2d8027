"""Plumbing shared by the training-data operators: staging, size-checked broadcast, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs that may be broadcast: about 16 MB, whatever the input's size.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def texts(df: DataFrame, *columns) -> DataFrame:
    """``columns`` of a table of whole texts, on their way to Python workers.

    Arrow batches of the default 10,000 rows would hold tens of megabytes of text on both sides; batches of
    1,000 rows bound that. A session that set its own number keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df.select(*columns)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fresh(spark: SparkSession) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/sparkloom/{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{fresh(spark)}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete the folder that ``fresh`` named and that holds ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    drop_path(df.sparkSession, df._stage_path)


def trim() -> None:
    """Give this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Stages:
    """Staged frames and broadcast values of one computation: they go when it ends, well or not."""

    def __init__(self):
        self.frames: list[DataFrame] = []
        self.values: list = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        for df in self.frames:
            drop_stage(df)
        for value in self.values:
            value.destroy()
        self.frames, self.values = [], []
        trim()

    def share(self, spark: SparkSession, value):
        self.values.append(spark.sparkContext.broadcast(value))
        return self.values[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        self.frames.append(df)
        return df

    def stage(self, df: DataFrame, tag: str) -> DataFrame:
        return self.keep(stage(df, tag))

    def drop(self, df: DataFrame) -> None:
        self.frames.remove(df)
        drop_stage(df)


#: The one costly value that a worker keeps between tasks, and whether the present task asked for it.
_kept: dict = {"key": None, "value": None, "used": False}


def kept(key: tuple, make: Callable):
    """``make()``, kept in this worker until a task ends that didn't ask for ``key``, or asks for another one."""
    if _kept["key"] != key:
        _kept["value"] = None
        _kept.update(key=key, value=make())
    _kept["used"] = True
    return _kept["value"]


def _end_task() -> None:
    if not _kept["used"]:
        _kept.update(key=None, value=None)
    trim()


def tidy(function: Callable) -> Callable:
    """A function of batches after whose end its worker's memory is trimmed: workers are used again."""

    def run(batches):
        _kept["used"] = False
        yield from function(batches)
        _end_task()

    return run


def tidy_group(function: Callable) -> Callable:
    """As ``tidy``, for a function of a key and batches."""

    @functools.wraps(function)
    def run(key, batches):
        _kept["used"] = False
        yield from function(key, batches)
        _end_task()

    return run


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that ``df`` does not have, made of ``names``."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged frame, only if its counted rows are within ``limit``; else it is shuffled."""
    return F.broadcast(df) if df.count() <= limit else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (id, component) with the smallest id reachable; alternating large and small stars.

    Self loops and repeated edges are allowed; ids without an edge are absent. Every step is a
    pre-aggregated group-by on a node plus an equi-join, staged, so a hub with a third of all
    edges is only one aggregate row per task.
    """
    e = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        l1 = large.distinct()
        low2 = l1.groupBy("u").agg(F.min("v").alias("m"))
        joined = l1.join(low2, "u")
        star = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low2.select("u", F.col("m").alias("v"))
        )
        new = stage(star.filter("u <> v").distinct(), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stage(e)
        e = new
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
