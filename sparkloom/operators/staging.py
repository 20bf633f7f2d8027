"""Intermediate tables in the shared folder, size-checked broadcasts, and rows spread over idle cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a term or id with a number or two that may be broadcast: some 20 MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again: no lineage, and nothing is kept in executors. ``sweep`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what this session has staged; results that were not written or collected can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged frame whose counted rows are within ``limit``; else a join shuffles it."""
    return F.broadcast(df) if df.count() <= limit else df


def _is_scan(plan) -> bool:
    """Whether a physical plan is projections and filters over one scan of files."""
    while True:
        name = plan.getClass().getSimpleName()
        if name in ("FileSourceScanExec", "BatchScanExec"):
            return True
        if name not in ("ProjectExec", "FilterExec", "ColumnarToRowExec", "InputAdapter", "WholeStageCodegenExec"):
            return False
        plan = plan.children().apply(0)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, where it has fewer partitions than these; others, and what is no plain scan, as they are."""
    if not _is_scan(df._jdf.queryExecution().sparkPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
