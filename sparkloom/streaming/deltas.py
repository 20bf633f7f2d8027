"""Streams of text deltas: reassembly by request, and re-framing into lines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import staging

DELTA = "requestId string, seq int, delta string, done boolean, inputTokens int, outputTokens int"


def assembled(deltas: DataFrame, key: str = "requestId", order: str = "seq", text: str = "delta", joiner: str = "") -> DataFrame:
    """(key, n, text): the deltas of each request joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("x"))))
    return deltas.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["x"]), joiner).alias("text"))


def lines(text: Column) -> Column:
    """Complete lines of a reassembled text (what follows the last newline counts where it is not empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x != "")


def stream_lines(stream: DataFrame) -> DataFrame:
    """(requestId, n, line) of a stream of deltas (requestId, seq, delta, done), as soon as a line is complete.

    What has no newline yet is the state of its request; ``done`` sends it out and ends the state. Deltas of a request come in order of
    seq within a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        *full, held = (held + "".join(rows["delta"].fillna(""))).split("\n")
        if rows["done"].fillna(False).any():
            full.append(held)
            state.remove()
        out = [x for x in full if x]
        if not rows["done"].fillna(False).any():
            state.update((held, n + len(out)))
        yield pd.DataFrame({"requestId": key[0], "n": range(n + 1, n + len(out) + 1), "line": out})

    return stream.groupBy("requestId").applyInPandasWithState(run, "requestId string, n int, line string", "held string, n int", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, path: str, schema: str, transform, out: str, mode: str = "append", files: int = 1, fmt: str = "parquet", timers: bool = False) -> DataFrame:
    """Everything that lies in ``path`` through a streaming query, ``files`` a micro-batch, into Parquet under ``out``; gives its rows.

    For aggregates (mode "complete") each micro-batch writes the whole result anew and the last one counts. With ``timers`` of processing
    time no micro-batch runs without data: it would go on for ever, as the clock does; timers that are due go off with the next data.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)

    def sink(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    made = transform(source)
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    if timers:
        spark.conf.set(key, "false")
    query = made.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    spark.conf.set(key, before)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    rows = spark.read.parquet(f"{out}/rows").drop("epoch")
    if mode == "complete":
        last = rows.agg(F.max("_epoch")).first()[0]
        rows = rows.filter(F.col("_epoch") == last)
    return rows.drop("_epoch")


def work_folder(spark: SparkSession) -> str:
    """A new folder among those that all executors share."""
    return f"{staging.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
