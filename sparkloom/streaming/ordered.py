"""Text deltas that come late, twice, with errors, or never end: lines in the order of their numbers, as a stateful processor.

A request's state is the number of the delta that is due, the text since its last line break, and the deltas that came before their turn. A
request that is silent for ``ttl_s`` gives up: what it holds is told as ``expired`` and its state goes, so abandoned requests do not pile up. Of one
that has ended a mark stays as long, so that late repeats don't begin it anew.

Each request is a key of its own, and only its own deltas meet in a task. State lies in RocksDB beside the checkpoint, not in executors' heaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream of deltas has. ``error`` tells why a request failed, ``cancelled`` that it was given up; both end it, as ``done`` does.
DELTAS = "requestId string, seq int, delta string, done boolean, error string, cancelled boolean"
#: ``kind``: line, and at the end of a request done, error, cancelled or expired; ``n`` numbers a request's rows.
EVENTS = t.StructType([t.StructField("requestId", t.StringType()), t.StructField("n", t.IntegerType()), t.StructField("kind", t.StringType()), t.StructField("text", t.StringType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stands for the delta that is due after a request's end.
ENDED = -1

_HELD = t.StructType([t.StructField("due", t.IntegerType()), t.StructField("n", t.IntegerType()), t.StructField("text", t.StringType())])
_SEQ = t.StructType([t.StructField("seq", t.IntegerType())])
_DELTA = t.StructType([t.StructField("delta", t.StringType()), t.StructField("done", t.BooleanType())])


class Reorder(StatefulProcessor):
    def __init__(self, ttl_s: float):
        self.ttl_ms = int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.early = handle.getMapState("early", _SEQ, _DELTA)

    def _wait(self, timer_values) -> None:
        """The time to live begins anew."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name = key[0]
        due, n, text = self.held.get() if self.held.exists() else (0, 0, "")
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if due == ENDED:
            return
        out: list[tuple[str, int, str, str]] = []

        def tell(kind: str, what: str) -> None:
            nonlocal n
            n += 1
            out.append((name, n, kind, what))

        ended = False
        stop = None
        for seq, delta, done, error, cancelled in zip(came["seq"], came["delta"], came["done"], came["error"], came["cancelled"], strict=True):
            if isinstance(error, str) and error:
                stop = ("error", error)
            elif cancelled is not None and not pd.isna(cancelled) and bool(cancelled):
                stop = stop or ("cancelled", "")
            elif seq is not None and not pd.isna(seq) and int(seq) >= due:  # what was there before is a repeat
                self.early.updateValue((int(seq),), (delta if isinstance(delta, str) else "", bool(done) and not pd.isna(done)))
        while not ended and self.early.containsKey((due,)):
            delta, done = self.early.getValue((due,))
            self.early.removeKey((due,))
            due += 1
            *full, text = (text + delta).split("\n")
            for line in full:
                if line:
                    tell("line", line)
            if done:
                if text:
                    tell("line", text)
                tell("done", "")
                ended = True
        if stop and not ended:
            if text:
                tell("line", text)
            tell(*stop)
            ended = True
        if ended:
            self.early.clear()
        self.held.update((ENDED, n, "") if ended else (due, n, text))
        self._wait(timerValues)
        yield pd.DataFrame(out, columns=["requestId", "n", "kind", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, n, text = self.held.get() if self.held.exists() else (0, 0, "")
        self.held.clear()
        self.early.clear()
        if due == ENDED:
            return
        out = [(key[0], n + 1, "line", text)] if text else []
        out.append((key[0], n + len(out) + 1, "expired", f"waited for {due}"))
        yield pd.DataFrame(out, columns=["requestId", "n", "kind", "text"])

    def close(self) -> None:
        pass


def ordered_lines(stream: DataFrame, ttl_s: float = 600) -> DataFrame:
    """(requestId, n, kind, text) of a stream of ``DELTAS``, whose numbers start at 0."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy("requestId").transformWithStateInPandas(Reorder(ttl_s), EVENTS, "Append", "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that this needs, unless the session has chosen one like it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, PROVIDER)
