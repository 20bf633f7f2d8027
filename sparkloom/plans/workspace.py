"""Smaller operations around a search: prompt lines, claim summaries, templates, context items, usage, progress, cancelling."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import scoring as S
from ..operators import claims, ranking

#: Phases of a search in their order.
PHASES = ("parse", "fetch", "score", "rerank", "chart", "done")


def element_lines(elements: Column) -> Column:
    """What a prompt says of a claim's elements: a line each, with a star more than its importance."""
    line = lambda e: F.concat(F.lit("["), e["id"], F.lit("] "), F.repeat(F.lit("*"), e["importance"] + 1), F.lit(" "), e["text"])
    return F.array_join(F.transform(elements, line), "\n")


def camel(df: DataFrame, flags: tuple[str, ...] = (), json: dict[str, str] | None = None) -> DataFrame:
    """Stored rows as records: snake_case names in camelCase, 0 and 1 of ``flags`` as booleans, ``json`` columns parsed by their schemas."""
    out = []
    for c in df.columns:
        name = re.sub("_([a-z])", lambda m: m[1].upper(), c)
        value = F.col(c)
        if c in flags:
            value = value.cast("boolean")
        if json and c in json:
            value = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, json[c]))
        out.append(value.alias(name))
    return df.select(*out)


def section_chunks(chunks: DataFrame, kind: str) -> DataFrame:
    """Chunks of one section type, by their place."""
    return chunks.filter(F.col("sectionType") == kind).orderBy("charStart")


def target_claims(table: DataFrame, numbers: list[int] | None) -> DataFrame:
    """The claims with these numbers (all, if none are given); a claim keeps its own number."""
    return table if not numbers else table.filter(F.col("num").isin(numbers))


def with_builtins_first(stored: DataFrame, builtins: DataFrame, key: str = "id") -> DataFrame:
    """Built-in templates that the store lacks, then the stored ones: ``ord`` tells the order."""
    missing = builtins.join(stored.select(key), key, "left_anti").select(*stored.columns).withColumn("_s", F.lit(0))
    both = missing.unionByName(stored.withColumn("_s", F.lit(1)))
    return both.withColumn("ord", F.row_number().over(Window.orderBy("_s", key))).drop("_s")


def dependents_by_root(table: DataFrame, num: str = "num", parent: str = "parent") -> DataFrame:
    """(root, dependents): the dependent claims under each root, in order of their numbers."""
    chain = claims.roots(table, num, parent).join(table.filter(F.col(parent).isNotNull()).select(F.col(num).alias("num")), "num")
    return chain.groupBy("root").agg(F.array_sort(F.collect_list("num")).alias("dependents"))


def claim_counts(table: DataFrame, parent: str = "parent", domain: str = "technicalDomain") -> DataFrame:
    """independent, dependent, and the distinct domains that are not empty."""
    return table.agg(
        F.count_if(F.col(parent).isNull()).alias("independent"),
        F.count_if(F.col(parent).isNotNull()).alias("dependent"),
        F.array_sort(F.collect_set(F.nullif(domain, F.lit("")))).alias("domains"),
    )


def claim_summary(nodes: DataFrame, reranked: DataFrame, charts: DataFrame) -> DataFrame:
    """Of each node: its best reranked document and the risks of that document's first chart (by ``chart_ord``, if there is one, else by its risks)."""
    best = reranked.filter("stage2_rank = 1").select("node", F.col("patent_number").alias("top"), "weighted_score")
    risks = F.struct("novelty_risk", "inventiveness_risk")
    order = F.struct("chart_ord", risks) if "chart_ord" in charts.columns else risks
    risks = charts.groupBy("node", F.col("patent_number").alias("top")).agg(F.min_by(risks, order).alias("r")).select("node", "top", "r.*")
    return nodes.join(best, "node", "left").join(risks, ["node", "top"], "left")


def prompt_context(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first candidates as one text."""
    rows = hits.filter(F.col("rank") <= n).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(": ", "patentNumber", "title").alias("t")))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("text"))


def context_item(kind: str, content: str) -> dict:
    """A note counts for reranking only, a url for search and reranking."""
    return {"kind": kind, "content": content, "for_search": kind == "url", "for_rerank": True, "active": True}


def toggled(items: DataFrame, key: str, flag: str = "active") -> DataFrame:
    return items.withColumn(flag, F.when(F.col("id") == key, ~F.col(flag)).otherwise(F.col(flag)))


def added(items: DataFrame, item: dict) -> DataFrame:
    """The items and one more, under the next number as its id."""
    high = items.agg(F.coalesce(F.max(F.col("id").cast("long")), F.lit(0)).alias("high"))
    new = high.select((F.col("high") + 1).cast(items.schema["id"].dataType).alias("id"), *(F.lit(v).alias(k) for k, v in item.items()))
    return items.unionByName(new)


def without(items: DataFrame, key) -> DataFrame:
    return items.filter(F.col("id") != key)


def active_items(items: DataFrame, flag: str = "active") -> DataFrame:
    """How many items are active."""
    return items.agg(F.count_if(F.col(flag)).alias("active"))


def with_enriched(nodes: DataFrame, enriched: DataFrame, num: str = "num", order: str = "ord") -> DataFrame:
    """Nodes with the first enriched claim (by ``order``, then its other columns) of their number; nulls where there is none."""
    rest = [c for c in enriched.columns if c not in (num, order)]
    first = enriched.groupBy(num).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("_e"))
    return nodes.join(first, num, "left").select(*nodes.columns, *(F.col(f"_e.{c}") for c in rest))


def usage(df: DataFrame, by: list[str], order: list[str], tokens_in: str = "input_tokens", tokens_out: str = "output_tokens") -> DataFrame:
    """Running totals of tokens and their cost, whatever share of the rows one key has."""
    totals = ranking.running_sums(df, by, order, {"total_in": tokens_in, "total_out": tokens_out})
    return totals.withColumn("dollars", F.round(F.col("total_in") * S.PRICE_IN + F.col("total_out") * S.PRICE_OUT, 6))


def progress_percent(phase: str, done: int = 0, total: int = 0) -> int:
    """How far a search is: phases count alike, and the part of the current one."""
    share = done / total if total else 0.0
    return min(100, int(100 * (PHASES.index(phase) + share) / (len(PHASES) - 1) + 0.5))


class Progress(StreamingQueryListener):
    """Passes (query id, batch, rows) of running streams to a callback."""

    def __init__(self, tell: Callable[[str, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell(str(event.id), -1, 0)

    def onQueryProgress(self, event):
        self.tell(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell(str(event.id), -2, 0)


class Cancel:
    """Cooperative cancelling: jobs started within ``running`` stop at once, and plans between stages ask ``stopped``."""

    def __init__(self, spark: SparkSession, group: str):
        self.spark, self.group, self._flag = spark, group, threading.Event()

    @property
    def stopped(self) -> bool:
        return self._flag.is_set()

    def cancel(self) -> None:
        self._flag.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    @contextmanager
    def running(self):
        self.spark.sparkContext.setJobGroup(self.group, self.group, True)
        try:
            yield self
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def result(self, df: DataFrame) -> DataFrame:
        """The frame, or an empty one of its schema after a cancel."""
        return df.limit(0) if self.stopped else df


def migrated(versions: DataFrame, known: list[int]) -> list[int]:
    """Schema versions still to be applied."""
    now = versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v
    return [v for v in sorted(known) if v > now]
