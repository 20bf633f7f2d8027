"""A search from sources to stored charts, in phases that can be cancelled between and gone on with later.

Each phase writes its rows into the run's folder; Spark's mark of success there says that it is done. A run that is made again over the same
folder (after a cancel, a lost driver, an error) reads finished phases and computes the others. Rows are counted by an
``Observation`` while they are written, without a job of their own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import candidates, claims, replies, store
from ..sources.replies import SourceRegistry
from . import providers, search, workspace

#: What is said instead of a report after a cancel.
CANCELLED = "The search was cancelled."
EMPTY_SCORES = "array<struct<id string, score double, evidence string>>"


@dataclass
class Result:
    """Tables of a search; after a cancel they are empty, and ``report`` says so."""

    hits: DataFrame
    reranked: DataFrame
    charts: DataFrame
    broad_terms: list[str]
    report: str
    cancelled: bool
    milliseconds: int


def settings_of(template: str, base: search.Settings = search.Settings()) -> search.Settings:
    """The settings of a way to search (``providers.SEARCH_TEMPLATES``); of an unknown one ``base``."""
    found = providers.search_template(template)
    return base if found is None else replace(base, per_source=found[1], rerank=found[2])


class SearchRun:
    """One search. ``fetch`` gives candidates of a query text; ``make`` a provider, in each task anew; ``tell`` hears (phase, percent, rows)."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        query: search.Query,
        fetch: Callable[[str], DataFrame],
        make: Callable[[], providers.Provider] | None = None,
        settings: search.Settings = search.Settings(),
        cancel: workspace.Cancel | None = None,
        tell: Callable[[str, int, int], None] = lambda phase, percent, rows: None,
    ):
        self.spark, self.folder, self.query, self.settings = spark, folder.rstrip("/"), query, settings
        self.fetch, self.make, self.tell = fetch, make, tell
        self.cancel = cancel or workspace.Cancel(spark, f"search {self.folder}")
        self.rows: dict[str, int] = {}
        self.computed: list[str] = []

    @classmethod
    def over_sources(cls, spark: SparkSession, folder: str, query: search.Query, registry: SourceRegistry, wanted: list[str], allowed: list[str], keys=None, **rest) -> SearchRun:
        """A search over registered sources, each cut at the settings' number of candidates."""
        settings = rest.get("settings", search.Settings())

        def fetch(text: str) -> DataFrame:
            found = registry.fetch(spark, text, wanted, allowed, keys)
            return candidates.first_of_each(found, "source", "doc_ord", settings.per_source)

        return cls(spark, folder, query, fetch, **rest)

    def _done(self, phase: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{phase}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _phase(self, phase: str, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        """The written rows of a phase, computed unless they are there."""
        if self.cancel.stopped:
            raise _Stopped
        path = f"{self.folder}/{name}"
        if not self._done(name):
            seen = Observation(name)
            try:
                with self.cancel.running():
                    plan().observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            except Exception as error:
                if self.cancel.stopped:  # the job was cancelled
                    raise _Stopped from error
                raise
            self.rows[name] = seen.get["rows"]
            self.computed.append(name)
        out = self.spark.read.parquet(path)
        if name not in self.rows:
            self.rows[name] = out.count()
        self.tell(phase, workspace.progress_percent(phase, 1, 1), self.rows[name])
        return out

    def _asked(self, prompts: DataFrame) -> DataFrame:
        """Replies to (key, prompt); none without a provider."""
        if self.make is None:
            return prompts.select("key", F.lit("").alias("reply"))
        answered = providers.generate_all(prompts.withColumn("system", F.lit("")), self.make)
        return answered.select("key", F.coalesce("content", F.lit("")).alias("reply"))

    def _hits(self, found: DataFrame) -> DataFrame:
        text = " ".join([self.query.text, *self.query.search_queries[:3]])
        hits = search.retrieve(found, replace(self.query, text=text), self.settings)
        if self.settings.check_urls:
            hits = hits.drop("urlValid").withColumn("urlValid", candidates.url_valid(F.col("url")))
        return hits

    def _rerank(self, hits: DataFrame) -> DataFrame:
        told = None
        if self.settings.rerank:
            batches = search.rerank_batches(hits)
            shown = F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("["), F.col("id"), F.lit("]")), F.col("title")), candidates.excerpt(1500, F.col("abstract"), F.col("claims")))
            lines = batches.select("batch", F.explode("ids").alias("id")).join(hits.select("id", "rank", shown.alias("line")), "id")
            prompts = lines.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
            asked = F.concat(F.lit(f"Claim:\n{self._claim()}\n\nScore each element 0 to 100 for every document, as JSON.\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"))
            told = self._phase("rerank", "rerank_replies", lambda: self._asked(prompts.select(F.col("batch").alias("key"), asked.alias("prompt")))).withColumnRenamed("key", "batch")
        return search.reranked(hits, told)

    def _claim(self) -> str:
        return self.query.claim or self.query.text

    def _charts(self, hits: DataFrame, scores: DataFrame) -> DataFrame:
        if "element_scores" not in scores.columns:
            scores = scores.withColumn("element_scores", F.array().cast(EMPTY_SCORES)).withColumn("reasoning", F.lit(""))
        inputs = search.chart_inputs(hits, scores, self._claim())
        # what has no score for each element is asked for by itself
        lacking = inputs.filter(F.coalesce(F.size("element_scores") != F.size("elements"), F.lit(True)))
        asked = F.concat(F.lit("Compare as JSON, element by element:\n"), workspace.element_lines(F.col("elements")), F.lit("\n\n"), candidates.excerpt(2500, F.col("title"), F.col("abstract"), F.col("claims")))
        told = self._phase("chart", "chart_replies", lambda: self._asked(lacking.select(F.col("id").alias("key"), asked.alias("prompt"))))
        return replies.charts(inputs.join(told.select(F.col("key").alias("id"), F.col("reply").alias("chart_reply")), "id", "left"))

    def run(self) -> Result:
        """All phases; what is written stays for the next run over the folder."""
        start = time.monotonic()
        elapsed = lambda: int(1000 * (time.monotonic() - start))
        try:
            parsed = self.spark.range(1).select(claims.broad_terms(F.lit(self._claim())).alias("b")).first()
            self.tell("parse", workspace.progress_percent("parse", 1, 1), 0)
            found = self._phase("fetch", "found", lambda: self.fetch(self.query.text))
            hits = self._phase("score", "hits", lambda: self._hits(found))
            reranked = self._phase("rerank", "reranked", lambda: self._rerank(hits))
            charts = self._phase("chart", "charts", lambda: self._charts(hits, reranked))
            lines = [r.line for r in _report_lines(charts)]
            self.tell("done", 100, self.rows["hits"])
            return Result(hits, reranked, charts, parsed.b, "\n".join(lines), False, elapsed())
        except _Stopped:
            none = self.spark.createDataFrame([], "id string")
            return Result(none, none, none, [], CANCELLED, True, elapsed())


def _report_lines(charts: DataFrame) -> list:
    line = F.format_string("%s: similarity %.2f, novelty risk %s, inventiveness risk %s", "patentNumber", "overall_similarity", "novelty_risk", "inventiveness_risk")
    return charts.select("rank", line.alias("line")).orderBy("rank").collect()  # five at most


class _Stopped(Exception):
    pass


def save(to: store.Store, search_id: int, result: Result) -> dict[str, int]:
    """Candidates (the first of each number, ``search.STORED`` at most), their rerank results and the charts of a search, and its end, in one commit.

    Gives the numbers of stored rows. A cancelled search is marked and stores nothing.
    """
    here = F.col("id") == search_id
    if result.cancelled:
        to.change(lambda: {"search_history": store.update(to.table("search_history"), here, {"status": F.lit("cancelled")})})
        return {"search_candidates": 0, "rerank_results": 0, "claim_charts": 0}
    key, null = F.lit(search_id).cast("long"), F.lit(None)
    best = candidates.first_per_key(result.hits.filter(F.col("rank") <= search.STORED), F.col("patentNumber"), "rank")
    url_valid = F.col("urlValid") if "urlValid" in result.hits.columns else null.cast("boolean")
    rows = best.select(
        F.col("id").alias("doc_id"), key.alias("search_id"), F.col("patentNumber").alias("patent_number"), "title", "abstract", "source", "url", url_valid.alias("url_valid"), "bm25_score", "vector_score",
        "rrf_score", F.col("rank").cast("int").alias("stage1_rank"), F.to_json(F.struct("patentNumber", "title", "abstract", "url")).alias("doc"),
    )
    scores = result.reranked
    for name, kind in (("element_scores", EMPTY_SCORES), ("novelty_threat", "boolean"), ("inventiveness_threat", "boolean"), ("reasoning", "string")):
        if name not in scores.columns:
            scores = scores.withColumn(name, null.cast(kind))
    chart = F.to_json(F.struct("patentNumber", "rows", "overall_similarity", "novelty_risk", "inventiveness_risk"))
    made = result.charts.select(key.alias("search_id"), F.col("patentNumber").alias("patent_number"), "rank", chart.alias("chart_json"), F.current_timestamp().alias("created_at"))
    counts: dict[str, int] = {}

    def changes() -> dict[str, DataFrame]:
        old = {name: to.table(name) for name in ("search_candidates", "rerank_results", "claim_charts")}
        high = {name: df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for name, df in old.items()}
        numbered = store.with_ids(rows, ["stage1_rank"], high["search_candidates"])
        judged = scores.join(numbered.select(F.col("id").alias("candidate_id"), F.col("doc_id").alias("id")), "id").select(
            key.alias("search_id"), "candidate_id", F.col("weighted_score").cast("double").alias("weighted_score"), F.to_json("element_scores").alias("element_scores"), "novelty_threat",
            F.col("inventiveness_threat").alias("inventive_threat"), "reasoning", F.col("stage2_rank").cast("int").alias("stage2_rank"),
        )
        new = {
            "search_candidates": numbered.drop("doc_id"),
            "rerank_results": store.with_ids(judged, ["stage2_rank"], high["rerank_results"]),
            "claim_charts": store.with_ids(made, ["rank"], high["claim_charts"]).drop("rank"),
        }
        counts.update({name: df.count() for name, df in new.items()})  # fifty rows at most
        done = {"status": F.lit("done"), "results_count": F.lit(counts["search_candidates"]), "execution_ms": F.lit(result.milliseconds).cast("long")}
        return {name: to.appended(name, df) for name, df in new.items()} | {"search_history": store.update(to.table("search_history"), here, done)}

    to.change(changes)
    return counts


def shown_score(weighted, rrf):
    """The score that a list shows: the judged one, else that of the fused ranks."""
    return F.coalesce(weighted, S.plain_score(rrf).cast("int"))
