"""Reports and bundles of a project, from the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHOWN, RERANKED, TITLE = 10, 5, 60
#: Rows of a search that are exported: the first candidates, reranked ones and charts, and the latest analyses.
EXPORTED = {"candidates": 20, "reranked": 10, "charts": 5, "analyses": 20}


def cell(c, length: int):
    """A table cell: bars that would end it are widened, then it is cut."""
    return F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("｜")), 1, length)


def table(df: DataFrame, group: str, order: str, head: list[str], row) -> DataFrame:
    """(group, body): a Markdown table of each group's rows, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))
    top = "| " + " | ".join(head) + " |\n|" + "---|" * len(head) + "\n"
    return df.groupBy(group).agg(F.concat(F.lit(top), F.array_join(F.transform(rows, lambda x: x["r"]), "\n")).alias("body"))


def exported(kind: str, rows: DataFrame) -> DataFrame:
    """The rows of each search that are exported; of charts, which have a row for each element, those of the first documents."""
    if kind == "charts":
        first = exported_rows(rows.groupBy("search_id", "patent_number").agg(F.min("ord").alias("ord")), "ord", EXPORTED[kind])
        return rows.join(first.select("search_id", "patent_number"), ["search_id", "patent_number"], "left_semi")
    order = {"candidates": "stage1_rank", "reranked": "stage2_rank"}.get(kind)
    return exported_rows(rows, order or F.desc("id"), EXPORTED[kind])


def exported_rows(rows: DataFrame, order, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("search_id").orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def markdown(project: DataFrame, searches: DataFrame, candidates: DataFrame, reranked: DataFrame, charts: DataFrame, analyses: DataFrame) -> DataFrame:
    """(project_id, text): the report of each project. ``searches`` has project_id; charts hold a row for each element with its verdict."""
    bar = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    cand = table(
        exported("candidates", candidates).filter(F.col("stage1_rank") <= SHOWN),
        "search_id",
        "stage1_rank",
        ["rank", "number", "title", "source", "RRF"],
        bar(F.col("stage1_rank").cast("string"), F.col("patent_number"), cell(F.col("title"), TITLE), F.col("source"), F.coalesce(F.format_string("%.4f", "rrf_score"), F.lit("—"))),
    ).withColumnRenamed("body", "cand")
    threat = lambda c: F.when(F.col(c), "HIGH").otherwise("LOW")
    rer = table(
        exported("reranked", reranked).filter(F.col("stage2_rank") <= RERANKED),
        "search_id",
        "stage2_rank",
        ["rank", "number", "score", "novelty", "inventiveness"],
        bar(F.col("stage2_rank").cast("string"), F.col("patent_number"), F.format_string("%.3f", F.col("weighted_score").cast("double")), threat("novelty_threat"), threat("inventive_threat")),
    ).withColumnRenamed("body", "rer")
    cht = table(
        exported("charts", charts), "search_id", "ord", ["number", "element", "prior art", "verdict"], bar(F.col("patent_number"), cell(F.col("element"), 50), cell(F.col("prior_art"), 60), F.col("verdict"))
    ).withColumnRenamed("body", "cht")
    recent = exported("analyses", analyses)
    ana = recent.groupBy("search_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws("\n\n", F.concat(F.lit("##### "), F.col("strategy")), F.substring("result", 1, 500)).alias("t")))), lambda x: x["t"]), "\n\n").alias("ana")
    )
    s = searches.select("project_id", F.col("id").alias("search_id"), "query", "strategy", "results_count")
    for part in (cand, rer, cht, ana):
        s = s.join(part, "search_id", "left")
    head = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"#### {name}\n\n"), F.col(c)))
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("### "), F.col("search_id").cast("string"), F.lit(" — "), F.col("query")),
        F.format_string("- strategy: %s\n- results: %d", "strategy", F.coalesce("results_count", F.lit(0))),
        head("Candidates", "cand"),
        head("Reranked", "rer"),
        head("Comparison", "cht"),
        head("Analyses", "ana"),
    )
    per = s.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("search_id", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("name")), F.nullif(F.coalesce("description", F.lit("")), F.lit("")), F.when(F.coalesce("claim_text", F.lit("")) != "", F.concat(F.lit("```\n"), F.col("claim_text"), F.lit("\n```"))), F.col("body"))
    return project.join(per, F.col("id") == F.col("project_id"), "left").select(F.col("id").alias("project_id"), text.alias("text"))


def bundle(project: DataFrame, workspace: DataFrame, searches: DataFrame, analyses: DataFrame) -> DataFrame:
    """(project_id, json): project, workspace, searches and their analyses."""
    a = exported("analyses", analyses).groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("id", "strategy", "result"))).alias("analyses"))
    s = searches.join(a, searches.id == a.search_id, "left").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("id", "query", "strategy", "analyses"))).alias("searches"))
    w = workspace.select("project_id", F.struct("claim_text", "structure", "nodes", "edges").alias("workspace"))
    p = project.select(F.col("id").alias("project_id"), F.struct("id", "name", "description").alias("project"))
    return p.join(w, "project_id", "left").join(s, "project_id", "left").select("project_id", F.to_json(F.struct("project", "workspace", "searches")).alias("json"))


def narrative_request(charts: DataFrame) -> DataFrame:
    """(patent_number, line): what a model is told of each chart; without charts there is nothing to tell."""
    return charts.select("patent_number", F.format_string("%s: similarity %.2f, novelty risk %s, inventiveness risk %s", "patent_number", "overall_similarity", "novelty_risk", "inventiveness_risk").alias("line"))
