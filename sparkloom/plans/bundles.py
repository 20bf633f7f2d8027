"""Bundles of projects read back: exported JSON as rows of the store's tables, under new ids.

A bundle's lists may hold one object or an array of them (written by hand or by other tools), so they are read as variants first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging

#: What a bundle gives to each table: columns besides ids.
TABLES = {
    "projects": ("name", "description"),
    "project_workspace": ("project_id", "claim_text", "structure", "nodes", "edges"),
    "search_history": ("query", "strategy"),
    "project_searches": ("project_id", "search_id"),
    "analysis_results": ("search_id", "strategy", "result"),
}


def listed(value: Column, kind: str) -> Column:
    """array<kind> of a variant that holds one object or an array of them; null gives none."""
    shape = F.schema_of_variant(value)
    many = F.try_variant_get(value, "$", f"array<{kind}>")
    one = F.try_variant_get(value, "$", kind)
    none = F.array().cast(f"array<{kind}>")
    return F.when(value.isNull() | F.is_variant_null(value), none).when(shape.startswith("ARRAY"), F.coalesce(many, none)).otherwise(F.filter(F.array(one), lambda x: x.isNotNull()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, project, workspace, searches) of a file or folder of bundles, a bundle a file; what is no JSON object is passed over. Staged."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("bundle"), F.try_parse_json("value").alias("v"))
    project = F.try_variant_get("v", "$.project", "struct<name string, description string>")
    workspace = F.try_variant_get("v", "$.workspace", "struct<claim_text string, structure string, nodes string, edges string>")
    search = "struct<id bigint, query string, strategy string, analyses variant>"
    searches = listed(F.try_variant_get("v", "$.searches", "variant"), search)
    analysis = "struct<id bigint, strategy string, result string>"
    whole = F.transform(
        searches,
        lambda s: F.struct(s["id"].alias("id"), s["query"].alias("query"), s["strategy"].alias("strategy"), listed(s["analyses"], analysis).alias("analyses")),
    )
    rows = files.filter(project.isNotNull()).select("bundle", project.alias("project"), workspace.alias("workspace"), whole.alias("searches"))
    return staging.stage(rows)


def _numbered(rows: DataFrame, order: list, high: int) -> DataFrame:
    from ..operators import store

    return store.with_ids(rows, order, high)


def renumbered(held: DataFrame, high: dict[str, int]) -> dict[str, DataFrame]:
    """Rows of each table of ``TABLES`` under ids that go on from ``high``; old ids are joined away."""
    projects = _numbered(held.select("bundle", "project.*"), ["bundle"], high["projects"])
    of = projects.select("bundle", F.col("id").alias("project_id"))
    spaces = held.filter("workspace is not null").select("bundle", "workspace.*").join(of, "bundle")
    found = held.select("bundle", F.posexplode("searches").alias("place", "s"))
    searches = _numbered(found.select("bundle", "place", "s.query", "s.strategy"), ["bundle", "place"], high["search_history"])
    names = searches.select("bundle", "place", F.col("id").alias("search_id"))
    links = names.join(of, "bundle")
    analyses = found.select("bundle", "place", F.posexplode("s.analyses").alias("k", "a")).join(names, ["bundle", "place"]).select("search_id", "k", "a.strategy", "a.result")
    return {
        "projects": projects.drop("bundle"),
        "project_workspace": _numbered(spaces.drop("bundle"), ["project_id"], high["project_workspace"]),
        "search_history": searches.drop("bundle", "place"),
        "project_searches": _numbered(links.select("project_id", "search_id"), ["project_id", "search_id"], high["project_searches"]),
        "analysis_results": _numbered(analyses, ["search_id", "k"], high["analysis_results"]).drop("k"),
    }
