"""Replies of language models as data: JSON out of text, rerank scores, charts, enrichments.

A reply is an input column; calling a model is the business of ``plans.providers``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T

RERANK = "array<struct<id string, elements array<struct<id string, score double, evidence string>>, importanceWeights map<string,double>, noveltyThreat boolean, inventivenessThreat boolean, reasoning string>>"
CHART = "struct<rows array<struct<elementId string, priorArtText string, similarity double, verdict string, reasoning string>>, summary string>"
ENRICH = (
    "struct<components array<struct<name string, technicalConcepts array<string>, functionalRoles array<string>, synonyms array<string>, "
    "effects array<string>, supportingText string>>, overallPurpose string, technicalDomain string, searchQueries array<string>>"
)
FENCE = r"(?s)```(?:json)?\s*(.+?)```"
JSON_FENCE = r"(?s)```json\s*(.*?)\s*```"


def json_object(raw: Column) -> Column:
    """The JSON object in a reply: all of it, what a code fence holds, or from the first to the last brace; else null."""
    c = T.trim(raw)
    return (
        F.when(c.startswith("{"), c)
        .when(c.rlike(FENCE), T.trim(F.regexp_extract(c, FENCE, 1)))
        .when(c.rlike(r"(?s)\{.*\}"), F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    )


def json_list(raw: Column) -> Column:
    """The JSON in a rerank reply: fenced, else the outermost array, else the outermost object; else null."""
    return (
        F.when(raw.rlike(JSON_FENCE), F.regexp_extract(raw, JSON_FENCE, 1))
        .when(raw.rlike(r"(?s)\[.*\]"), F.regexp_extract(raw, r"(?s)(\[.*\])", 1))
        .when(raw.rlike(r"(?s)\{.*\}"), F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    )


def parsed(json: Column, schema: str) -> Column:
    """Null where the JSON can't be read (``from_json`` alone gives a struct of nulls)."""
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, schema))


def rerank(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores of candidates from replies.

    ``batches``: (batch, reply, ids array<string>), ``docs``: (id, title, abstract, claims, rrf_score). Gives id,
    element_scores, weighted_score, novelty_threat, inventiveness_threat, reasoning. An item of an unknown id counts for the first document of its
    batch; documents of a batch without readable reply get a score from their RRF score.
    """
    read = batches.withColumn("items", parsed(json_list(F.col("reply")), RERANK))
    item = read.filter("items is not null").select("ids", F.explode("items").alias("i"))
    named = item.withColumn("id", F.when(F.array_contains("ids", F.col("i.id")), F.col("i.id")).otherwise(F.get("ids", 0)))
    joined = named.join(docs, "id")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("claims", F.lit("")))
    scored = F.transform(
        F.coalesce("i.elements", F.array().cast("array<struct<id string, score double, evidence string>>")),
        lambda e: F.struct(
            e["id"].alias("id"), S.clamp(F.coalesce(e["score"], F.lit(0.0)), 0.0, 100.0).alias("score"), S.valid_evidence(F.coalesce(e["evidence"], F.lit("")), text).alias("evidence")
        ),
    )
    weights = F.coalesce("i.importanceWeights", F.create_map().cast("map<string,double>"))
    good = joined.withColumn("element_scores", scored).withColumn("weighted_score", S.weighted_score(F.col("element_scores"), weights))
    good = good.select(
        "id",
        "element_scores",
        "weighted_score",
        S.novelty_threat(F.col("i.noveltyThreat"), F.col("weighted_score")).alias("novelty_threat"),
        S.inventiveness_threat(F.col("i.inventivenessThreat"), F.col("weighted_score")).alias("inventiveness_threat"),
        F.coalesce("i.reasoning", F.lit("")).alias("reasoning"),
    )
    lost = read.filter("items is null").select(F.explode("ids").alias("id")).join(docs, "id")
    bad = lost.select(
        "id",
        F.array().cast("array<struct<id string, score double, evidence string>>").alias("element_scores"),
        S.fallback_score(F.col("rrf_score")).cast("int").alias("weighted_score"),
        F.lit(False).alias("novelty_threat"),
        F.lit(False).alias("inventiveness_threat"),
        F.lit("(no readable reply; score from rank fusion)").alias("reasoning"),
    )
    return good.unionByName(bad)


def first_by_id(rows: Column, id_field: str, wanted: Column) -> Column:
    return F.try_element_at(F.filter(rows, lambda r: r[id_field] == wanted), F.lit(1))


def chart(elements: Column, scores: Column, reasoning: Column) -> Column:
    """Rows of a comparison chart from rerank scores: array<struct<id, importance, prior_art, similarity, verdict, reasoning>>."""

    def row(e: Column) -> Column:
        s = first_by_id(scores, "id", e["id"])
        sim = F.coalesce(s["score"], F.lit(0.0)) / 100
        return F.struct(
            e["id"].alias("id"), e["importance"].alias("importance"), F.coalesce(s["evidence"], F.lit("")).alias("prior_art"), sim.alias("similarity"), S.verdict(sim).alias("verdict"), reasoning.alias("reasoning")
        )

    return F.transform(elements, row)


def chart_from_reply(elements: Column, reply: Column) -> Column:
    """The same from a model's chart reply; a model's verdict wins; without a readable reply nothing is covered."""
    got = parsed(F.coalesce(F.when(reply.rlike(JSON_FENCE), F.regexp_extract(reply, JSON_FENCE, 1)), F.regexp_extract(reply, r"(?s)(\{.*\})", 1)), CHART)

    def row(e: Column) -> Column:
        r = first_by_id(got["rows"], "elementId", e["id"])
        sim = F.coalesce(r["similarity"], F.lit(0.0)) / 100
        return F.struct(
            e["id"].alias("id"),
            e["importance"].alias("importance"),
            F.coalesce(r["priorArtText"], F.lit("")).alias("prior_art"),
            sim.alias("similarity"),
            F.coalesce(r["verdict"], S.verdict(sim)).alias("verdict"),
            F.when(got.isNull(), "(analysis failed)").otherwise(F.coalesce(r["reasoning"], F.lit(""))).alias("reasoning"),
        )

    return F.transform(elements, row)


def overall_similarity(rows: Column) -> Column:
    """Importance-weighted mean of a chart's similarities."""
    total = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["similarity"] * r["importance"])
    mass = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["importance"].cast("double"))
    return F.coalesce(F.try_divide(total, mass), F.lit(0.0))


def charts(df: DataFrame, elements: str = "elements", scores: str = "element_scores", reasoning: str = "reasoning", reply: str = "chart_reply") -> DataFrame:
    """``df`` with chart rows, overall similarity and risks: from rerank scores where there is one for each element, else from ``reply``."""
    fast = F.size(scores) == F.size(elements)
    rows = F.when(fast, chart(F.col(elements), F.col(scores), F.col(reasoning))).otherwise(chart_from_reply(F.col(elements), F.coalesce(reply, F.lit(""))))
    out = df.withColumn("rows", rows).withColumn("overall_similarity", overall_similarity(F.col("rows")))
    sim = F.col("overall_similarity")
    return out.withColumn("novelty_risk", S.novelty_risk(sim)).withColumn("inventiveness_risk", S.inventiveness_risk(sim))


def enrichment(reply: Column, claim: Column, number: Column) -> Column:
    """struct<components, overallPurpose, technicalDomain, searchQueries>: a reply, or the least that can be said of a claim.

    The claim's first 200 characters are always a query, seven queries are kept; without components one stands for the claim.
    """
    got = parsed(json_object(reply), ENRICH)
    head = F.substring(claim, 1, 200)
    none = F.array().cast("array<string>")

    def component(name: Column) -> Column:
        return F.array(F.struct(name.alias("name"), *(none.alias(k) for k in ("technicalConcepts", "functionalRoles", "synonyms", "effects")), F.lit("").alias("supportingText")))

    def clean(c: Column) -> Column:
        lists = (F.filter(F.coalesce(c[k], none), lambda x: x.isNotNull() & (x != "")).alias(k) for k in ("technicalConcepts", "functionalRoles", "synonyms", "effects"))
        return F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), *lists, F.coalesce(c["supportingText"], F.lit("")).alias("supportingText"))

    queries = F.filter(F.coalesce(got["searchQueries"], none), lambda x: x.isNotNull() & (x != ""))
    queries = F.slice(F.when(F.array_contains(queries, head), queries).otherwise(F.array_append(queries, head)), 1, 7)
    whole = F.concat(F.lit("claim "), number.cast("string"))
    parts = F.when(F.size(F.coalesce(got["components"], F.array().cast("array<struct<name string, technicalConcepts array<string>, functionalRoles array<string>, synonyms array<string>, effects array<string>, supportingText string>>"))) > 0, F.transform(got["components"], clean)).otherwise(component(whole))
    return F.struct(
        parts.alias("components"),
        F.coalesce(got["overallPurpose"], F.lit("")).alias("overallPurpose"),
        F.coalesce(got["technicalDomain"], F.lit("")).alias("technicalDomain"),
        queries.alias("searchQueries"),
    )


def key_terms(components: Column) -> Column:
    """Distinct names and synonyms longer than one character, 30 at most."""
    words = F.flatten(F.transform(components, lambda c: F.concat(F.array(c["name"]), c["synonyms"])))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), 1, 30)


def preferred_first(chunks: DataFrame, preferred: list[str], kind: str = "sectionType", rank: str = "rank", n: int = 8) -> DataFrame:
    """The first ``n`` chunks by rank, those of preferred sections before all others."""
    return chunks.orderBy(F.when(F.col(kind).isin(preferred), 0).otherwise(1), rank).limit(n)
