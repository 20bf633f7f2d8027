"""The search from candidates to charts, and the analysis of a document, as lazy plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import bm25, candidates, chunking, claims, fusion, replies, staging, structure

RERANKED, CHARTED, STORED, BATCH = 100, 5, 50, 10


@dataclass(frozen=True)
class Settings:
    per_source: int = 25
    rrf_k: int = 60
    rerank: bool = True
    check_urls: bool = False


@dataclass(frozen=True)
class Query:
    text: str
    claim: str = ""
    cutoff: str | None = None
    search_queries: list[str] = field(default_factory=list)


def merged(stored: dict, patch: dict) -> Settings:
    """Settings of a stored object, which replaces the defaults as a whole, under a patch."""
    return Settings(**({**stored, **patch}))


def retrieve(docs: DataFrame, query: Query, settings: Settings = Settings(), number: str = "patentNumber") -> DataFrame:
    """Candidates without repeats and up to the cut-off, ranked by fused BM25 and TF-IDF ranks: the columns of ``docs`` with scores and ``rank``."""
    kept = candidates.before_cutoff(candidates.dedup(docs, number), query.cutoff)
    text = candidates.document_text(F.col("title"), F.col("abstract"), F.coalesce("claims", F.lit("")))
    corpus = staging.stage(kept.select("doc_ord", text.alias("text")))
    ranked = fusion.hybrid(corpus, query.text, "doc_ord", "text", settings.rrf_k)
    order = Window.orderBy(F.desc("rrf_score"), "doc_ord")
    best = ranked.orderBy(F.desc("rrf_score"), "doc_ord").limit(max(RERANKED, STORED)).withColumn("rank", F.row_number().over(order))
    return best.join(kept, "doc_ord")


def rerank_batches(hits: DataFrame) -> DataFrame:
    """(batch, ids) of the hits to be judged, ten a batch, by rank."""
    top = hits.filter(F.col("rank") <= RERANKED).withColumn("batch", F.floor((F.col("rank") - 1) / BATCH))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return top.groupBy("batch").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))


def reranked(hits: DataFrame, model_replies: DataFrame | None) -> DataFrame:
    """Scores of hits from (batch, reply), with ``stage2_rank``; without replies from their RRF scores."""
    if model_replies is None:
        scored = hits.select("id", S.plain_score(F.col("rrf_score")).cast("int").alias("weighted_score"), F.col("rank"))
    else:
        judged = replies.rerank(rerank_batches(hits).join(model_replies, "batch"), hits.select("id", "title", "abstract", "claims", "rrf_score"))
        scored = judged.join(hits.select("id", "rank"), "id")
    return scored.withColumn("stage2_rank", F.row_number().over(Window.orderBy(F.desc("weighted_score"), "rank"))).drop("rank")


def chart_inputs(hits: DataFrame, scores: DataFrame, claim: str) -> DataFrame:
    """The first five hits by their first rank, with their scores and the claim's elements."""
    parts = claims.elements(F.lit(claim))
    return hits.filter(F.col("rank") <= CHARTED).join(scores, "id", "left").withColumn("elements", parts)


def shown_score(weighted, rrf):
    return F.coalesce(weighted, S.plain_score(rrf).cast("int"))


def analyse(docs: DataFrame, year_now: int, id_col: str = "doc_id", text_col: str = "text", rule: str = "compat"):
    """Sections, chunks, claims, figures and dates of documents: a dict of DataFrames."""
    cut = docs.select(id_col, structure.section_array(F.col(text_col), rule).alias("s"))
    parsed = staging.stage(cut.withColumn("c", chunking.section_chunks(F.col("s"))))
    claims_of = F.array_join(F.transform(F.filter("s", lambda x: x["type"] == "claims"), lambda x: x["text"]), "\n")
    split = parsed.filter(claims_of != "").select(id_col, F.posexplode(structure.split_claims(claims_of)).alias("pos", "text"))
    split = split.select(id_col, (F.col("pos") + 1).alias("num"), "text", claims.parent(F.col("text")).alias("parent"))
    described = F.array_join(F.transform(F.filter("s", lambda x: x["type"] == "figures_description"), lambda x: x["text"]), "\n")
    figures = parsed.select(id_col, F.inline(structure.figure_links(F.col("c"), structure.figures(described))))
    heads = docs.select(id_col, structure.title(F.col(text_col)).alias("title"), structure.document_date(F.col(text_col), year_now).alias("date"))
    return {"sections": parsed.select(id_col, F.inline("s")), "chunks": parsed.select(id_col, F.inline("c")), "claims": split, "figures": figures, "heads": heads}


def evidence(chunk_table: DataFrame, claim_table: DataFrame, top_k: int = 8) -> DataFrame:
    """(num, chunk_id, score, rank): the best chunks of each (num, text) claim by BM25."""
    scored = bm25.scores_of_queries(chunk_table, claim_table.select(F.col("num").alias("query_id"), F.col("text").alias("query")), "chunk_id")
    ranked = bm25.ranked(scored.withColumn("score", F.round("score", 6)), "id", ["query_id"]).filter(F.col("rank") <= top_k)
    return ranked.select(F.col("query_id").alias("num"), F.col("id").alias("chunk_id"), "score", "rank")


def retrieve_from_sections(chunk_table: DataFrame, query: str, types: list[str], top_k: int = 5) -> DataFrame:
    """The best chunks of some section types; statistics are those of these sections alone."""
    part = chunk_table.filter(F.col("sectionType").isin(types))
    return bm25.scores(part, query, "chunk_id").orderBy(F.desc(F.round("score", 6)), "chunk_id").limit(top_k)


def query_elements(claim: str):
    return claims.elements(F.lit(claim))


def claim_query(text: str, claim: str) -> F.Column:
    """The query of a claim: its text and its elements' texts."""
    return candidates.query_text(F.lit(text), F.transform(query_elements(claim), lambda e: e["text"]))


def english_query(text: str) -> str:
    return T.english_terms(text)
