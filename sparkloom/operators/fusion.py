"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import bm25, inverted, ranking, staging, tfidf

K = 60


def fuse(docs: DataFrame, first: DataFrame, second: DataFrame, id_col: str = "doc_id", k: int = K) -> DataFrame:
    """(id, first_rank, second_rank, rrf) of all docs from two (id, rank) lists; a document that a list lacks ranks N + 1 there."""
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    joined = (
        docs.select(id_col)
        .join(first.select(id_col, F.col("rank").alias("r1")), id_col, "left")
        .join(second.select(id_col, F.col("rank").alias("r2")), id_col, "left")
        .crossJoin(n)
    )
    r1, r2 = F.coalesce("r1", F.col("n") + 1), F.coalesce("r2", F.col("n") + 1)
    return joined.select(id_col, r1.alias("first_rank"), r2.alias("second_rank"), (1 / (F.lit(k) + r1) + 1 / (F.lit(k) + r2)).alias("rrf"))


def hybrid(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k: int = K, digits: int = 6) -> DataFrame:
    """Lexical and vector ranks of every document, fused: (id, bm25_score, vector_score, bm25_rank, vector_rank, rrf_score).

    Scores are rounded to ``digits`` before ranking, so that ties are the same on every engine; ties keep id order.
    """
    index = staging.stage(bm25.index(docs, id_col, text_col))
    score = F.round("score", digits).alias("score")
    lexical = bm25.scores_from(index, [query]).select("id", F.get("scores", 0).alias("score"))
    lists = [ranking.rank_all(x.select("id", score), "score", "id") for x in (lexical, tfidf.similarities_from(index, query))]
    one, two = (x.select("id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank")) for name, x in zip(("bm25", "vector"), lists, strict=True))
    r1, r2 = F.col("bm25_rank"), F.col("vector_rank")
    # both lists have every document, so no rank is missing
    rrf = F.round(1 / (F.lit(k) + r1) + 1 / (F.lit(k) + r2), 9)
    return one.join(two, "id").select(F.col("id").alias(id_col), "bm25_score", "vector_score", r1, r2, rrf.alias("rrf_score"))


def multi_query(docs: DataFrame, queries: list[str], original: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): sum over queries of 1 / (60 + rank); without a query that is not blank, the BM25 scores of ``original``.

    Texts are read once for any number of queries. A query without a term ranks nothing.
    """
    queries = [q for q in queries if q.strip()]
    if not queries:
        return bm25.scores(docs, original, id_col, text_col)
    queries = [q for q in queries if T.tokenize_literal(q)]
    if not queries:
        return bm25.scores(docs, "", id_col, text_col)
    scored = bm25.scores_from(staging.stage(bm25.index(docs, id_col, text_col)), queries)
    lists = scored.select(F.col("id").alias(id_col), F.posexplode("scores").alias("_list", "score")).withColumn("score", F.round("score", 6))
    ranked = ranking.rank_lists(staging.stage(lists), "_list", "score", id_col)
    # parts are added in the order of the lists, so that sums are the same each time
    part = F.struct("_list", (1 / (F.lit(K) + F.col("rank"))).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])
    return ranked.groupBy(id_col).agg(F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 9).alias("score"))


def multi_query_chunks(chunks: DataFrame, queries: DataFrame, top_k: int = 8, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, score, rank) of the best ``top_k`` chunks: each (query_id, query) gives its first min(2 * top_k, 20) by BM25.

    Ties keep the order in which chunks are first seen, by query and rank.
    """
    most = min(2 * top_k, 20)
    scored = staging.stage(inverted.top_k(inverted.build(chunks, id_col, text_col), queries, most).drop("rank"))
    # every chunk has a score, so a query with few hits goes on with the first chunks without one: a bounded list of ids has enough
    some = chunks.select(F.col(id_col).alias("id")).orderBy("id").limit(2 * most)
    blank = queries.select("query_id").distinct().crossJoin(F.broadcast(some)).join(scored, ["query_id", "id"], "left_anti")
    ranked = bm25.ranked(scored.unionByName(blank.withColumn("score", F.lit(0.0))), "id", ["query_id"]).filter(F.col("rank") <= most)
    fused = ranked.groupBy("id").agg(F.round(F.sum(1 / (F.lit(K) + F.col("rank"))), 9).alias("score"), F.min(F.struct("query_id", "rank")).alias("seen"))
    best = fused.orderBy(F.desc("score"), "seen").limit(top_k)
    w = Window.orderBy(F.desc("score"), "seen")
    return best.select(F.col("id").alias(id_col), "score", F.row_number().over(w).cast("long").alias("rank"))
