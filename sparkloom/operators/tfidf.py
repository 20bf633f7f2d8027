"""TF-IDF cosine over a table of documents, and cosine of dense vectors."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import bm25, staging


def similarities(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document: cosine of (tf / max tf) * (ln((N + 1) / (df + 1)) + 1) weights, 0 if a norm is 0."""
    return similarities_from(staging.stage(bm25.index(docs, id_col, text_col)), query).withColumnRenamed("id", id_col)


def similarities_from(index: DataFrame, query: str) -> DataFrame:
    """(id, score) of every document of a staged index.

    Sparse: postings meet their document frequency once (broadcast while the vocabulary is small), and norms and dot products come out of
    one group-by per document, summed before its exchange. The query's largest tf counts words that no document has; its vector does not.
    """
    counts = Counter(T.tokenize_literal(query))
    most = max(counts.values(), default=1)
    stats = index.agg(F.count("*").alias("n"))
    df = bm25.postings(index).groupBy("term").agg(F.count("*").alias("df"))
    idf = staging.stage(df.crossJoin(F.broadcast(stats)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    terms = sorted(counts)
    qtf = F.create_map(*[F.lit(x) for t in terms for x in (t, counts[t] / most)]) if terms else F.create_map(F.lit(""), F.lit(0.0))
    weighed = bm25.postings(index).join(staging.small(idf), "term").withColumn("q", F.coalesce(F.try_element_at(qtf, F.col("term")), F.lit(0.0)) * F.col("idf"))
    norm_q = idf.filter(F.col("term").isin(terms)).agg(
        F.coalesce(F.sqrt(F.sum(F.pow(F.element_at(qtf, F.col("term")) * F.col("idf"), 2))), F.lit(0.0)).alias("nq")
    )
    # the document's max tf divides dot product and norm alike, so it cancels
    per_doc = weighed.groupBy("id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("nd"))
    joined = index.select("id").join(per_doc, "id", "left").crossJoin(F.broadcast(norm_q))
    return joined.select("id", F.coalesce(F.try_divide(F.col("dot"), F.col("nd") * F.col("nq")), F.lit(0.0)).alias("score"))


def cosine(a, b):
    """Cosine of two arrays of equal length, 0 if a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
