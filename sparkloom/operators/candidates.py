"""Candidate documents: text building, deduplication, cut-off dates, URL checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

CANDIDATE = t.StructType(
    [
        t.StructField("id", t.StringType()),
        t.StructField("patentNumber", t.StringType()),
        t.StructField("title", t.StringType()),
        t.StructField("abstract", t.StringType()),
        t.StructField("claims", t.StringType()),
        t.StructField("description", t.StringType()),
        t.StructField("inventors", t.ArrayType(t.StringType())),
        t.StructField("assignee", t.StringType()),
        t.StructField("filingDate", t.StringType()),
        t.StructField("publicationDate", t.StringType()),
        t.StructField("ipcCodes", t.ArrayType(t.StringType())),
        t.StructField("url", t.StringType()),
        t.StructField("urlValid", t.BooleanType()),
        t.StructField("source", t.StringType()),
        t.StructField("language", t.StringType()),
        t.StructField("doc_ord", t.LongType()),
    ]
)


def filled(c: Column) -> Column:
    """Null where empty."""
    return F.nullif(c, F.lit(""))


def document_text(*parts: Column) -> Column:
    """Parts joined by a space, empty ones skipped."""
    return F.concat_ws(" ", *(filled(p) for p in parts))


def excerpt(length: int, *parts: Column) -> Column:
    """Parts joined by a space, empty ones too, cut to ``length``: what a prompt shows of a document."""
    return F.substring(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)), 1, length)


def query_text(query: Column, elements: Column) -> Column:
    return F.concat_ws(" ", query, F.array_join(elements, " "))


def expanded_query(query: Column, search_queries: Column, names: Column) -> Column:
    """The query with the first three search queries and all component names."""
    return T.trim(F.concat_ws(" ", query, F.slice(search_queries, 1, 3), names))


def vector_query(purpose: Column, components: Column) -> Column:
    """Purpose, concepts, roles and synonyms of all components, blanks skipped, cut at 1000 characters."""
    words = F.flatten(F.transform(components, lambda c: F.concat(*(F.coalesce(c[k], F.array()) for k in ("technicalConcepts", "functionalRoles", "synonyms")))))
    parts = F.filter(F.concat(F.array(purpose), words), lambda w: w.isNotNull() & (w != ""))
    return F.substring(F.array_join(parts, " "), 1, 1000)


def context_text(chunks: Column, limit: int = 5000) -> Column:
    """Titled chunks (array<struct<title, text>>) up to the first whose text no longer fits."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, c: Column) -> Column:
        over = a["over"] | (a["used"] + F.length(c["text"]) > limit)
        part = F.array(F.concat(F.lit("["), c["title"], F.lit("]\n"), c["text"]))
        return F.struct(
            F.when(over, a["used"]).otherwise(a["used"] + F.length(c["text"]) + F.length(c["title"]) + 4).alias("used"),
            over.alias("over"),
            F.when(over, a["parts"]).otherwise(F.concat(a["parts"], part)).alias("parts"),
        )

    return F.aggregate(chunks, start, step, lambda a: F.array_join(a["parts"], "\n\n---\n\n"))


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_of_each(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def dedup(df: DataFrame, number: str = "patentNumber", order: str = "doc_ord") -> DataFrame:
    """The first candidate of each number, which is compared in upper case and without white space."""
    return first_per_key(df, F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), T.WS, "")), order)


def before_cutoff(df: DataFrame, cutoff: str | None, published: str = "publicationDate", filed: str = "filingDate") -> DataFrame:
    """Rows dated up to the cut-off. The filing date stands in for a missing (null) publication date; undated rows stay, unreadable dates go."""
    if not cutoff:
        return df
    date = F.coalesce(F.col(published), F.col(filed))
    known = F.coalesce(date.try_cast("date") <= F.lit(cutoff).cast("date"), F.lit(False))
    return df.filter(date.isNull() | (date == "") | known)


def url_valid(url: Column, status: Column | None = None, enabled: bool = True) -> Column:
    """False for a malformed URL; by HTTP status (below 400, or 405) where one is given; always true where checks are off."""
    if not enabled:
        return F.lit(True)
    well_formed = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))
    if status is None:
        return well_formed
    return well_formed & F.coalesce((status < 400) | (status == 405), F.lit(False))


def with_url_validity(df: DataFrame, checked: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with urlValid from (url, valid): the last verdict on a url (by ``checked_ord``, if there is one, else a good one over a bad one); urls that were not checked are not valid."""
    last = F.max_by("valid", F.struct("checked_ord", "valid")) if "checked_ord" in checked.columns else F.max("valid")
    verdicts = checked.groupBy(url).agg(last.alias("urlValid"))
    return df.drop("urlValid").join(verdicts, url, "left").withColumn("urlValid", F.coalesce("urlValid", F.lit(False)))


def in_source_order(frames: list[DataFrame], order: str = "doc_ord") -> DataFrame:
    """Candidates of several sources, one source after another, numbered by (source, place in it)."""
    tagged = [f.withColumn("source_ord", F.lit(k)) for k, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return both.withColumn(order, F.col("source_ord") * F.lit(1 << 40) + F.col(order)).drop("source_ord")
