"""Chunks of sentences with overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEAST, MOST, OVERLAP, SHORTEST = 700, 1200, 150, 50


def chunk_array(text: Column, offset: Column) -> Column:
    """array<struct<text, charStart, charEnd>> of a text; none for texts shorter than 50 characters.

    Sentences gather until another would make more than 1200 characters and there are 700 (so a chunk may be longer);
    gathered texts shorter than 50 characters are dropped. Places count gathered characters from ``offset``.
    """
    one = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("charStart"), F.lit(0).cast("long").alias("charEnd"))
    start = F.struct(F.lit("").alias("buf"), offset.cast("long").alias("at"), F.slice(F.array(one), 1, 0).alias("out"))

    def flushed(a: Column) -> Column:
        clean = T.trim(a["buf"])
        chunk = F.struct(clean.alias("text"), a["at"].alias("charStart"), (a["at"] + F.length(a["buf"])).alias("charEnd"))
        return F.when(F.length(clean) >= SHORTEST, F.array_append(a["out"], chunk)).otherwise(a["out"])

    def step(a: Column, s: Column) -> Column:
        full = (F.length(a["buf"]) + F.length(s) > MOST) & (F.length(a["buf"]) >= LEAST)
        return F.struct(
            F.when(full, F.concat(s, F.lit(" "))).otherwise(F.concat(a["buf"], s, F.lit(" "))).alias("buf"),
            F.when(full, a["at"] + F.length(a["buf"])).otherwise(a["at"]).alias("at"),
            F.when(full, flushed(a)).otherwise(a["out"]).alias("out"),
        )

    made = F.aggregate(T.sentences(text), start, step, flushed)
    return F.when(F.length(T.trim(F.coalesce(text, F.lit("")))) < SHORTEST, F.slice(F.array(one), 1, 0)).otherwise(made)


def overlaps(chunks: Column) -> Column:
    """The chunks with the end of the one before and the beginning of the one after."""
    def one(all_: Column, c: Column, i: Column) -> Column:
        return F.struct(
            c["text"].alias("text"),
            c["charStart"].alias("charStart"),
            c["charEnd"].alias("charEnd"),
            F.coalesce(F.right(F.get(all_, i - 1)["text"], F.lit(OVERLAP)), F.lit("")).alias("overlapBefore"),
            F.coalesce(F.left(F.get(all_, i + 1)["text"], F.lit(OVERLAP)), F.lit("")).alias("overlapAfter"),
        )

    return T.let(chunks, lambda all_: F.transform(all_, lambda c, i: one(all_, c, i)))


def section_chunks(sections: Column) -> Column:
    """array of a document's chunks from its array of (ord, type, title, text) sections; claims give none but move the places on.

    (chunk_id, sectionType, sectionTitle, text, charStart, charEnd, overlapBefore, overlapAfter); chunk_id is chunk-<number in the
    document>-<section type>. All within the row.
    """

    def placed(secs: Column) -> Column:
        sizes = F.transform(secs, lambda s: F.length(s["text"]) + F.length(s["title"]) + 2)
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        ats = F.aggregate(sizes, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        return F.zip_with(secs, ats, lambda s, at: F.struct(s["type"].alias("type"), s["title"].alias("title"), s["text"].alias("text"), at.alias("at")))

    def of_section(s: Column) -> Column:
        return F.transform(overlaps(chunk_array(s["text"], s["at"])), lambda c: F.struct(s["type"].alias("type"), s["title"].alias("title"), c.alias("c")))

    made = F.flatten(F.transform(F.filter(T.let(sections, placed), lambda s: s["type"] != "claims"), of_section))
    fields = ("text", "charStart", "charEnd", "overlapBefore", "overlapAfter")
    return F.transform(
        made,
        lambda x, k: F.struct(
            F.concat_ws("-", F.lit("chunk"), (k + 1).cast("string"), x["type"]).alias("chunk_id"),
            x["type"].alias("sectionType"),
            x["title"].alias("sectionTitle"),
            *(x["c"][f].alias(f) for f in fields),
        ),
    )


def chunks(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of a table of (id, ord, type, title, text) sections: sections of a document meet in its row first."""
    secs = F.array_sort(F.collect_list(F.struct("ord", "type", "title", "text")))
    return sections.groupBy(id_col).agg(secs.alias("s")).select(id_col, F.inline(section_chunks(F.col("s"))))


def relevant_passages(text: Column, claim: Column, most: int = 6000) -> Column:
    """The paragraphs of a text that hold most keywords of a claim, up to ``most`` characters, in the order of the text.

    A paragraph that no longer fits is passed over; paragraphs without a keyword never count. Without keywords, or without a
    paragraph taken, the beginning of the text.
    """

    def choose(words: Column, paras: Column) -> Column:
        scored = F.transform(
            paras,
            lambda p, i: F.struct((-F.size(F.filter(words, lambda w: F.contains(F.lower(p), w)))).alias("score"), i.alias("pos"), p.alias("p")),
        )
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

        def step(a: Column, s: Column) -> Column:
            fits = (s["score"] < 0) & (a["used"] + F.length(s["p"]) <= most)
            return F.struct(
                F.when(fits, a["used"] + F.length(s["p"]) + 2).otherwise(a["used"]).alias("used"),
                F.when(fits, F.array_append(a["taken"], s["pos"])).otherwise(a["taken"]).alias("taken"),
            )

        taken = F.aggregate(F.array_sort(scored), start, step, lambda a: F.array_sort(a["taken"]))
        return F.array_join(F.transform(taken, lambda i: F.get(paras, i)), "\n\n")

    joined = T.let(T.keywords(claim), lambda words: T.let(T.paragraphs(text), lambda paras: choose(words, paras)))
    # without keywords no paragraph has a score, so nothing is taken
    return T.let(joined, lambda j: F.when(j == "", T.trim(F.substring(text, 1, most))).otherwise(j))
