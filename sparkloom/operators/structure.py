"""Structure of long technical documents: headings, sections, claims, figures, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Headings by section type, in the order in which they are tried (fixed values).
HEADINGS = {
    "claims": "청구범위 청구항 특허청구범위 claims claimsoftheinvention",
    "abstract": "요약서 요약 abstract summary",
    "technical_field": "기술분야 발명의기술분야 technicalfield fieldoftheinvention field",
    "background": "배경기술 종래기술 기술배경 backgroundart background priorart",
    "technical_problem": "기술적과제 발명이이루고자하는기술적과제 해결하려는과제 발명의내용 발명의목적 과제 technicalproblem problemtobesolved summaryoftheinvention",
    "solution": "과제의해결수단 해결수단 발명의구성 기술적수단 solutiontoproblem meansforsolvingtheproblem disclosure",
    "effects": "발명의효과 효과 유리한효과 effectsoftheinvention advantageouseffects",
    "figures_description": "도면의간단한설명 도면설명 도면의설명 briefdescriptionofdrawings briefdescriptionoffigures drawingsdescription",
    "examples": "실시예 실시형태 구체적실시예 examples embodiments specificembodiment",
    "detailed_description": "발명을실시하기위한구체적인내용 발명의실시를위한형태 발명의상세한설명 구체적인내용 발명의설명 상세한설명 detaileddescription bestmode modeofinvention",
}
BRACKETS = r"[【】\[\]「」『』〔〕()（）]"
CLAIM_LINE = rf"(?i)^(?:청구항|claim){T.WS}*[0-9]"

#: Marks of dates in the order in which they are tried (fixed values).
DATE_MARKS = "(30)|우선권주장|(22)|심사청구일자|출원일자|공개일|공고일|등록일|출원일|Publication Date|Filing Date|Date of Patent".split("|")
DATE = r"([0-9]{4})[.\-/]([0-9]{1,2})[.\-/]([0-9]{1,2})"


def section_type(line: Column, rule: str = "compat") -> Column:
    """The section that a line heads, or null.

    ``compat`` takes the first heading, in order, that equals the line, begins it or is begun by it; ``longest`` takes the longest
    of the headings that equal or begin the line, which files headings that begin alike under their own section.
    """
    norm = F.lower(F.regexp_replace(F.regexp_replace(line, BRACKETS, ""), f"{T.WS}+", ""))

    def heads(norm: Column) -> Column:
        able = (F.length(norm) >= 2) & (F.length(norm) <= 60) & ~T.trim(line).rlike(CLAIM_LINE)
        found = F.lit(None).cast("string")
        if rule == "longest":
            pairs = sorted(((key, kind) for kind, keys in HEADINGS.items() for key in keys.split()), key=lambda x: -len(x[0]))
            for key, kind in reversed(pairs):
                found = F.when(norm.startswith(key), kind).otherwise(found)
            return F.when(able, found)
        for kind, keys in reversed(HEADINGS.items()):
            fits = F.lit(False)
            for key in keys.split():
                fits = fits | norm.startswith(key) | F.startswith(F.lit(key), norm)
            found = F.when(fits, kind).otherwise(found)
        return F.when(able, found)

    return T.let(norm, heads)


def section_array(text: Column, rule: str = "compat") -> Column:
    """array<struct<ord, type, title, text>>: the lines under each heading, without empty sections; what stands before the first is ``unknown``.

    One fold within the row: headings cut the array of lines, so neither lines nor sections are shuffled.
    """

    def cut(lines: Column, kinds: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(kinds, i).isNotNull())

        def made(heads: Column) -> Column:
            runs = F.zip_with(F.concat(F.array(F.lit(-1)), heads), F.concat(heads, F.array(F.size(lines))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            all_ = F.transform(
                runs,
                lambda r, k: F.struct(
                    k.cast("long").alias("ord"),
                    F.coalesce(F.get(kinds, r["a"]), F.lit("unknown")).alias("type"),
                    F.coalesce(T.trim(F.get(lines, r["a"])), F.lit("")).alias("title"),
                    T.trim(F.array_join(F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1), "\n")).alias("text"),
                ),
            )
            return F.filter(all_, lambda x: x["text"] != "")

        return T.let(heads, made)

    lines = F.split(text, "\n", -1)
    return T.let(lines, lambda x: T.let(F.transform(x, lambda line: section_type(line, rule)), lambda kinds: cut(x, kinds)))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "compat") -> DataFrame:
    """(id, ord, type, title, text) of every section of every document."""
    return docs.select(id_col, F.inline(section_array(F.col(text_col), rule)))


def title(text: Column) -> Column:
    """The first line longer than five characters."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n", -1), T.trim), lambda x: F.length(x) > 5), F.lit(1))


def split_claims(text: Column) -> Column:
    """Claims after marks "Claim N." at line starts, else after numbers at line starts, else the whole text."""
    marked = rf"(?i)(?:^|\n){T.WS}*(?:청구항|claim){T.WS}+[0-9]+(?:\.|{T.WS})"
    numbered = rf"(?:^|\n){T.WS}*[0-9]+[.)]{T.WS}+"

    def parts(pattern: str) -> Column:
        cut = F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001", -1)
        return F.filter(F.transform(F.slice(cut, F.lit(2), F.size(cut)), T.trim), lambda x: x != "")

    whole = F.filter(F.array(T.trim(text)), lambda x: x != "")
    return F.when(text.rlike(marked), parts(marked)).when(text.rlike(numbered), parts(numbered)).otherwise(whole)


def claims_text(secs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All claims sections of a document, in order, joined by a newline."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return secs.filter("type = 'claims'").groupBy(id_col).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


FIGURE_KO = rf"^도{T.WS}*면?{T.WS}*([0-9]+[a-zA-Z]?){T.WS}*(?:은|는|이|가|:){T.WS}*(.{{0,200}})"
FIGURE_EN = rf"(?i)^FIG\.?{T.WS}*([0-9]+[a-zA-Z]?){T.WS}+(?:is|shows|illustrates){T.WS}+(.{{0,200}})"
FIGURE = rf"(?i)(?:도{T.WS}*면?{T.WS}*[0-9]+[a-zA-Z]?)|(?:FIG\.?{T.WS}*[0-9]+[a-zA-Z]?)"


def figure_key(raw: Column) -> Column:
    """The one way in which a figure is named."""
    number = F.regexp_extract(raw, r"([0-9]+[a-zA-Z]?)", 1)
    return F.when(raw.rlike("도"), F.concat(F.lit("도 "), number)).when(raw.rlike("(?i)fig"), F.concat(F.lit("FIG. "), number)).otherwise(T.trim(raw))


def figures(text: Column) -> Column:
    """array<struct<number, description>>: described figures in line order, then others that are named, without a description."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    described = F.filter(
        F.transform(
            lines,
            lambda x: F.when(x.rlike(FIGURE_KO), F.struct(F.concat(F.lit("도 "), F.regexp_extract(x, FIGURE_KO, 1)).alias("number"), T.trim(F.regexp_extract(x, FIGURE_KO, 2)).alias("description")))
            .when(x.rlike(FIGURE_EN), F.struct(F.concat(F.lit("FIG. "), F.regexp_extract(x, FIGURE_EN, 1)).alias("number"), T.trim(F.regexp_extract(x, FIGURE_EN, 2)).alias("description"))),
        ),
        lambda x: x.isNotNull(),
    )
    named = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0)), lambda x: F.struct(figure_key(x).alias("number"), F.lit("").alias("description")))

    def firsts(all_: Column) -> Column:
        numbers = F.transform(all_, lambda x: x["number"])
        return T.let(numbers, lambda n: F.filter(all_, lambda x, k: F.array_position(n, x["number"]) == k + 1))

    return T.let(F.concat(described, named), firsts)


MENTION = rf"(?i)(?:\(?{T.WS}*도{T.WS}*면?{T.WS}*[0-9]+[a-zA-Z]?)|(?:\(?{T.WS}*FIG\.?{T.WS}*[0-9]+[a-zA-Z]?)"


def mentioned(text: Column) -> Column:
    """The different figures that a text names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), figure_key))


def figure_links(chunks: Column, refs: Column) -> Column:
    """array<struct<number, description, chunk_ids>> in the order of figure numbers: figures with the chunks that name them, described or not.

    ``chunks`` is an array of (chunk_id, text), ``refs`` of (number, description), both of one document.
    """
    found = F.flatten(F.transform(chunks, lambda c: F.transform(mentioned(c["text"]), lambda n: F.struct(n.alias("number"), c["chunk_id"].alias("chunk_id")))))
    named = F.transform(refs, lambda r: F.struct(figure_key(r["number"]).alias("number"), r["description"].alias("description")))

    def linked(found: Column, named: Column) -> Column:
        numbers = F.array_distinct(F.concat(F.transform(named, lambda r: r["number"]), F.transform(found, lambda x: x["number"])))

        def one(n: Column) -> Column:
            ids = F.transform(F.filter(found, lambda x: x["number"] == n), lambda x: x["chunk_id"])
            said = F.get(F.filter(named, lambda r: r["number"] == n), 0)["description"]
            return F.struct(figure_order(n).alias("place"), n.alias("number"), F.coalesce(said, F.lit("")).alias("description"), F.array_sort(F.array_distinct(ids)).alias("chunk_ids"))

        rows = F.array_sort(F.transform(numbers, one))
        return F.transform(rows, lambda r: F.struct(r["number"].alias("number"), r["description"].alias("description"), r["chunk_ids"].alias("chunk_ids")))

    return T.let(found, lambda x: T.let(named, lambda y: linked(x, y)))


def link_figures(chunks: DataFrame, refs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, number, description, chunk_ids) from tables of chunks (id, chunk_id, text) and figures (id, number, description), which need not lie in one row."""
    found = chunks.select(id_col, "chunk_id", F.explode(mentioned(F.col("text"))).alias("number"))
    linked = found.groupBy(id_col, "number").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return (
        refs.withColumn("number", figure_key(F.col("number")))
        .join(linked, [id_col, "number"], "full")
        .select(id_col, "number", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    )


def figure_order(number: Column) -> Column:
    return F.coalesce(F.regexp_replace(number, "[^0-9]", "").try_cast("int"), F.lit(0))


def document_date(text: Column, year_now: int) -> Column:
    """The date YYYY-MM-DD of a document's bibliographic part: after the first mark that has one near, else the first date.

    Only the first place of each mark counts, with the date at most 120 characters from its start; years run from 1981 to the next.
    """
    head = F.substring(text, 1, 6000)

    def dated(c: Column) -> Column:
        year, month, day = (F.regexp_extract(c, DATE, k) for k in (1, 2, 3))
        good = c.rlike(DATE) & year.try_cast("int").between(1981, year_now + 1)
        return F.when(good, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))

    near = [F.when(F.locate(m, head) > 0, F.substr(head, F.locate(m, head), F.lit(120))) for m in DATE_MARKS]
    return F.coalesce(*(dated(c) for c in near), dated(head))
