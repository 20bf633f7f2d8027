"""Queries that return every row of their table, against plain Python, and the literal rows of operators."""

import hashlib
import re

from pyspark.sql import functions as F

from sparkloom.operators import chunking, claims, structure
from sparkloom.plans.catalog import QUERIES
from sparkloom.sources import replies as sources

MARK = r"[（(][가-힣a-zA-Z0-9][)）]|[0-9]+\.\s|[A-Z]\.\s|[-•·]\s"
CLAIMS = [
    "A device comprising:\n(a) first part\n(b) second part\n- third; 12. fourth",
    "a frame with a wheel; (a) ; B. a motor; - a long enough tail",
    "a device with a frame, comprising a sensor unit; a controller unit",
    "tiny; bits",
    "tiny",
    "",
    "one line of plain words",
    " ; ".join(f"part number {k} of it" for k in range(30)),
    "\n".join(f"{k}. step" for k in range(1, 40)),
]


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain_elements(text):
    text = text.strip()
    parts = [p for p in re.split(rf"(?:\n|\s*[;；]\s*)(?={MARK})", text) if p.strip()]
    if len(parts) > 1:
        out = []
        for i, p in enumerate(parts):
            m = re.match(r"[（(]([가-힣a-zA-Z0-9])[)）]\s*|([A-Z0-9])\.\s+|[-•·]\s+", p)
            name = m and (m.group(1) or m.group(2)) or chr(65 + i)
            out.append((name, p[m.end() if m else 0 :].strip()))
        out = [x for x in out if x[1]]
    else:
        kept = [p for p in re.split(r"(?i)[;；]|,\s*(?=그리고|및|또는|wherein|and|comprising)", text) if len(p.strip()) > 10]
        out = [(chr(65 + i) if i < 26 else str(i + 1), p.strip()) for i, p in enumerate(kept)]
    return out or [("A", text)]


def write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")


def test_elements_of_all_rows(spark, tmp_path):
    write(spark, tmp_path, "documents", [*enumerate(CLAIMS), (99, None)], "doc_id long, text string")
    write(spark, tmp_path, "benchmark", list(enumerate(CLAIMS)), "item_id long, text string")
    got = {r.doc_id: (r.n, r.h, r.last_id) for r in QUERIES["claim_elements"](spark, str(tmp_path)).collect()}
    want = {k: plain_elements(t) for k, t in enumerate(CLAIMS)}
    assert got.pop(99) == (1, md5(""), "A")
    assert got == {k: (len(e), md5("|".join(x for _, x in e)), e[-1][0]) for k, e in want.items()}
    got = {r.item_id: r.q for r in QUERIES["query_elements"](spark, str(tmp_path)).collect()}
    assert got == {k: " ".join([t, *(x for _, x in want[k])]) for k, t in enumerate(CLAIMS)}


def test_elements_of_the_driver_tables(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n, r.h) for r in QUERIES["claim_elements"](spark, d).collect()}
    docs = {r.doc_id: plain_elements(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert got == {k: (len(e), md5("|".join(x for _, x in e))) for k, e in docs.items()}
    assert len(got) == 1000
    assert QUERIES["query_elements"](spark, d).count() == spark.read.parquet(f"{d}/benchmark.parquet").count()


MANY = "\n".join(f"Claim {k}. The frame of claim {k - 1}, wherein part {k} is red." for k in range(2, 400))
TEXTS = {
    1: "(22) 2019.3.7 and 공개일 2020-01-02\n[Abstract]\nIt works as FIG.2a and 도1 tell, and there is more of it at some length here.\nClaims\nClaim 1. A frame.\nClaim 2. The frame of claim 1, wherein it is red.\n"
    "Brief Description of Drawings\nFIG. 2a shows a view\nFIG. 9 is unused",
    2: "1. one\n2) two",
    3: " no marks ",
    4: "",
    5: None,
    6: "Claim 1. A frame.\n" + MANY,
    7: "(30) 1970.01.01 (22) 2001-2-3",
    8: "x" * 7000 + " 1999-09-09",
}


def test_text_operators_over_all_documents(spark, tmp_path):
    write(spark, tmp_path, "documents", list(TEXTS.items()), "doc_id long, text string")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.n, r.h) for r in run("document_claims")}
    tail = "\nBrief Description of Drawings\nFIG. 2a shows a view\nFIG. 9 is unused"
    many = ["A frame."] + [f"The frame of claim {k - 1}, wherein part {k} is red." for k in range(2, 400)]
    parts = {1: ["A frame.", "The frame of claim 1, wherein it is red." + tail], 2: ["one", "two"], 3: ["no marks"], 4: [], 5: [], 6: many, 7: [TEXTS[7]], 8: [TEXTS[8]]}
    assert got == {k: (len(v), md5("|".join(v))) for k, v in parts.items()}
    got = {r.doc_id: (r.parents, r.graph_parents) for r in run("document_claim_parents")}
    chain = ",".join(["-", *(str(k - 1) for k in range(2, 400))])
    # the graph's English wording needs the comma right after the number
    assert got == {1: ("-,1", "-,1"), 2: ("-,-", "-,-"), 3: ("-", "-"), 4: ("", ""), 5: ("", ""), 6: (chain, chain), 7: ("-", "-"), 8: ("-", "-")}
    got = {r.doc_id: r.date for r in run("document_bib_dates")}
    assert got == {1: "2019-03-07", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "2001-02-03", 8: None}
    rows = run("document_headings")
    assert len(rows) == sum(len((t or "").split("\n")) for t in TEXTS.values())
    assert {(r.doc_id, r.pos, r.kind) for r in rows if r.kind} == {(1, 1, "abstract"), (1, 3, "claims"), (1, 6, "figures_description")}
    got = {r.doc_id: (r.n, r.figures) for r in run("document_figures")}
    assert got.pop(1) == (3, "도 1||chunk-1-abstract;FIG. 2a|a view|chunk-1-abstract;FIG. 9|unused|")
    assert got == {k: (0, "") for k in TEXTS if k > 1}


def test_literal_rows(spark):
    """Single rows of operators that queries apply to whole tables."""

    def rows(values, make):
        df = spark.createDataFrame(list(enumerate(values, 1)), "k int, t string")
        return [tuple(r)[1:] for r in df.select("k", *make(F.col("t"))).orderBy("k").collect()]

    deps = ["The device of claim 1, wherein x", "according to claim 2 comprising y", "제3항에 있어서", "A device with a frame", "청구항 3에 따른 장치", "method of claim 12 of steel", "제2항 내지 제4항 중 어느 한 항에 있어서"]
    assert [p for (p,) in rows(deps, lambda t: [claims.parent(t)])] == [1, None, 3, None, 3, 12, 2]
    heads = ["SUMMARY OF THE INVENTION", "ABSTRACT", "Claim 1. x", "발명의", "[Background Art]", "plain sentence", "me", "x"]
    assert [k for (k,) in rows(heads, lambda t: [structure.section_type(t)])] == ["abstract", "abstract", None, "technical_field", "background", None, "solution", None]
    assert rows(["20240105", "2024-01-05", "2024", ""], lambda t: [sources.kr_date(t)]) == [("2024-01-05",), ("2024-01-05",), ("2024",), (None,)]
    dates = ["(22) 2019.3.7 and 공개일 2020-01-02", "Filing Date: 2011/12/31", "(30) 1970.01.01 (22) 2001-2-3", "no date", "seen 1999-09-09"]
    assert [x for (x,) in rows(dates, lambda t: [structure.document_date(t, 2026)])] == ["2019-03-07", "2011-12-31", "2001-02-03", None, "1999-09-09"]
    texts = ["Claim 1. A frame.\nClaim 2. The frame of claim 1, wherein it is red.", "1. one\n2) two", " no marks "]
    assert [x for (x,) in rows(texts, lambda t: [structure.split_claims(t)])] == [["A frame.", "The frame of claim 1, wherein it is red."], ["one", "two"], ["no marks"]]
    index = spark.createDataFrame([({"b": [1], "a": [0, 3]},)], "m map<string,array<int>>")
    assert index.select(sources.inverted_text(F.col("m"))).first()[0] == "a b a"


def test_figures_within_a_row_and_between_tables(spark):
    chunks = spark.createDataFrame([(1, "c1", "FIG.2a and 도1"), (1, "c2", "config 2 is"), (1, "c3", "Figure 1")], "doc_id int, chunk_id string, text string")
    told = spark.createDataFrame([(1, "FIG. 2a shows a view\nFIG. 9 is unused")], "doc_id int, t string")
    want = [("FIG. 2", "", "c2"), ("FIG. 2a", "a view", "c1"), ("FIG. 9", "unused", ""), ("도 1", "", "c1")]
    refs = told.select("doc_id", F.inline(structure.figures(F.col("t"))))
    between = structure.link_figures(chunks, refs).select("number", "description", F.array_join("chunk_ids", ",")).collect()
    assert sorted(map(tuple, between)) == want
    rows = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", "text")).alias("c")).join(told, "doc_id")
    within = rows.select(F.inline(structure.figure_links(F.col("c"), structure.figures(F.col("t"))))).select("number", "description", F.array_join("chunk_ids", ",")).collect()
    assert sorted(map(tuple, within)) == want and [r.number for r in within] == ["도 1", "FIG. 2", "FIG. 2a", "FIG. 9"]


def test_section_arrays_and_tables_agree(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    secs = structure.sections(docs)
    long = "One sentence of a text that goes on for a while. " * 80
    more = spark.createDataFrame([(20, f"Abstract\n{long}\nClaims\nClaim 1. x\nBackground Art\n{long}\nplain")], "doc_id long, text string")
    secs = secs.union(structure.sections(more))
    within = docs.union(more).select("doc_id", F.inline(chunking.section_chunks(structure.section_array(F.col("text")))))
    assert sorted(map(tuple, within.collect())) == sorted(map(tuple, chunking.chunks(secs).collect()))
    got = [(r.ord, r.type, r.title) for r in secs.filter("doc_id = 20").orderBy("ord").collect()]
    assert got == [(1, "abstract", "Abstract"), (2, "claims", "Claims"), (3, "background", "Background Art")]
    # the claims move the places of what follows
    starts = [r.charStart for r in within.filter("doc_id = 20").collect() if r.sectionType == "background"]
    assert min(starts) == len(long.strip()) + len("Abstract") + 2 + len("Claim 1. x") + len("Claims") + 2


def test_all_broad_terms(spark, tmp_path):
    import duckdb

    from sparkloom.plans.catalog import ORACLE

    rows = [(1, "Every part, a wheel configured to turn, or the like, 다양한 기타 등등"), (2, "bolts, etc. and any 위한 수단"), (3, "etc.x"), (4, "plain"), (5, None), (6, "fetch éall")]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in QUERIES["broad_terms"](spark, str(tmp_path)).collect()}
    assert got == {
        1: "over-broad quantifier|open-ended enumeration|means-plus-function language|광범위 수식어|개방형 열거|",
        2: "over-broad quantifier|open-ended enumeration|기능적 한정|", 3: "open-ended enumeration|", 4: "", 5: "", 6: "over-broad quantifier|",
    }
    got = {r.doc_id: r.wordings for r in QUERIES["broad_wordings"](spark, str(tmp_path)).collect()}
    assert got[2] == '"any" — over-broad quantifier|"etc" — open-ended enumeration|"위한 수단" — 기능적 한정|' and got[3] == '"etc." — open-ended enumeration|'
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(ORACLE["broad_wordings"]).fetchall())


def test_whole_benchmark_and_all_customers(spark, tmp_path):
    write(spark, tmp_path, "documents", [(k, f"word{k} stands here") for k in range(60)], "doc_id long, text string")
    items = [(k, "nothing alike") for k in range(49)] + [(50, "word50 stands"), (77, "word59 word59")]
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = {r.doc_id: r.outcome for r in QUERIES["evidence_validation"](spark, str(tmp_path)).collect()}
    # 51 items: document 49 has no item, 50 meets its own
    assert got == {k: "kept" if k in (49, 50) else "replaced" for k in range(60)}
    write(spark, tmp_path, "orders", [(k, k % 30) for k in range(90)], "o_orderkey long, o_custkey long")
    write(spark, tmp_path, "customer", [(k, f"c{k}") for k in range(30)], "c_custkey long, c_name string")
    got = {(r.o_orderkey, r.c_name) for r in QUERIES["project_searches"](spark, str(tmp_path)).collect()}
    assert got == {(k, f"c{k % 30}") for k in range(90)}


def test_every_item_is_a_query(spark, tmp_path):
    write(spark, tmp_path, "documents", [(k, f"word{k} stands here") for k in range(60)], "doc_id long, text string")
    write(spark, tmp_path, "benchmark", [(7, "word37")], "item_id long, text string")
    got = {r.rank: r.chunk_id for r in QUERIES["multi_query_chunks"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([37, *range(7)], 1))
