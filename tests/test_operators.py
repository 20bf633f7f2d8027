"""Inline documents with results worked out by hand, and plain-Python versions of what SQL cannot say."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scoring as S
from sparkloom.functions import text as T
from sparkloom.operators import bm25, candidates, chunking, claims, diff, fusion, ranking, replies, store, structure, tfidf
from sparkloom.plans import providers, report, search
from sparkloom.sources import replies as sources
from sparkloom.streaming import deltas


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


CORPUS = [(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


def test_tokens(spark):
    text = "특허청 a-b (x) the 검색"
    want = ["특허", "허청", "특허청", "a-b", "검색", "검색"]
    assert one(spark, T.tokenize(F.col("t")), t=text) == want == T.tokenize_literal(text)
    assert one(spark, T.tokenize(F.col("t")), t=None) == T.tokenize_literal(None) == []
    assert one(spark, T.tokenize(F.col("t")), t="가 A Bcd　e") == T.tokenize_literal("가 A Bcd　e") == ["bcd"]


@pytest.mark.parametrize("query,want", [("alpha gamma", [0.470004, 1.379143, 0]), ("alpha alpha gamma", [0.940007, 1.957609, 0])])
def test_bm25(corpus, query, want):
    got = {r.doc_id: round(r.score, 6) for r in bm25.scores(corpus, query).collect()}
    assert [got[k] for k in (1, 2, 3)] == want
    qs = corpus.sparkSession.createDataFrame([(7, query)], "query_id int, query string")
    many = {r.id: round(r.score, 6) for r in bm25.scores_of_queries(corpus, qs).collect()}
    assert many == {k: v for k, v in got.items() if v}


def test_bm25_edges(corpus, spark):
    assert bm25.scores(corpus, "the , of").count() == 0
    assert bm25.scores(corpus.limit(0), "alpha").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.score for r in bm25.scores(nulls, "alpha").collect()] == [0.0, 0.0]


@pytest.mark.parametrize("query,want", [("alpha gamma", [0.366447, 0.943086, 0]), ("delta zzz", [0, 0, 1])])
def test_tfidf(corpus, query, want):
    got = {r.doc_id: round(r.score, 6) for r in tfidf.similarities(corpus, query).collect()}
    assert [got[k] for k in (1, 2, 3)] == want


def test_fusion(corpus):
    got = {r.doc_id: r for r in fusion.hybrid(corpus, "alpha gamma").collect()}
    assert [round(got[k].rrf_score, 6) for k in (2, 1, 3)] == [0.032787, 0.032258, 0.031746]
    empty = corpus.select("doc_id", F.lit(1).cast("long").alias("rank")).limit(0)
    full = corpus.select("doc_id", F.col("doc_id").alias("rank"))
    rows = fusion.fuse(corpus, full, empty).collect()
    assert all(r.rrf == pytest.approx(1 / (60 + r.doc_id) + 1 / 64) for r in rows)
    assert {(r.doc_id, round(r.rrf, 12)) for r in rows} == {(r.doc_id, round(r.rrf, 12)) for r in fusion.fuse(corpus, empty, full).collect()}
    ties = fusion.hybrid(corpus, "delta zzz").orderBy("bm25_rank").collect()
    assert [r.doc_id for r in ties] == [3, 1, 2]
    assert fusion.multi_query(corpus, [" "], "delta").count() == 3


def test_rank_all(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 8)
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 0.0, 0.5, rng.random()])) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, score double").repartition(3)
    got = {r.doc_id: r.rank for r in ranking.rank_all(df, "score", "doc_id").collect()}
    assert got == {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert ranking.rank_all(df.limit(0), "score", "doc_id").count() == 0


def test_multi_query_chunks_fill_with_first_chunks(spark, corpus):
    chunks = corpus.select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    qs = spark.createDataFrame([(0, "delta"), (1, "gamma")], "query_id int, query string")
    got = [(r.chunk_id, r.rank) for r in fusion.multi_query_chunks(chunks, qs, 3).orderBy("rank").collect()]
    # delta: 3, 1, 2; gamma: 2, 1, 3
    assert got == [("3", 1), ("2", 2), ("1", 3)]


def test_candidates(spark):
    df = spark.createDataFrame([("US 12", 0), ("us12", 1), ("US13", 2)], "patentNumber string, doc_ord long")
    assert [r.doc_ord for r in candidates.dedup(df).orderBy("doc_ord").collect()] == [0, 2]
    dates = [("2020-01-01", None), ("2020-01-02", None), (None, "2019-05-01"), (None, None), ("", "2021-01-01"), ("n/a", None)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(dates)], "k int, publicationDate string, filingDate string")
    assert [r.k for r in candidates.before_cutoff(df, "2020-01-01").orderBy("k").collect()] == [0, 2, 3, 4]
    assert candidates.before_cutoff(df, None).count() == 6
    assert one(spark, candidates.document_text(F.col("a"), F.col("b"), F.col("c")), a="x", b="", c="y") == "x y"
    assert one(spark, candidates.excerpt(3, F.col("a"), F.col("b"), F.col("c")), a="x", b=None, c="yz") == "x  "
    assert one(spark, candidates.url_valid(F.col("u")), u="not a url") is False
    chunks = F.array(*(F.struct(F.lit(t).alias("title"), F.lit("z" * n).alias("text")) for t, n in (("A", 10), ("B", 30), ("C", 1))))
    assert one(spark, candidates.context_text(chunks, 20), a="") == "[A]\n" + "z" * 10


def test_sentences_and_chunks(spark):
    got = one(spark, T.sentences(F.col("t")), t="See Fig. 1 for the layout. Next sentence here.")
    assert got == ["1 for the layout.", "Next sentence here."]
    assert one(spark, T.sentences(F.col("t")), t="첫째 문장이 여기에 있다。둘째 문장도 여기에 있다。") == ["첫째 문장이 여기에 있다。", "째 문장도 여기에 있다。"]
    assert one(spark, T.sentences(F.col("t")), t=" ab ") == ["ab"]
    text = " ".join("x" * (n - 1) + "." for n in (600, 200, 500))
    got = one(spark, chunking.overlaps(chunking.chunk_array(F.col("t"), F.lit(5))), t=text)
    assert [len(c.text) for c in got] == [801, 500]
    assert [(c.charStart, c.charEnd) for c in got] == [(5, 807), (807, 1308)]
    assert got[0].overlapAfter == "x" * 150 and len(got[1].overlapBefore) == 150 and got[0].overlapBefore == ""
    assert one(spark, chunking.chunk_array(F.col("t"), F.lit(0)), t="short") == []


def plain_passages(text, claim, most):
    words = list(dict.fromkeys(w for w in re.split(r"\s+", re.sub(r"[^A-Za-z0-9_가-힣\s]", " ", claim.lower())) if len(w) >= 2 and w not in T.KEYWORD_STOP_WORDS))
    paras = [p for p in (p.replace("\n", " ").strip() for p in re.split(r"\n{2,}", text)) if len(p) >= 80]
    total, taken = 0, []
    for score, i in sorted((-sum(w in p.lower() for w in words), i) for i, p in enumerate(paras)):
        if score == 0:
            break
        if total + len(paras[i]) <= most:
            taken.append(i)
            total += len(paras[i]) + 2
    return "\n\n".join(paras[i] for i in sorted(taken)) or text[:most].strip()


def test_passages(spark):
    rng = random.Random(3)
    vocab = "red green blue sensor frame wheel the of".split()
    for _ in range(6):
        text = "\n\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))) for _ in range(8))
        claim = " ".join(rng.sample(vocab, 3))
        assert one(spark, chunking.relevant_passages(F.col("t"), F.col("c"), 500), t=text, c=claim) == plain_passages(text, claim, 500)
    assert one(spark, chunking.relevant_passages(F.col("t"), F.col("c"), 5), t="abcdefgh", c="the") == "abcde"


def test_claim_parsing(spark):
    got = one(spark, claims.elements(F.col("t")), t="A device comprising:\n(a) first part\n(b) second part")
    assert [(e.id, e.importance, e.isEssential) for e in got] == [("A", 3, True), ("a", 2, True), ("b", 2, False)]
    assert [e.text for e in got] == ["A device comprising:", "first part", "second part"]
    got = one(spark, claims.elements(F.col("t")), t="a device with a frame, comprising a sensor unit; a controller unit")
    assert [(e.id, e.text, e.importance, e.isEssential) for e in got] == [
        ("A", "a device with a frame", 3, True), ("B", "comprising a sensor unit", 2, True), ("C", "a controller unit", 2, True),
    ]
    assert [e.text for e in one(spark, claims.elements(F.col("t")), t="tiny")] == ["tiny"]
    queries = one(spark, claims.search_queries(claims.elements(F.col("t"))), t="a device with a frame, comprising a sensor unit; a controller unit")
    assert queries == ["a device with a frame comprising a sensor unit a controller unit", "a device with a frame", "comprising a sensor unit", "a controller unit"]
    broad = one(spark, claims.broad_terms(F.col("t")), t="Any suitable part, énearly, means for x 다양한")
    assert broad == ['"Any" — over-broad quantifier', '"nearly" — functional approximation', '"suitable" — vague modifier', '"means for" — means-plus-function language', '"다양한" — 광범위 수식어']
    assert one(spark, claims.technical_field(F.col("t")), t="the domain") == "소프트웨어/AI"


def test_dependencies(spark):
    for text, want in [("The device of claim 1, wherein x", 1), ("according to claim 2 comprising y", None), ("제1항에 있어서", 1), ("claim 3 often", None), ("claim 3 of x", 3)]:
        assert one(spark, claims.parent(F.col("t")), t=text) == want
    assert one(spark, claims.parent(F.col("t"), "manual"), t="청구항 4 내지 5") == 4
    got = one(spark, claims.numbered_claims(F.col("t"), "graph"), t="Claim 1. A. claim 2: B of claim 1, C")
    assert [(c.num, c.text) for c in got] == [(1, "A."), (2, "B of claim 1, C")]
    assert one(spark, claims.numbered_claims(F.col("t")), t="nothing") == []
    rows = [(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)]
    df = spark.createDataFrame(rows, "num int, parent int")
    assert {r.num: r.root for r in claims.roots(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 9, 5: None, 6: None}
    assert {r.num for r in claims.orphans(df).collect()} == {4, 5, 6}


def test_structure(spark):
    for line, want in [("SUMMARY OF THE INVENTION", "abstract"), ("ABSTRACT", "abstract"), ("Claim 1. x", None), ("발명의", "technical_field"), ("x", None)]:
        assert one(spark, structure.section_type(F.col("t")), t=line) == want
    assert one(spark, structure.section_type(F.col("t"), "longest"), t="Summary of the invention") == "technical_problem"
    text = "A Very Fine Device\nfiled 2019.03.07\n[Abstract]\nIt works as FIG 1 tells, and there is more of it at some length.\n\nClaims\nClaim 1. A frame.\nClaim 2. The frame of claim 1, wherein red.\nBrief Description of Drawings\nFIG. 1 shows a frame\nFIG. 3\n"
    out = search.analyse(spark.createDataFrame([(1, text)], "doc_id int, text string"), 2026)
    assert [(r.type, r.title) for r in out["sections"].orderBy("ord").collect()] == [("unknown", ""), ("abstract", "[Abstract]"), ("claims", "Claims"), ("figures_description", "Brief Description of Drawings")]
    assert [(r.num, r.parent) for r in out["claims"].orderBy("num").collect()] == [(1, None), (2, 1)]
    assert [(r.chunk_id, r.charStart) for r in out["chunks"].collect()] == [("chunk-1-abstract", 37)]
    figs = {r.number: (r.description, r.chunk_ids) for r in out["figures"].collect()}
    assert figs == {"FIG. 1": ("a frame", ["chunk-1-abstract"]), "FIG. 3": ("", [])}
    head = out["heads"].first()
    assert (head.title, head.date) == ("A Very Fine Device", "2019-03-07")


def test_scoring(spark):
    doc = "red sensor frame"
    for ev, want in [("red sensor wheel", "red sensor wheel"), ("abc", "abc"), ("blue gear wheel", S.UNCONFIRMED), ("", ""), (None, "")]:
        assert one(spark, S.valid_evidence(F.col("e"), F.col("d")), e=ev, d=doc) == want
    assert [one(spark, S.verdict(F.lit(x)), a="") for x in (0.75, 0.74, 0.4, 0.39)] == ["COVERED", "PARTIAL", "PARTIAL", "NOT_COVERED"]
    assert one(spark, S.novelty_risk(F.lit(0.55)), a="") == "MEDIUM" and one(spark, S.inventiveness_risk(F.lit(0.55)), a="") == "HIGH"
    scores = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("score")) for i, s in (("A", 80.0), ("B", 40.0))))
    assert one(spark, S.weighted_score(scores, F.create_map(F.lit("A"), F.lit(3.0))), a="") == 70
    assert [one(spark, S.retry_delay(F.lit(n)), a="") for n in (1, 3, 9)] == [1000, 4000, 30000]
    assert one(spark, T.bump_version(F.col("v")), v="1.2.9") == "1.2.10"


def test_charts(spark):
    df = spark.createDataFrame([("d",)], "id string").withColumn("elements", claims.elements(F.lit("a device with a frame; a controller unit")))
    score = "array<struct<id string, score double, evidence string>>"
    fast = df.withColumn("element_scores", F.from_json(F.lit('[{"id":"B","score":90,"evidence":"e"},{"id":"A","score":60,"evidence":"f"}]'), score))
    r = replies.charts(fast.withColumn("reasoning", F.lit("why")).withColumn("chart_reply", F.lit(None).cast("string"))).first()
    assert [(x.id, x.similarity, x.verdict) for x in r.rows] == [("A", 0.6, "PARTIAL"), ("B", 0.9, "COVERED")]
    assert r.overall_similarity == pytest.approx(0.72) and (r.novelty_risk, r.inventiveness_risk) == ("MEDIUM", "HIGH")
    slow = df.withColumn("element_scores", F.from_json(F.lit("[]"), score)).withColumn("reasoning", F.lit(""))
    reply = 'x ```json {"rows":[{"elementId":"A","similarity":10,"verdict":"COVERED"}],"summary":"s"} ```'
    r = replies.charts(slow.withColumn("chart_reply", F.lit(reply))).first()
    assert [x.verdict for x in r.rows] == ["COVERED", "NOT_COVERED"]
    r = replies.charts(slow.withColumn("chart_reply", F.lit("none"))).first()
    assert (r.overall_similarity, r.novelty_risk, r.rows[0].reasoning) == (0.0, "LOW", "(analysis failed)")


def test_enrichment(spark):
    reply = "Sure:\n```json\n" + json.dumps({"components": [{"name": "n", "synonyms": ["s", ""]}], "searchQueries": [str(k) for k in range(9)]}) + "\n```"
    got = one(spark, replies.enrichment(F.col("r"), F.col("c"), F.lit(4)), r=reply, c="claim text")
    assert got.components[0].synonyms == ["s"] and got.searchQueries == [str(k) for k in range(7)]
    got = one(spark, replies.enrichment(F.col("r"), F.col("c"), F.lit(4)), r="no", c="claim text")
    assert got.searchQueries == ["claim text"] and got.components[0].name == "claim 4"


def plain_lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_diff():
    assert diff.stats("a b c", "a x c") == (2, 1, 1, 67)
    assert diff.diff("a", "b") == [("a", "deleted"), ("b", "inserted")]
    rng = random.Random(2)
    for _ in range(30):
        a, b = (" ".join(rng.choice("abc,") for _ in range(rng.randint(0, 12))) for _ in range(2))
        got = diff.diff(a, b)
        assert [w for w, k in got if k != "inserted"] == diff.words(a) and [w for w, k in got if k != "deleted"] == diff.words(b)
        assert sum(k == "equal" for _, k in got) == plain_lcs(diff.words(a), diff.words(b))


def test_sources(spark):
    us = {"patents": [{"patent_id": "7", "patent_title": "T", "patent_date": "2001-02-03", "inventors": [{"inventor_name_first": "A", "inventor_name_last": None}, {}], "assignees": [{"assignee_organization": "Org"}], "ipc_codes": [{"ipc_code": "H04"}]}, {"patent_id": None}]}
    item = {"applicationNumber": "10-1", "inventionTitle": "T", "inventorName": "a|b", "openDate": "20240105"}
    work = {"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/x", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 3]}, "publication_year": 2020}, {"id": "W2"}]}
    page = lambda *r: spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(r)], "page int, reply string")
    a = sources.us_candidates(page(us))
    assert [(r.id, r.patentNumber, r.inventors, r.assignee, r.ipcCodes) for r in a.collect()] == [("patentsview:7", "US7", ["A"], "Org", ["H04"])]
    wrap = lambda x: {"response": {"body": {"items": {"item": x}}}}
    b = sources.kr_candidates(page(wrap(item), wrap([item, {}]), {}))
    assert [(r.patentNumber, r.inventors, r.publicationDate) for r in b.collect()] == [("10-1", ["a", "b"], "2024-01-05")] * 2
    c = sources.work_candidates(page(work))
    assert [(r.id, r.patentNumber, r.abstract, r.publicationDate) for r in c.collect()] == [("openalex:W1", "10.1/x", "a b a", "2020-01-01")]
    reg = sources.SourceRegistry()
    reg.register("one", lambda q: a)
    reg.register("two", lambda q: c)
    reg.register("key", lambda q: b, needs_key=True)

    def broken(q):
        raise OSError

    reg.register("bad", broken)
    got = reg.fetch(spark, "q", ["two", "key", "bad", "one", "none"], ["one", "two", "key", "bad"])
    assert [r.source for r in got.orderBy("doc_ord").collect()] == ["openalex", "patentsview"]
    assert reg.fetch(spark, "q", [], []).count() == 0
    assert T.english_terms("센서 wireless sensor net-work abc") == "wireless sensor net-work abc"
    cache = sources.ResultCache(10, 2)
    for k in range(3):
        cache.put(str(k), k, 0)
    assert [cache.get(str(k), 5) for k in range(3)] == [None, 1, 2] and cache.get("2", 11) is None


def test_search_flow(spark):
    rows = [(f"d{k}", f"N{k % 7}", f"title {'red ' * (k % 5)}", "sensor frame", f"20{10 + k}-01-01", k) for k in range(12)]
    df = spark.createDataFrame(rows, "id string, patentNumber string, title string, abstract string, publicationDate string, doc_ord long")
    df = df.withColumn("claims", F.lit(None).cast("string")).withColumn("filingDate", F.lit(None).cast("string"))
    hits = search.retrieve(df, search.Query("red sensor", cutoff="2016-06-01"))
    got = hits.orderBy("rank").collect()
    assert len(got) == 7 and [r.rank for r in got] == list(range(1, 8)) and got[0].id in ("d3", "d4")
    batches = search.rerank_batches(hits).collect()
    assert [len(b.ids) for b in batches] == [7]
    scored = search.reranked(hits, spark.createDataFrame([(0, "no json")], "batch long, reply string"))
    assert sorted(r.stage2_rank for r in scored.collect()) == list(range(1, 8))
    inputs = search.chart_inputs(hits, scored, "a red device; a sensor frame unit").withColumn("chart_reply", F.lit(None).cast("string"))
    assert replies.charts(inputs).count() == 5


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    p = s.insert("projects", spark.createDataFrame([("one",), ("two",)], "name string"), ["name"])
    assert p == [1, 2]
    h = s.insert("search_history", spark.createDataFrame([("q",)], "query string"), ["query"])
    s.insert("project_searches", spark.createDataFrame([(1, h[0]), (2, h[0])], "project_id long, search_id long"), ["project_id"])
    c = s.insert("search_candidates", spark.createDataFrame([(h[0], "N1")], "search_id long, patent_number string"), ["patent_number"])
    s.insert("rerank_results", spark.createDataFrame([(h[0], c[0], 50.0)], "search_id long, candidate_id long, weighted_score double"), ["candidate_id"])
    s.delete("projects", 1)
    assert [r.project_id for r in s.table("project_searches").collect()] == [2] and s.table("projects").count() == 1
    with pytest.raises(ValueError):
        s.insert("project_searches", spark.createDataFrame([(2, h[0])], "project_id long, search_id long"), ["project_id"])
    assert s.table("project_searches").count() == 1
    s.delete("search_history", h[0])
    assert [s.table(t).count() for t in ("project_searches", "search_candidates", "rerank_results")] == [0, 0, 0]
    old = spark.createDataFrame([("k", 1)], "key string, v int")
    assert [r.v for r in store.upsert(old, spark.createDataFrame([("k", 2)], old.schema), ["key"]).collect()] == [2]
    assert [r.v for r in store.insert_or_ignore(old, spark.createDataFrame([("k", 3)], old.schema), ["key"], "v").collect()] == [1]
    empty = spark.createDataFrame([], "input_tokens long, output_tokens long")
    assert tuple(store.token_totals(empty).first()) == (0, 0, 0)


def test_prompts_and_providers(spark):
    d = providers.default_prompts(spark)
    assert providers.missing_prompts(d.limit(3), d).count() == 1
    assert T.render("{{a}} {{b}}", {"a": "{{b}}", "b": "x"}) == "x x"
    out = providers.generate_all(spark.createDataFrame([("p", "s"), ("x" * 120_001, "")], "prompt string, system string"), providers.StubProvider).collect()
    assert out[0].error is None and json.loads(out[0].content)["risk_level"] and out[1].content is None
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ModelError("busy", 529)
        return providers.Reply("ok", 1, 1)

    assert providers.with_retry(flaky, sleep=lambda s: None).content == "ok" and len(calls) == 3
    assert "".join(providers.StubProvider().stream("p")) == providers.StubProvider().generate("p").content


def test_report(spark):
    mk = spark.createDataFrame
    project = mk([(1, "P", "about")], "id long, name string, description string").withColumn("claim_text", F.lit("A claim"))
    searches = mk([(1, 5, "q", "s", 2)], "project_id long, id long, query string, strategy string, results_count int")
    cand = mk([(5, 1, "N1", "a|b", "src", 0.03)], "search_id long, stage1_rank int, patent_number string, title string, source string, rrf_score double")
    rer = mk([(5, 1, "N1", 70, True, False)], "search_id long, stage2_rank int, patent_number string, weighted_score int, novelty_threat boolean, inventive_threat boolean")
    ch = mk([(5, 1, "N1", "el", "prior", "COVERED")], "search_id long, ord int, patent_number string, element string, prior_art string, verdict string")
    ana = mk([(5, 1, "novelty", "text")], "search_id long, id long, strategy string, result string")
    text = report.markdown(project, searches, cand, rer, ch, ana).first().text
    for part in ("# P", "A claim", "| 1 | N1 | a｜b | src | 0.0300 |", "| 1 | N1 | 70.000 | HIGH | LOW |", "| N1 | el | prior | COVERED |", "##### novelty"):
        assert part in text
    ws = mk([(1, "c", "s", "n", "e")], "project_id long, claim_text string, structure string, nodes string, edges string")
    assert json.loads(report.bundle(project, ws, searches, ana).first().json)["searches"][0]["analyses"][0]["result"] == "text"


def test_stream_lines(spark, tmp_path):
    rows = [("r", k, part, k == 4) for k, part in enumerate(["ab", "c\nde", "f\n", "\nx", "y"])] + [("s", 0, "q\nopen", False)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "requestId string, seq int, delta string, done boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = deltas.run_available(spark, f"{tmp_path}/in", "requestId string, seq int, delta string, done boolean", deltas.stream_lines, f"{tmp_path}/out", files=100)
    assert sorted((r.requestId, r.n, r.line) for r in out.collect()) == [("r", 1, "abc"), ("r", 2, "def"), ("r", 3, "xy"), ("s", 1, "q")]


def test_term_counts_by_plain_python(spark, corpus):
    want = Counter(w for _, t in CORPUS for w in t.split())
    assert {r.term: r.cf for r in bm25.term_stats(corpus).collect()} == want
    assert math.isclose(sum(want.values()), 6)
