from pyspark.sql import functions as F

from sparkloom.operators import claims
from sparkloom.plans import api, providers, search, workspace


def test_small_operations(spark):
    text = F.lit("a device with a frame; a controller unit")
    assert spark.range(1).select(workspace.element_lines(claims.elements(text)).alias("t")).first().t == "[A] **** a device with a frame\n[B] *** a controller unit"
    stored = spark.createDataFrame([("b", 1), ("c", 2)], "id string, v int")
    built = spark.createDataFrame([("a", 0), ("b", 0)], "id string, v int")
    assert [(r.id, r.v) for r in workspace.with_builtins_first(stored, built).orderBy("ord").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    items = spark.createDataFrame([("x", True), ("y", False)], "id string, active boolean")
    assert {r.id: r.active for r in workspace.toggled(items, "y").collect()} == {"x": True, "y": True}
    assert workspace.context_item("note", "t")["for_search"] is False and workspace.context_item("url", "t")["for_search"]
    assert [workspace.progress_percent(p) for p in workspace.PHASES] == [0, 20, 40, 60, 80, 100]
    hits = spark.createDataFrame([(2, "N2", "b"), (1, "N1", "a"), (4, "N4", "d")], "rank int, patentNumber string, title string")
    assert workspace.prompt_context(hits).first().text == "N1: a\nN2: b"
    table = spark.createDataFrame([(1, "x"), (3, "y")], "num int, text string")
    assert [r.num for r in workspace.target_claims(table, [3]).collect()] == [3] and workspace.target_claims(table, None).count() == 2
    nodes = spark.createDataFrame([("n",), ("m",)], "node string")
    rer = spark.createDataFrame([("n", "N1", 1, 70), ("n", "N2", 2, 60)], "node string, patent_number string, stage2_rank int, weighted_score int")
    ch = spark.createDataFrame([("n", "N1", "HIGH", "LOW")], "node string, patent_number string, novelty_risk string, inventiveness_risk string")
    assert {r.node: (r.top, r.novelty_risk) for r in workspace.claim_summary(nodes, rer, ch).collect()} == {"n": ("N1", "HIGH"), "m": (None, None)}


def test_cancel(spark):
    c = workspace.Cancel(spark, "g")
    with c.running():
        assert c.result(spark.range(3)).count() == 3
    c.cancel()
    assert c.stopped and c.result(spark.range(3)).count() == 0


def test_app(spark, tmp_path):
    app = api.App(spark, f"file://{tmp_path}/app")
    app.seed_prompts()
    app.seed_prompts()
    assert app.list_prompts().count() == len(providers.PROMPTS)
    app.save_prompt("mine", "1.0.0", "novelty", "{{claims}}?")
    key = app.list_prompts("novelty").filter("name = 'mine'").first().id
    app.activate_prompt(key)
    assert [r.name for r in app.list_prompts("novelty").filter("is_active").collect()] == ["mine"]
    p = app.create_project("P")
    app.update_project(p, description="d", name=None)
    app.save_workspace(p, claim_text="one")
    app.save_workspace(p, claim_text="two")
    s = app.start_search("q")
    app.link_search(p, s)
    app.link_search(p, s)
    rows = [("d1", "N1", "red frame", "abs", "src", "u", 0), ("d2", "N2", "blue", "abs", "src", "u", 1)]
    docs = spark.createDataFrame(rows, "id string, patentNumber string, title string, abstract string, source string, url string, doc_ord long")
    for c in ("claims", "publicationDate", "filingDate"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    app.finish_search(s, search.retrieve(docs, search.Query("red")))
    assert app.recent_searches().first().results_count == 2
    assert app.store.table("search_candidates").orderBy("stage1_rank").first().patent_number == "N1"
    assert app.analyse(s, "novelty", claims="c")["risk_level"]
    assert app.token_stats().first()["count"] == 1
    assert '"claim_text":"two"' in app.export(p) and '"description":"d"' in app.export(p)
    assert app.parse_claim("any frame")["broadTerms"] and app.chunk_text("x") == []
    assert app.needed_migrations([1, 2]) == [1, 2]
    app.delete_project(p)
    assert app.list_projects().count() == 0 and app.store.table("project_searches").count() == 0


def test_context_items(spark):
    from sparkloom.plans import providers, workspace

    items = spark.createDataFrame([(1, "url", "u", True, True, True)], "id long, kind string, content string, for_search boolean, for_rerank boolean, active boolean")
    two = workspace.added(items, workspace.context_item("note", "n"))
    assert [(r.id, r.kind, r.for_search, r.active) for r in two.orderBy("id").collect()] == [(1, "url", True, True), (2, "note", False, True)]
    assert workspace.active_items(workspace.toggled(two, 2)).first().active == 1
    assert [r.id for r in workspace.without(two, 1).collect()] == [2]
    empty = workspace.added(items.limit(0), workspace.context_item("note", "n"))
    assert [r.id for r in empty.collect()] == [1]
    assert providers.search_template("broad")[1] == 50 and providers.search_template("none") is None
    assert providers.prompt_count(providers.default_prompts(spark)).first()["count"] == len(providers.PROMPTS)


def test_enriched_first(spark):
    from sparkloom.plans import workspace

    nodes = spark.createDataFrame([(1,), (2,)], "num int")
    enriched = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "c")], "num int, ord int, t string")
    assert sorted(map(tuple, workspace.with_enriched(nodes, enriched).collect())) == [(1, "a"), (2, None)]


def test_two_writers(spark, tmp_path):
    import pytest

    from sparkloom.operators import store

    s = store.Store(spark, str(tmp_path))
    s.insert("projects", spark.createDataFrame([("a", "")], "name string, description string"), ["name"])
    other = store.Store(spark, str(tmp_path))
    stale = other._version() - 1
    other._version = lambda: stale
    with pytest.raises(store.Conflict):
        other.commit(projects=s.table("projects"))
    assert [r.name for r in s.table("projects").collect()] == ["a"]


def test_long_word_diff():
    import random

    from sparkloom.operators import diff

    def slow(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        return best[-1][-1]

    rng = random.Random(3)
    for n, m in [(0, 0), (0, 5), (7, 0), (8, 8), (9, 17), (40, 33)]:
        a, b = [rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(m)]
        got = diff.diff(" ".join(a), " ".join(b))
        assert [w for w, k in got if k != "inserted"] == a and [w for w, k in got if k != "deleted"] == b
        assert sum(k == "equal" for _, k in got) == slow(a, b)
