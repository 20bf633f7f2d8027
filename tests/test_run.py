"""A search run from sources to the store: phases, cancelling, going on; store appends; providers; bundles; documents with pages."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import store
from sparkloom.plans import api, providers, report, run, search, workspace
from sparkloom.sources import replies as sources


class Judge:
    """Scores every document and element that a prompt names."""

    def generate(self, prompt, system=""):
        ids = [line[1 : line.index("]")] for line in prompt.split("\n") if line.startswith("[d")]
        items = [{"id": i, "elements": [{"id": "A", "score": 10 * int(i[1:]), "evidence": "red"}, {"id": "B", "score": 5, "evidence": ""}], "reasoning": f"on {i}"} for i in ids]
        text = json.dumps(items) if ids else json.dumps({"rows": [{"elementId": "A", "priorArtText": "x", "similarity": 80}], "summary": "s"})
        return providers.Reply(text, 1, 1)

    def stream(self, prompt, system=""):
        yield self.generate(prompt, system).content

    def is_available(self):
        return True


def found(spark, n=8):
    rows = [(f"d{k}", f"N{k % 6}", f"title {'red ' * (k % 5)}", "sensor frame", f"20{10 + k}-01-01", "src", f"http://x/{k}", k) for k in range(n)]
    df = spark.createDataFrame(rows, "id string, patentNumber string, title string, abstract string, publicationDate string, source string, url string, doc_ord long")
    return df.withColumn("claims", F.lit(None).cast("string")).withColumn("filingDate", F.lit(None).cast("string"))


QUERY = search.Query("red sensor", claim="a red device with a part; a sensor frame unit")


def test_a_run_fills_the_store(spark, tmp_path):
    app = api.App(spark, f"file://{tmp_path}/app")
    app.registry.register("src", lambda q: found(spark))
    told = []
    key, result = app.run_search(QUERY, ["src"], make=Judge, tell=lambda *x: told.append(x))
    assert [t[0] for t in told] == ["parse", "fetch", "score", "rerank", "rerank", "chart", "chart", "done"] and told[-1] == ("done", 100, 6)
    assert [p for _, p, _ in told] == sorted(p for _, p, _ in told)
    cand = app.store.table("search_candidates").orderBy("stage1_rank").collect()
    assert [r.stage1_rank for r in cand] == list(range(1, 7)) and {r.search_id for r in cand} == {key}
    judged = app.store.table("rerank_results").orderBy("stage2_rank").collect()
    assert len(judged) == 6 and [r.stage2_rank for r in judged] == list(range(1, 7))
    numbers = {r.id: r.patent_number for r in cand}
    assert numbers[judged[0].candidate_id] == "N5" and judged[0].weighted_score == 28 and judged[0].reasoning == "on d5"
    charts = [json.loads(r.chart_json) for r in app.store.table("claim_charts").orderBy("id").collect()]
    assert len(charts) == 5 and {len(c["rows"]) for c in charts} == {2} and [c["patentNumber"] for c in charts] == [r.patent_number for r in cand[:5]]
    done = app.recent_searches().first()
    assert (done.status, done.results_count) == ("done", 6) and len(result.report.split("\n")) == 5
    text = report.markdown(
        spark.createDataFrame([(1, "P", "d", "c")], "id long, name string, description string, claim_text string"),
        app.store.table("search_history").withColumn("project_id", F.lit(1).cast("long")),
        app.store.table("search_candidates"),
        app.store.table("rerank_results").withColumn("patent_number", F.lit("N")),
        spark.createDataFrame([(key, k, f"N{k // 2}", "e", "p", "COVERED") for k in range(14)], "search_id long, ord int, patent_number string, element string, prior_art string, verdict string"),
        app.store.table("analysis_results"),
    ).first().text
    assert f"| 1 | {cand[0].patent_number} |" in text and text.count("COVERED") == 10


def test_cancel_and_go_on(spark, tmp_path):
    app = api.App(spark, f"file://{tmp_path}/app")
    calls = []

    def fetch(q):
        calls.append(q)
        return found(spark)

    app.registry.register("src", fetch)

    def stop(phase, percent, rows):
        if phase == "score":
            assert app.cancel_search(1)

    key, result = app.run_search(QUERY, ["src"], template="quick", tell=stop)
    assert result.cancelled and result.report == run.CANCELLED and result.hits.count() == 0
    assert app.recent_searches().first().status == "cancelled" and app.store.table("search_candidates").count() == 0
    again, result = app.run_search(QUERY, ["src"], template="quick", key=key)
    assert again == key and not result.cancelled and calls == ["red sensor"]
    # the quick way has no reranking: scores come from the ranks
    assert app.store.table("rerank_results").count() == 6 and app.store.table("claim_charts").count() == 5
    assert not app.cancel_search(key)


def test_a_running_job_stops(spark, tmp_path):
    slow = F.udf(lambda x: time.sleep(0.5) or x, "string")
    one = run.SearchRun(spark, f"{tmp_path}/r", QUERY, lambda q: found(spark, 400).repartition(1).withColumn("id", slow("id")))
    threading.Timer(4, one.cancel.cancel).start()
    start = time.monotonic()
    assert one.run().cancelled and time.monotonic() - start < 60


def test_templates_and_settings():
    assert run.settings_of("broad") == search.Settings(per_source=50, rerank=True) and not run.settings_of("quick").rerank
    base = search.Settings(rrf_k=7)
    assert run.settings_of("none", base) is base and run.settings_of("local", base).rrf_k == 7


def row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def files_of(path):
    return sum(p.suffix == ".parquet" for p in path.rglob("*.parquet"))


def test_inserts_add_files_and_merge_them(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.insert("projects", spark.createDataFrame([(f"p{k}",) for k in range(50)], "name string"), ["name"])
    before = files_of(tmp_path)
    assert s.insert("projects", row(spark, name="one more"), ["name"]) == [51]
    assert files_of(tmp_path) - before <= 1  # the other rows are not written again
    monkeypatch.setattr(store, "FOLDERS", 3)
    for k in range(4):
        s.insert("projects", row(spark, name=f"q{k}"), ["name"])
    assert s.table("projects").count() == 55 and len(s._folders(s._version())["projects"]) <= 3
    assert sorted(r.id for r in s.table("projects").select("id").collect()) == list(range(1, 56))
    assert s.vacuum(versions=1, seconds=0) > 0 and s.table("projects").count() == 55 and len(s._versions()) == 1
    assert s.vacuum(versions=1, seconds=0) == 0


def test_a_conflict_is_tried_again(spark, tmp_path):
    s, other = (store.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    s.insert("projects", row(spark, name="a"), ["name"])
    tried = []

    def made():
        if not tried:  # another writer is faster once
            other.insert("projects", row(spark, name="b"), ["name"])
        tried.append(1)
        high = s.table("projects").agg(F.max("id")).first()[0]
        return {"projects": s.appended("projects", store.with_ids(row(spark, name="c"), ["name"], high))}

    s.change(made)
    assert len(tried) == 2 and [(r.id, r.name) for r in s.table("projects").orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(store.Conflict):
        s.commit(0, projects=s.table("projects"))
    with pytest.raises(ValueError):  # keys of the other folders count
        s.commit(projects=s.appended("projects", row(spark, id=2, name="x")))
    assert s.table("projects").count() == 3


def test_concurrent_inserts(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    threads = [threading.Thread(target=lambda k=k: store.Store(spark, f"file://{tmp_path}/s").insert("projects", row(spark, name=f"n{k}"), ["name"])) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted((r.id, r.name) for r in s.table("projects").collect())[0][0] == 1
    assert sorted(r.name for r in s.table("projects").collect()) == ["n0", "n1", "n2"] and sorted(r.id for r in s.table("projects").collect()) == [1, 2, 3]


def test_provider_factory():
    f = providers.ProviderFactory()

    class Down(providers.StubProvider):
        def is_available(self):
            return False

    f.register("down", lambda s: Down())
    f.register("keyed", lambda s: Judge(), ("key",))
    assert isinstance(f.create("auto"), providers.StubProvider) and isinstance(f.create("auto", {"key": "k"}), Judge)
    assert f.create("keyed", {"key": "k"}) is f.create("keyed", {"key": "k"})
    kept = f.create("stub")
    f.invalidate()
    assert f.create("stub") is not kept
    for mode, settings in (("none", {}), ("keyed", {}), ("keyed", {"key": " "})):
        with pytest.raises(providers.ModelError) as e:
            f.resolve(mode, settings)
        assert not e.value.retryable


def test_calls_in_a_window():
    live, most, lock = [0], [0], threading.Lock()

    def call(k):
        with lock:
            live[0] += 1
            most[0] = max(most[0], live[0])
        time.sleep(0.05 if k % 3 else 0.15)
        with lock:
            live[0] -= 1
        return k

    assert list(providers.in_window(iter(range(20)), call, 4)) == list(range(20)) and 1 < most[0] <= 4
    assert list(providers.in_window(iter([]), call, 4)) == [] and list(providers.in_window(iter([1]), call, 1)) == [1]


class Flaky:
    def generate(self, prompt, system=""):
        if prompt == "bad":
            raise providers.ModelError("no", 400)
        time.sleep(0.01 * (len(prompt) % 4))
        return providers.Reply(prompt.upper(), 1, 1)


def test_concurrent_replies_keep_their_rows(spark):
    df = spark.createDataFrame([(f"p{'x' * (k % 7)}{k}" if k % 10 else "bad", "") for k in range(60)], "prompt string, system string").repartition(2)
    out = providers.generate_all(df, Flaky, width=5).collect()
    assert len(out) == 60 and all(r.content == r.prompt.upper() if r.prompt != "bad" else r.error == "no" and r.content is None for r in out)
    waits = []
    errors = iter([providers.ModelError("busy", 529, wait_s=7), providers.ModelError("busy", 503), None])

    def call():
        if (e := next(errors)) is not None:
            raise e
        return providers.Reply("ok", 1, 1)

    assert providers.with_retry(call, sleep=waits.append).content == "ok" and waits == [7, 2]
    usage = spark.createDataFrame([((3, 4),), ((None, 5),), (None,)], "u struct<input_tokens:int,output_tokens:int>")
    assert [r[0] for r in usage.select(providers.total_tokens(F.col("u"))).collect()] == [7, 5, 0]


def test_export_and_import(spark, tmp_path):
    one, two = (api.App(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    p = one.create_project("P", "about it")
    one.save_workspace(p, claim_text="a claim", nodes="[]")
    for q in ("first", "second"):
        one.link_search(p, one.start_search(q))
    one.analyse(1, "novelty", claims="c")
    one.analyse(2, "novelty", claims="d")
    one.analyse(2, "prior_art", query="d")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/bundle.json").write_text(one.export(p))
    two.create_project("another")
    two.start_search("other")
    key = two.import_bundle(f"file://{tmp_path}/b/bundle.json")
    assert key == 2 and two.export(key).replace('"id":2,"name"', '"id":1,"name"').count('"result"') == 3

    def plain(app, project):
        held = json.loads(app.export(project))
        return held["project"]["name"], held["project"].get("description"), held.get("workspace"), [(s["query"], s.get("strategy"), [(a["strategy"], a["result"]) for a in s.get("analyses") or []]) for s in held["searches"]]

    assert plain(one, p) == plain(two, key)
    hand = {"project": {"name": "by hand"}, "searches": {"query": "lone", "analyses": {"strategy": "s", "result": "r"}}}
    (tmp_path / "b/hand.json").write_text(json.dumps(hand))
    key = two.import_bundle(f"file://{tmp_path}/b/hand.json")
    assert plain(two, key)[3] == [("lone", None, [("s", "r")])]


def test_documents_with_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" page one \fpage two\f")
    (tmp_path / "b.dat").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "empty.txt").write_text("")
    got = {r.file: (r.text, r.page_count) for r in sources.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("page one \npage two", 2), "b.dat": ("café �", 1)}  # Spark's readers pass over files without a byte
    rows = sources.read_documents(spark, str(tmp_path), pages=True).filter("file = 'a.txt'").collect()
    assert [(r.page, r.text, r.page_count) for r in sorted(rows, key=lambda r: r.page)] == [(1, "page one", 2), (2, "page two", 2)]


def test_switching_and_streaming(spark, tmp_path):
    app = api.App(spark, f"file://{tmp_path}/app")
    app.factory.register("judge", lambda s: Judge(), ("key",))
    app.use_provider("judge", key="k")
    assert json.loads("".join(app.stream("[d1] x")))[0]["id"] == "d1"
    app.use_provider("stub")
    assert "".join(app.stream("p")) == providers.StubProvider().generate("p").content
    assert workspace.progress_percent("done") == 100
