"""Ranks of several lists, running totals, and the pruned top-k of many queries."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import bm25, candidates, inverted, ranking
from sparkloom.plans import workspace


@pytest.mark.parametrize("ties", [3, 10_000])
def test_ranks_of_lists(spark, ties):
    rng = random.Random(ties)
    rows = [(g, i, float(rng.randrange(ties)) if g else 0.0) for g in range(3) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, id long, score double").repartition(5)
    got = {(r.g, r.id): r.rank for r in ranking.rank_lists(df, "g", "score", "id").collect()}
    want = {}
    for g in range(3):
        for k, (_, i) in enumerate(sorted((-s, i) for h, i, s in rows if h == g), 1):
            want[g, i] = k
    assert got == want
    assert ranking.rank_lists(df.limit(0), "g", "score", "id").count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "timestamp"])
def test_running_totals(spark, kind):
    rng = random.Random(7)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([None, *range(300)]), k, rng.choice([None, 1, 5, -3])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, id long, n long").repartition(6)
    if kind == "string":
        df = df.withColumn("o", F.lpad(F.col("o").cast("string"), 4, "0"))
    elif kind == "timestamp":
        df = df.withColumn("o", F.timestamp_seconds("o"))
    w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: (r.a, r.b) for r in df.select("id", F.sum("n").over(w).alias("a"), F.sum("id").over(w).alias("b")).collect()}
    got = {r.id: (r.a, r.b) for r in ranking.running_sums(df, ["g"], ["o", "id"], {"a": "n", "b": "id"}).collect()}
    differ = [(k, got[k], want[k]) for k in want if got[k] != want[k]]
    assert len(got) == 3000 and not differ


def test_no_task_sorts_a_whole_key(spark):
    df = spark.range(20_000).select(F.lit("one").alias("event_type"), F.col("id").alias("event_id"), F.lit(2).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    used = workspace.usage(df, ["event_type"], ["event_id"])
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan.split("Window", 1)[1]
    last = used.orderBy(F.desc("event_id")).first()
    assert (last.total_in, last.total_out) == (40_000, 20_000)


def corpus(spark, n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, docs[5][1]), (n + 3, docs[5][1])]
    queries = [(q, " ".join(rng.choices(vocab, k=rng.randint(1, 5)))) for q in range(12)] + [(12, docs[5][1]), (13, ""), (14, "absent"), (15, None), (16, "w399 w399 w0")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("block", [4, 64])
def test_pruned_top_k(spark, block):
    docs, queries = corpus(spark, 900)
    report = {}
    got = {(r.query_id, r.id, r.rank): r.score for r in inverted.top_k(inverted.build(docs, block=block), queries, 10, report=report).collect()}
    every = bm25.ranked(bm25.scores_of_queries(docs, queries).withColumn("score", F.round("score", 6)), "id", ["query_id"]).filter("rank <= 10")
    want = {(r.query_id, r.id, r.rank): r.score for r in every.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert report["read"] < report["postings"] and report["scored"] < report["pairs"]


def test_pruning_of_empty_tables(spark):
    docs, queries = corpus(spark, 20)
    assert inverted.top_k(inverted.build(docs.limit(0)), queries, 5).count() == 0
    assert inverted.top_k(inverted.build(docs), queries.limit(0), 5).count() == 0


def test_one_verdict_a_url_and_first_chart(spark):
    df = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "id int, url string")
    checked = spark.createDataFrame([("u", True, 2), ("u", False, 1), ("v", True, 1), ("v", False, 2)], "url string, valid boolean, checked_ord int")
    assert sorted(map(tuple, candidates.with_url_validity(df, checked).select("id", "urlValid").collect())) == [(1, True), (2, False), (3, False)]
    assert sorted(map(tuple, candidates.with_url_validity(df, checked.drop("checked_ord")).select("id", "urlValid").collect())) == [(1, True), (2, True), (3, False)]
    nodes = spark.createDataFrame([(1,)], "node int")
    best = spark.createDataFrame([(1, "p", 70, 1)], "node int, patent_number string, weighted_score int, stage2_rank int")
    charts = spark.createDataFrame([(1, "p", "LOW", "LOW", 2), (1, "p", "MEDIUM", "HIGH", 1)], "node int, patent_number string, novelty_risk string, inventiveness_risk string, chart_ord int")
    assert [(r.novelty_risk, r.inventiveness_risk) for r in workspace.claim_summary(nodes, best, charts).collect()] == [("MEDIUM", "HIGH")]
