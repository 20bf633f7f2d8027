"""All queries over the driver's tables, each with the SQL that says the same in DuckDB where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import bm25, candidates, chunking, claims, diff, fusion, inverted, ranking, replies, staging, store, structure, tfidf
from ..sources import replies as sources
from ..sources import services
from ..streaming import deltas, ordered
from . import providers, search, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KSTOP = ", ".join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS)


def tok(c: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace(lower({c}), '[.,;:!?()\\[\\]{{}}\"''`]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"list_filter(string_split({clean}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))"


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return staging.spread(df) if table == "documents" else df


def item(spark: SparkSession, sf_dir: str, k: int) -> str:
    """Text of one benchmark item: a query."""
    row = read(spark, sf_dir, "benchmark").filter(F.col("item_id") == k).select("text").first()
    return row.text if row else ""


# ---- retrieval -------------------------------------------------------------------------------------------------------

_POST = f"""d AS (SELECT doc_id, {tok('text')} AS t FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d)"""


def _q(k: int, name: str = "q") -> str:
    return f"{name} AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({tok('text')}) AS term FROM benchmark WHERE item_id = {k}) GROUP BY term)"


def _bm(name: str = "b", q: str = "q") -> str:
    return f"""{name} AS (SELECT d.doc_id, round(coalesce(x.score, 0), 6) AS score FROM d LEFT JOIN (
SELECT p.doc_id, sum(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len(d.t) / avgdl))) AS score
FROM p JOIN {q} USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id, s GROUP BY p.doc_id) x ON x.doc_id = d.doc_id)"""


_TF = """w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM p JOIN df USING (term), s),
wq AS (SELECT term, qtf * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM q JOIN df USING (term), s),
v AS (SELECT d.doc_id, round(coalesce(x.dot / nullif(x.nd * (SELECT sqrt(sum(w * w)) FROM wq), 0), 0), 6) AS score FROM d LEFT JOIN (
SELECT w.doc_id, sum(w.w * coalesce(wq.w, 0)) AS dot, sqrt(sum(w.w * w.w)) AS nd FROM w LEFT JOIN wq USING (term) GROUP BY w.doc_id) x ON x.doc_id = d.doc_id)"""

_RANK = "row_number() OVER (ORDER BY score DESC, doc_id)"


@query("tokenize", f"SELECT doc_id, len({tok('text')})::BIGINT AS n_terms, md5(array_to_string({tok('text')}, ' ')) AS terms_md5 FROM documents")
def _(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query("term_stats", f"WITH {_POST} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def _(spark, d):
    return bm25.term_stats(read(spark, d, "documents"))


@query("bm25_scores", f"WITH {_POST}, {_q(0)}, {_bm()} SELECT doc_id, score FROM b")
def _(spark, d):
    return bm25.scores(read(spark, d, "documents"), item(spark, d, 0)).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {_POST}, {_q(0)}, {_bm()} SELECT doc_id, score, {_RANK}::BIGINT AS rank FROM b ORDER BY rank LIMIT 20")
def _(spark, d):
    scored = bm25.scores(read(spark, d, "documents"), item(spark, d, 0)).select("doc_id", F.round("score", 6).alias("score"))
    return ranking.top(scored, "score", "doc_id", 20)


@query("bm25_rank_all", f"WITH {_POST}, {_q(1)}, {_bm()} SELECT doc_id, score, {_RANK}::BIGINT AS rank FROM b")
def _(spark, d):
    scored = bm25.scores(read(spark, d, "documents"), item(spark, d, 1)).select("doc_id", F.round("score", 6).alias("score"))
    return ranking.rank_all(scored, "score", "doc_id")


@query("tfidf_topk", f"WITH {_POST}, {_q(0)}, {_TF} SELECT doc_id, score, {_RANK}::BIGINT AS rank FROM v ORDER BY rank LIMIT 20")
def _(spark, d):
    scored = tfidf.similarities(read(spark, d, "documents"), item(spark, d, 0)).select("doc_id", F.round("score", 6).alias("score"))
    return ranking.top(scored, "score", "doc_id", 20)


@query(
    "hybrid_rrf",
    f"""WITH {_POST}, {_q(0)}, {_bm()}, {_TF},
rb AS (SELECT doc_id, score, {_RANK} AS rank FROM b), rv AS (SELECT doc_id, score, {_RANK} AS rank FROM v)
SELECT doc_id, rb.score AS bm25_score, rv.score AS vector_score, rb.rank::BIGINT AS bm25_rank, rv.rank::BIGINT AS vector_rank,
round(1e0 / (60 + rb.rank) + 1e0 / (60 + rv.rank), 9) AS rrf_score FROM rb JOIN rv USING (doc_id)""",
)
def _(spark, d):
    return fusion.hybrid(read(spark, d, "documents"), item(spark, d, 0))


@query(
    "multi_query_rrf",
    f"""WITH {_POST}, {_q(0, 'q0')}, {_q(1, 'q1')}, {_q(2, 'q2')}, {_bm('b0', 'q0')}, {_bm('b1', 'q1')}, {_bm('b2', 'q2')},
r AS (SELECT doc_id, {_RANK} AS rank FROM b0 UNION ALL SELECT doc_id, {_RANK} FROM b1 UNION ALL SELECT doc_id, {_RANK} FROM b2)
SELECT doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM r GROUP BY doc_id""",
)
def _(spark, d):
    return fusion.multi_query(read(spark, d, "documents"), [item(spark, d, k) for k in range(3)] + [" "], "")


@query(
    "bm25_many_queries",
    f"""WITH {_POST}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL)
SELECT query_id, p.doc_id AS id, round(sum(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len(d.t) / avgdl))), 5) AS score
FROM p JOIN q USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id, s GROUP BY query_id, p.doc_id""",
)
def _(spark, d):
    qs = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.scores_of_queries(read(spark, d, "documents"), qs).withColumn("score", F.round("score", 5))


_MANY = f"""WITH {_POST}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT query_id, p.doc_id AS id, round(sum(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len(d.t) / avgdl))), 6) AS score
FROM p JOIN q USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id, s GROUP BY query_id, p.doc_id)"""


def _items(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    "bm25_many_queries_top20",
    f"""{_MANY}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m)
SELECT query_id, id, score, rank::BIGINT AS rank FROM r WHERE rank <= 20""",
)
def _(spark, d):
    """The best twenty documents of every item, from an index with block maxima: documents that can't be among them are not scored."""
    return inverted.top_k(inverted.build(read(spark, d, "documents")), _items(spark, d), 20)


@query(
    "multi_query_chunks",
    f"""{_MANY}, g AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(m.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN m ON m.query_id = b.item_id AND m.id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g),
f AS (SELECT id AS chunk_id, round(sum(1e0 / (60 + rank)), 9) AS score, min(query_id * 100 + rank) AS seen FROM r WHERE rank <= 16 GROUP BY id)
SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, seen)::BIGINT AS rank FROM f ORDER BY rank LIMIT 8""",
)
def _(spark, d):
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return fusion.multi_query_chunks(chunks, _items(spark, d))


@query(
    "dense_cosine_topk",
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])), 6) AS score FROM embeddings e, q)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s ORDER BY rank LIMIT 10""",
)
def _(spark, d):
    e = read(spark, d, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()
    q = F.array(*map(F.lit, first.embedding if first else [])).cast("array<double>")
    return ranking.top(e.select("vec_id", F.round(tfidf.cosine(F.col("embedding"), q), 6).alias("score")), "score", "vec_id", 10)


# ---- document services -----------------------------------------------------------------------------------------------

#: Items of a recorded page, and the cut-off of the searches.
_PAGE, _CUTOFF = 500, "2012-06-30"
_DATE = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE {0} END"
_DAY_SPARK = "date_format(date_add(DATE'2000-01-01', cast(doc_id % 9000 as int)), 'yyyy-MM-dd')"
_DAY_SQL = "strftime(DATE '2000-01-01' + (doc_id % 9000)::INT, '%Y-%m-%d')"


def _asked(spark: SparkSession, service: str, docs: DataFrame, item: F.Column, reply) -> DataFrame:
    """Candidates of a service whose replies hold an item for each document, ``_PAGE`` a page in the order of doc_id."""
    ranked = ranking.rank_all(docs.select("doc_id", F.lit(0.0).alias("score")), "score", "doc_id")
    items = docs.join(ranked, "doc_id").select("rank", item.alias("item"), F.floor((F.col("rank") - 1) / _PAGE + 1).cast("int").alias("page"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"])
    pages = items.groupBy("page").agg(reply(listed).alias("reply"))
    path = f"{staging.shared_dir(spark)}/services-{uuid.uuid4().hex}"
    services.record(pages.select(F.lit(service).alias("service"), F.lit(services.search_key(service, "all of it, please")).alias("search"), "page", "reply"), path)
    most = max(1, -(-ranked.count() // _PAGE)) * _PAGE
    return services.search(spark, path, service, "all of it, please", _CUTOFF, _PAGE, most)


_DATED_ROWS = f"(SELECT *, {_DATE.format(_DAY_SQL)} AS day FROM documents)"
_IN_TIME = f"(day IS NULL OR (day <> 'n/a' AND day <= '{_CUTOFF}'))"


@query(
    "source_us",
    f"""SELECT 'patentsview:' || doc_id AS id, 'US' || doc_id AS "patentNumber", coalesce(source, '') AS title, md5(coalesce(text, '')) AS abstract_md5, CASE WHEN doc_id % 2 = 0 THEN 'Ann ' || doc_id ELSE 'Bob' END AS inventors,
coalesce(lang, '') AS assignee, day AS "publicationDate", 'https://patents.google.com/patent/US' || doc_id AS url FROM {_DATED_ROWS} WHERE doc_id % 11 <> 0 AND {_IN_TIME}""",
)
def _(spark, d):
    """A scan of the recorded pages of a search, its cut-off date pushed into it, as candidates."""
    item = F.expr(
        f"""to_json(named_struct('patent_id', CASE WHEN doc_id % 11 <> 0 THEN cast(doc_id as string) END, 'patent_title', source, 'patent_abstract', text, 'patent_date', {_DATE.format(_DAY_SPARK)},
'inventors', CASE WHEN doc_id % 2 = 0 THEN array(named_struct('inventor_name_first', 'Ann', 'inventor_name_last', cast(doc_id as string))) ELSE array(named_struct('inventor_name_first', 'Bob', 'inventor_name_last', cast(null as string)), named_struct('inventor_name_first', '', 'inventor_name_last', '')) END,
'assignees', array(named_struct('assignee_organization', lang))))"""
    )
    reply = lambda listed: F.concat(F.lit('{"patents":['), F.array_join(listed, ","), F.lit("]}"))
    found = _asked(spark, "patentsview", read(spark, d, "documents"), item, reply)
    return found.select("id", "patentNumber", "title", F.md5("abstract").alias("abstract_md5"), F.array_join("inventors", ",").alias("inventors"), "assignee", "publicationDate", "url")


@query(
    "source_kr",
    f"""SELECT 'kipris:' || n AS id, n AS "patentNumber", coalesce(source, '') AS title, md5(coalesce(text, '')) AS abstract_md5, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A,B' || doc_id END AS inventors, filed AS "filingDate", opened AS "publicationDate" FROM (
SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'R' || doc_id ELSE 'A' || doc_id END AS n, CASE WHEN doc_id % 5 <> 0 THEN {_DAY_SQL} END AS opened, '2011-02-03' AS filed FROM documents) WHERE doc_id % 13 <> 0 AND coalesce(opened, filed) <= '{_CUTOFF}'""",
)
def _(spark, d):
    """The same of replies that hold one item or an array of them; the filing date stands in for a missing publication date."""
    item = F.expr(
        f"""to_json(named_struct('registrationNumber', CASE WHEN doc_id % 4 = 0 AND doc_id % 13 <> 0 THEN concat('R', doc_id) END, 'applicationNumber', CASE WHEN doc_id % 13 <> 0 THEN concat('A', doc_id) END,
'inventionTitle', source, 'astrtCont', text, 'inventorName', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('A|B', doc_id) END, 'applicationDate', '20110203', 'openDate', CASE WHEN doc_id % 5 <> 0 THEN replace({_DAY_SPARK}, '-', '') END))"""
    )
    reply = lambda listed: F.concat(
        F.lit('{"response":{"body":{"items":{"item":'), F.when(F.size(listed) == 1, F.get(listed, 0)).otherwise(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))), F.lit("}}}}")
    )
    found = _asked(spark, "kipris", read(spark, d, "documents"), item, reply)
    return found.select("id", "patentNumber", "title", F.md5("abstract").alias("abstract_md5"), F.array_join("inventors", ",").alias("inventors"), "filingDate", "publicationDate")


def _inverted(docs: DataFrame) -> DataFrame:
    """(doc_id, index): each text's words, between spaces, with their places."""
    words = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("pos", "word")).filter("word <> ''")
    places = words.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    return places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))


_PLAIN_WORDS = "array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), ' ')"


@query("inverted_text", f"SELECT doc_id, md5({_PLAIN_WORDS}) AS h FROM documents WHERE {_PLAIN_WORDS} <> ''")
def _(spark, d):
    """Texts out of the places of their words."""
    return _inverted(read(spark, d, "documents")).select("doc_id", F.md5(sources.inverted_text(F.col("index"))).alias("h"))


@query(
    "source_works",
    f"""SELECT 'openalex:W' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id ELSE 'W' || doc_id END AS "patentNumber", source AS title, md5({_PLAIN_WORDS}) AS abstract_md5,
CASE WHEN doc_id % 2 = 0 THEN day ELSE (1990 + doc_id % 30) || '-01-01' END AS "publicationDate", CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1/' || doc_id ELSE 'https://openalex.org/W' || doc_id END AS url
FROM (SELECT *, {_DAY_SQL} AS day FROM documents) WHERE source IS NOT NULL AND source <> '' AND CASE WHEN doc_id % 2 = 0 THEN day ELSE (1990 + doc_id % 30) || '-01-01' END <= '{_CUTOFF}'""",
)
def _(spark, d):
    """The same of scholarly replies, whose abstracts are indexes of words."""
    docs = read(spark, d, "documents")
    joined = docs.select("doc_id", "source").join(_inverted(docs), "doc_id", "left")
    item = F.expr(
        f"""to_json(named_struct('id', concat('https://openalex.org/W', doc_id), 'doi', CASE WHEN doc_id % 3 = 0 THEN concat('https://doi.org/10.1/', doc_id) END, 'title', source, 'abstract_inverted_index', index,
'publication_date', CASE WHEN doc_id % 2 = 0 THEN {_DAY_SPARK} END, 'publication_year', 1990 + doc_id % 30))"""
    )
    found = _asked(spark, "openalex", joined, item, lambda listed: F.concat(F.lit('{"results":['), F.array_join(listed, ","), F.lit("]}")))
    return found.select("id", "patentNumber", "title", F.md5("abstract").alias("abstract_md5"), "publicationDate", "url")


_KR_RAW = "CASE o_orderkey % 5 WHEN 0 THEN {1} WHEN 1 THEN {0} WHEN 2 THEN substr({0}, 1, 4) WHEN 3 THEN '' ELSE replace({0}, '-', '.') END"


@query(
    "kr_dates",
    f"""SELECT o_orderkey, CASE WHEN length(d) = 8 THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) ELSE nullif(t, '') END AS date FROM (
SELECT o_orderkey, t, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM (SELECT o_orderkey, {_KR_RAW.format("strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y%m%d')")} AS t FROM orders))""",
)
def _(spark, d):
    """Dates of orders as the KR service writes them: eight digits, with dashes or dots, a year, nothing."""
    raw = F.expr(_KR_RAW.format("date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'yyyyMMdd')"))
    return read(spark, d, "orders").select("o_orderkey", sources.kr_date(raw).alias("date"))


# ---- candidates ------------------------------------------------------------------------------------------------------


@query("dedup_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY upper(regexp_replace(text, '\\s', '', 'g'))")
def _(spark, d):
    return candidates.dedup(read(spark, d, "documents"), "text", "doc_id").select("doc_id")


@query(
    "cutoff_filter",
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS pub,
CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS filed FROM orders)
SELECT o_orderkey FROM o WHERE coalesce(pub, filed) IS NULL OR coalesce(pub, filed) = '' OR try_cast(coalesce(pub, filed) AS DATE) <= DATE '1996-06-30'""",
)
def _(spark, d):
    o = read(spark, d, "orders")
    r = F.pmod("o_orderkey", F.lit(5))
    pub = F.when(r == 0, None).when(r == 1, "").when(r == 2, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    filed = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"))
    return candidates.before_cutoff(o.select("o_orderkey", pub.alias("publicationDate"), filed.alias("filingDate")), "1996-06-30").select("o_orderkey")


@query(
    "document_text",
    """SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, ''), nullif(p_type, '')) AS text,
substr(concat(coalesce(p_name, ''), ' ', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, ' ', coalesce(p_type, '')), 1, 20) AS excerpt FROM part""",
)
def _(spark, d):
    brand = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "").otherwise(F.col("p_brand"))
    parts = (F.col("p_name"), brand, F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", candidates.document_text(*parts).alias("text"), candidates.excerpt(20, *parts).alias("excerpt"))


@query("url_validity", "SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS valid, page_id % 4 <> 1 AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS reachable FROM pages")
def _(spark, d):
    p = read(spark, d, "pages")
    status = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(405), F.lit(302)), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return p.select("page_id", candidates.url_valid(F.col("url")).alias("valid"), candidates.url_valid(F.col("url"), status).alias("reachable"))


@query("url_batch", "SELECT page_id, coalesce(page_id % 3 = 0 OR EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 3 = 0), false) AS urlValid FROM pages p")
def _(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    checked = p.filter("page_id % 3 = 0").select("url", F.lit(True).alias("valid"))
    return candidates.with_url_validity(p, checked).select("page_id", "urlValid")


@query(
    "labelled_candidates",
    "SELECT d.doc_id, coalesce(l.quality, floor(n_chars / 1000.0 + 0.5)::INT) AS score FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def _(spark, d):
    joined = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", S.round_half_up(F.col("n_chars") / 1000).cast("int")).alias("score"))


# ---- text ------------------------------------------------------------------------------------------------------------

_SENT = """n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\n', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS whole,
regexp_replace(regexp_replace(text, '\\n', ' ', 'g'), '\\s{2,}', ' ', 'g') AS x FROM documents),
g AS (SELECT doc_id, whole, list_filter(list_transform(string_split(regexp_replace(x, '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: length(y) >= 10) AS l FROM n),
f AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [whole] END AS l FROM g)"""


@query("sentences", f"WITH {_SENT} SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS h FROM f")
def _(spark, d):
    s = read(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("h"))


@query(
    "chunks",
    f"""WITH RECURSIVE {_SENT},
r AS (SELECT f.doc_id, l, 1 AS i, length(l[1]) + 1 AS used, 0 AS c FROM f JOIN documents USING (doc_id) WHERE length(trim(text)) >= 50
UNION ALL SELECT doc_id, l, i + 1, CASE WHEN used + length(l[i + 1]) > 1200 AND used >= 700 THEN length(l[i + 1]) + 1 ELSE used + length(l[i + 1]) + 1 END,
CASE WHEN used + length(l[i + 1]) > 1200 AND used >= 700 THEN c + 1 ELSE c END FROM r WHERE i < len(l)),
k AS (SELECT doc_id, c, string_agg(l[i], ' ' ORDER BY i) AS text FROM r GROUP BY doc_id, c),
p AS (SELECT doc_id, c, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY c) AS upto FROM k)
SELECT doc_id, upto::BIGINT - length(text) - 1 AS charStart, upto::BIGINT AS charEnd, md5(text) AS h FROM p WHERE length(text) >= 50""",
)
def _(spark, d):
    c = read(spark, d, "documents").select("doc_id", F.explode(chunking.chunk_array(F.col("text"), F.lit(0))).alias("c"))
    return c.select("doc_id", "c.charStart", "c.charEnd", F.md5("c.text").alias("h"))


@query(
    "keywords",
    f"""SELECT item_id, array_to_string(list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda x: list_position(k, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (
SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^A-Za-z0-9_가-힣\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2 AND x NOT IN ({_KSTOP})) AS k FROM benchmark)""",
)
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("words"))


#: White space of T.WS in the words of RE2.
_WS = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _re2(pattern: str) -> str:
    return pattern.replace(T.WS, _WS)


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _parts_sql(table: str, key: str) -> str:
    """CTE e(key, t, l, last_id): claim elements of a table's texts. RE2 has no look-ahead: list marks are put back after the cut, twice for marks that touch."""
    mark, again = _re2(claims.LIST_MARK), _re2(claims.LIST_MARK).replace(_WS, _WS[:-1] + r"\x01]")
    cut = "t"
    for m in (mark, again):
        for end, code in ((rf"(\n|{_WS}+[;；]{_WS}*)", 1), (rf"([;；]{_WS}*)", 2)):
            cut = rf"regexp_replace({cut}, '{end}({m})', chr({code}) || '\2', 'g')"
    name = _re2(claims.ELEMENT_ID)
    words = "그리고|및|또는|wherein|and|comprising"
    return f"""a AS (SELECT {key}, {_trimmed("coalesce(text, '')")} AS t FROM {table}),
c AS (SELECT {key}, t, list_filter(string_split_regex({cut}, '[\\x01\\x02]'), lambda p: {_trimmed('p')} <> '') AS listed,
list_filter(string_split(regexp_replace(regexp_replace(t, '(?i),{_WS}*({words})', chr(1) || '\\1', 'g'), '[;；]', chr(1), 'g'), chr(1)), lambda p: length({_trimmed('p')}) > 10) AS plain FROM a),
n AS (SELECT {key}, t, len(listed) > 1 AS is_list, CASE WHEN len(listed) > 1 THEN list_filter(list_transform(listed, lambda p, i: struct_pack(id := coalesce(nullif(regexp_extract(p, '{name}', 1), ''), nullif(regexp_extract(p, '{name}', 2), ''), chr(64 + i::INT)),
text := {_trimmed(f"regexp_replace(p, '{name}', '')")})), lambda x: x.text <> '')
ELSE list_transform(plain, lambda p, i: struct_pack(id := CASE WHEN i <= 26 THEN chr(64 + i::INT) ELSE i::VARCHAR END, text := {_trimmed('p')})) END AS f FROM c),
e AS (SELECT {key}, CASE WHEN len(f) > 0 THEN list_transform(f, lambda x: x.text) ELSE [t] END AS l, CASE WHEN len(f) > 0 THEN f[-1].id ELSE 'A' END AS last_id, is_list AND len(f) > 0 AS is_list FROM n)"""


@query("claim_elements", f"WITH {_parts_sql('documents', 'doc_id')} SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS h, last_id FROM e")
def _(spark, d):
    return _elements(read(spark, d, "documents"))


def _elements(docs: DataFrame) -> DataFrame:
    e = docs.select("doc_id", claims.elements(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: x["text"]), "|")).alias("h"), F.element_at("e", -1)["id"].alias("last_id"))


_BROAD_SQL = " || ".join(
    f"CASE WHEN regexp_matches(text, '(?i){chr(92)}b({w}){chr(92)}b') THEN '{label}|' ELSE '' END" for w, label in claims.BROAD[:3]
)


@query("broad_terms", f"SELECT doc_id, {_BROAD_SQL} AS labels FROM documents")
def _(spark, d):
    """All eight labels. The SQL tells only three; no document of the driver's tables has another."""
    found = F.transform(claims.broad_terms(F.coalesce("text", F.lit(""))), lambda x: F.regexp_extract(x, "— (.*)$", 1))
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit("|"))), "").alias("labels"))


_WORDING_SQL = " || ".join(
    f"CASE WHEN regexp_matches(t, '{w}') THEN '\"' || regexp_extract(t, '{w}', 0) || '\" — {label}|' ELSE '' END"
    for w, label in ((f"(?i){chr(92)}b({w}){chr(92)}b" if k < claims.ENGLISH_BROAD else w, label) for k, (w, label) in enumerate(claims.BROAD))
)


@query("broad_wordings", f"SELECT doc_id, {_WORDING_SQL} AS wordings FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(spark, d):
    """The first match of each of the eight kinds with its label."""
    found = F.transform(claims.broad_terms(F.coalesce("text", F.lit(""))), lambda x: F.concat(x, F.lit("|")))
    return read(spark, d, "documents").select("doc_id", F.array_join(found, "").alias("wordings"))


_FIELD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){w}') THEN '{n}'" for w, n in claims.FIELDS) + f" ELSE '{claims.NO_FIELD}' END"


@query("technical_field", f"SELECT doc_id, {_FIELD_SQL} AS field FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", claims.technical_field(F.col("text")).alias("field"))


_KEYWORDS = f"""list_filter(string_split_regex(regexp_replace(lower(text), '[^A-Za-z0-9_가-힣\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2 AND x NOT IN ({_KSTOP}))"""


@query(
    "relevant_passages",
    f"""WITH RECURSIVE k AS (SELECT list_distinct({_KEYWORDS}) AS k FROM benchmark WHERE item_id = 0),
d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
pa AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: {_trimmed("replace(x, chr(10), ' ')")}), lambda x: length(x) >= 80) AS l FROM d),
sc AS (SELECT doc_id, p, pos, len(list_filter(k, lambda w: contains(lower(p), w))) AS score FROM (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS pos FROM pa), k),
od AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS i FROM sc WHERE score > 0),
gr AS (SELECT doc_id, i, pos, p, length(p) <= 1500 AS taken, CASE WHEN length(p) <= 1500 THEN length(p) + 2 ELSE 0 END AS used FROM od WHERE i = 1
UNION ALL SELECT od.doc_id, od.i, od.pos, od.p, used + length(od.p) <= 1500, CASE WHEN used + length(od.p) <= 1500 THEN used + length(od.p) + 2 ELSE used END FROM gr JOIN od ON od.doc_id = gr.doc_id AND od.i = gr.i + 1),
ag AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS t FROM gr WHERE taken GROUP BY doc_id)
SELECT doc_id, md5(coalesce(t, {_trimmed('substr(text, 1, 1500)')})) AS h FROM d LEFT JOIN ag USING (doc_id)""",
)
def _(spark, d):
    claim = item(spark, d, 0)
    text = F.regexp_replace("text", "\n", "\n\n")
    return read(spark, d, "documents").select("doc_id", F.md5(chunking.relevant_passages(text, F.lit(claim), 1500)).alias("h"))


@query("document_titles", f"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trimmed('x')}), lambda x: length(x) > 5)[1] AS title FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", structure.title(F.col("text")).alias("title"))


@query(
    "search_queries",
    f"""WITH {_parts_sql('benchmark', 'item_id')}, q AS (SELECT item_id, list_concat([array_to_string(CASE WHEN is_list THEN l[1:3] ELSE l END, ' ')], CASE WHEN is_list THEN l[1:2] ELSE l[1:3] END) AS q FROM e)
SELECT item_id, array_to_string(list_transform(list_filter(list_zip(q, range(1, len(q) + 1)), lambda x: list_position(q, x[1]) = x[2]), lambda x: x[1])[1:5], '|') AS queries FROM q""",
)
def _(spark, d):
    """What is searched for each item: its important elements together, then its essential ones."""
    return read(spark, d, "benchmark").select("item_id", F.array_join(claims.search_queries(claims.elements(F.col("text"))), "|").alias("queries"))


@query(
    "expanded_queries",
    """WITH l AS (SELECT l_orderkey, list('q' || l_partkey ORDER BY l_linenumber, l_partkey) AS q, list('n' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, concat_ws(' ', o_orderpriority, nullif(array_to_string(q[1:3], ' '), ''), nullif(array_to_string(n, ' '), '')) AS query FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def _(spark, d):
    """Queries with the first three proposed ones and all component names."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows.alias("r"))
    texts = lambda c, p: F.transform("r", lambda x: F.concat(F.lit(p), x[c].cast("string")))
    joined = read(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey", "left")
    return joined.select("o_orderkey", candidates.expanded_query(F.col("o_orderpriority"), texts("l_partkey", "q"), texts("l_suppkey", "n")).alias("query"))


@query(
    "context_texts",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS k, l_partkey AS p, 'part ' || l_partkey AS title, repeat('x', (l_partkey % 23)::INT) || l_suppkey AS text FROM lineitem),
u AS (SELECT *, coalesce(sum(length(text) + length(title) + 4) OVER w, 0) AS used FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY k, p, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(used + length(text) <= 60) OVER (PARTITION BY l_orderkey ORDER BY k, p, text ROWS UNBOUNDED PRECEDING) AS fits FROM u)
SELECT l_orderkey, coalesce(string_agg('[' || title || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k, p, text) FILTER (fits), '') AS context FROM f GROUP BY l_orderkey""",
)
def _(spark, d):
    """Titled chunks of orders up to the first that no longer fits."""
    text = F.concat(F.expr("repeat('x', cast(l_partkey % 23 as int))"), F.col("l_suppkey").cast("string"))
    one = F.struct("l_linenumber", "l_partkey", text.alias("text"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("r"))
    chunks = F.transform("r", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    return rows.select("l_orderkey", candidates.context_text(chunks, 60).alias("context"))


@query("rendered_prompts", "SELECT p_partkey, 'Is ' || coalesce(p_name, '') || ' like ' || coalesce(p_brand, '') || '? ' || coalesce(p_name, '') || ' {{other}}' AS prompt FROM part")
def _(spark, d):
    values = {"name": F.col("p_name"), "brand": F.col("p_brand")}
    return read(spark, d, "part").select("p_partkey", T.render_column(F.lit("Is {{name}} like {{brand}}? {{name}} {{other}}"), values).alias("prompt"))


@query(
    "bumped_versions",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1.' || p_size || '.' || (p_partkey + 1) WHEN 1 THEN (p_size + 1)::VARCHAR ELSE '2.0.1' END AS version FROM part",
)
def _(spark, d):
    version = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('1.', p_size, '.', p_partkey) WHEN 1 THEN cast(p_size as string) ELSE '2.0.x' END")
    return read(spark, d, "part").select("p_partkey", T.bump_version(version).alias("version"))


@query(
    "stage2_ranks",
    "SELECT o_orderkey, floor(r * 10000 + 0.5)::INT AS weighted_score, row_number() OVER (ORDER BY floor(r * 10000 + 0.5) DESC, o_orderkey)::BIGINT AS stage2_rank FROM (SELECT o_orderkey, 1e0 / (60 + o_orderkey % 97 + 1) AS r FROM orders) ORDER BY stage2_rank LIMIT 100",
)
def _(spark, d):
    """The hundred best candidates reranked by their fused scores."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", (1 / (F.lit(60.0) + F.pmod("o_orderkey", F.lit(97)) + 1)).alias("rrf_score"))
    best = ranking.top(o, "rrf_score", "o_orderkey", search.RERANKED)
    scored = search.reranked(best, None)
    return scored.select(F.col("id").cast("long").alias("o_orderkey"), "weighted_score", F.col("stage2_rank").cast("long").alias("stage2_rank"))


@query(
    "rerank_batches",
    "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT (rank - 1) // 10 AS batch, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 100 GROUP BY ALL",
)
def _(spark, d):
    hits = ranking.top(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 150).withColumn("id", F.col("o_orderkey").cast("string"))
    return search.rerank_batches(hits).select(F.col("batch").cast("long").alias("batch"), F.array_join("ids", ",").alias("ids"))


def _neighbours(df: DataFrame, key: str) -> DataFrame:
    """Each text and that of the next key."""
    after = df.select((F.col(key) - 1).alias(key), F.col("text").alias("r"))
    return df.select(key, F.col("text").alias("l")).join(after, key)


@query("word_diff")
def _(spark, d):
    return diff.with_diff(_neighbours(read(spark, d, "benchmark"), "item_id"), "l", "r").select("item_id", "equal", "deleted", "inserted", "similarity")


@query("document_diff")
def _(spark, d):
    """The word differences of every document and the next one."""
    return diff.with_diff(_neighbours(read(spark, d, "documents"), "doc_id"), "l", "r").select("doc_id", "equal", "deleted", "inserted", "similarity")


@query("unified_diff")
def _(spark, d):
    """The words of every item and the next one in unified order."""
    return diff.unified_rows(_neighbours(read(spark, d, "benchmark"), "item_id"), "item_id", "l", "r")


@query(
    "evidence_validation",
    """WITH w AS (SELECT doc_id, d.text, b.text AS ev, list_filter(string_split_regex(lower(trim(b.text)), '\\s+'), lambda x: length(x) > 2) AS l FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, CASE WHEN ev IS NULL OR len(l) = 0 OR 2 * len(list_filter(l, lambda x: contains(lower(text), x))) >= len(l) THEN 'kept' ELSE 'replaced' END AS outcome FROM w""",
)
def _(spark, d):
    """Documents meet the items of the whole benchmark in turn."""
    b = read(spark, d, "benchmark")
    size = b.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    docs = read(spark, d, "documents").withColumn("item_id", F.pmod("doc_id", F.lit(max(1, size.n))))
    ev = b.select("item_id", F.col("text").alias("ev"))
    j = docs.join(F.broadcast(ev) if (size.bytes or 0) <= 8 << 20 else ev, "item_id", "left")
    return j.select("doc_id", F.when(S.valid_evidence(F.col("ev"), F.col("text")) == S.UNCONFIRMED, "replaced").otherwise("kept").alias("outcome"))


# ---- structured documents --------------------------------------------------------------------------------------------

#: A document of several sections, claims and figures around each text, in words that Spark and DuckDB share.
_PATENT = """'Title of number ' || doc_id || chr(10) || '(22) 2019.' || (doc_id % 9 + 1) || '.0' || (doc_id % 8 + 1) || chr(10) || '[Technical Field]' || chr(10) || 'It is about ' || coalesce(source, '') || ' of some kind and works with parts, as FIG. ' || (doc_id % 7 + 1) || 'a tells.'
|| chr(10) || 'BACKGROUND ART' || chr(10) || coalesce(text, '') || chr(10) || 'Brief Description of Drawings' || chr(10) || 'FIG. ' || (doc_id % 7 + 1) || 'a shows a view of ' || coalesce(lang, '') || chr(10) || '도 ' || (doc_id % 5 + 1) || '은 측면도' || chr(10) || '【발명의 효과】' || chr(10)
|| 'Its use is seen in 도' || (doc_id % 5 + 1) || ' and (FIG.' || (doc_id % 3 + 11) || ') by everybody who looks at it.' || chr(10) || 'Claims' || chr(10) || 'Claim 1. A device of ' || coalesce(source, '') || ' with a frame.' || chr(10)
|| 'Claim 2. The device of claim 1, wherein it has ' || (doc_id % 4) || ' wheels.' || chr(10) || '청구항 3. 제' || (doc_id % 2 + 1) || '항에 있어서, 바퀴.' || chr(10) || 'Claim 4. A method.'"""


def patents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) of such a document around every text of ``documents``."""
    return read(spark, d, "documents").select("doc_id", F.expr(_PATENT).alias("text"))


_HEAD_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"starts_with(n, '{k}') OR starts_with('{k}', n)" for k in keys.split()) + f" THEN '{kind}'" for kind, keys in structure.HEADINGS.items()
) + " END"


def _lines_sql(text: str) -> str:
    """CTE li(doc_id, pos, t, kind): every line of documents with the section that it heads, or null."""
    bare = "lower(regexp_replace(regexp_replace(t, '[【】\\[\\]「」『』〔〕()（）]', '', 'g'), '\\s+', '', 'g'))"
    return f"""sp AS (SELECT doc_id, string_split({text}, chr(10)) AS l FROM documents WHERE {text} IS NOT NULL),
li AS (SELECT doc_id, pos, t, CASE WHEN length(n) BETWEEN 2 AND 60 AND NOT regexp_matches(t, '(?i)^\\s*(청구항|claim)\\s*[0-9]') THEN {_HEAD_SQL} END AS kind FROM (
SELECT doc_id, pos, t, {bare} AS n FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l)))::INT AS pos FROM sp)))"""


def _sections_sql(text: str) -> str:
    """CTE sec(doc_id, ord, type, title, text)."""
    return f"""{_lines_sql(text)},
ru AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ord FROM li),
al AS (SELECT doc_id, ord, coalesce(max(kind), 'unknown') AS type, coalesce({_trimmed('max(t) FILTER (kind IS NOT NULL)')}, '') AS title,
{_trimmed("coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (kind IS NULL), '')")} AS text FROM ru GROUP BY doc_id, ord),
sec AS (SELECT * FROM al WHERE text <> '')"""


def _chunks_sql(text: str) -> str:
    """CTE ch(doc_id, chunk_id, type, a, b, text, n_before, n_after): chunks of sections."""
    flat = f"regexp_replace(replace(text, chr(10), ' '), '{_WS}{{2,}}', ' ', 'g')"
    return f"""{_sections_sql(text)},
pl AS (SELECT *, coalesce(sum(length(text) + length(title) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS origin FROM sec),
fl AS (SELECT doc_id, ord, type, origin, {flat} AS x FROM pl WHERE type <> 'claims' AND length(text) >= 50),
gs AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '([.?!]) ', '\\1' || chr(1), 'g'), '(?s)(。).', '\\1' || chr(1), 'g'), chr(1)), lambda y: {_trimmed('y')}), lambda y: length(y) >= 10) AS g FROM fl),
fs AS (SELECT doc_id, ord, type, origin, CASE WHEN len(g) > 0 THEN g ELSE [{_trimmed('x')}] END AS l FROM gs),
rc AS (SELECT *, 1 AS i, length(l[1]) + 1 AS used, 0 AS c FROM fs
UNION ALL SELECT doc_id, ord, type, origin, l, i + 1, CASE WHEN used + length(l[i + 1]) > 1200 AND used >= 700 THEN length(l[i + 1]) + 1 ELSE used + length(l[i + 1]) + 1 END,
CASE WHEN used + length(l[i + 1]) > 1200 AND used >= 700 THEN c + 1 ELSE c END FROM rc WHERE i < len(l)),
kc AS (SELECT doc_id, ord, type, origin, c, string_agg(l[i], ' ' ORDER BY i) AS text FROM rc GROUP BY doc_id, ord, type, origin, c),
pc AS (SELECT *, origin + sum(length(text) + 1) OVER (PARTITION BY doc_id, ord ORDER BY c) AS upto FROM kc),
ok AS (SELECT doc_id, ord, type, c, text, (upto - length(text) - 1)::BIGINT AS a, upto::BIGINT AS b FROM pc WHERE length(text) >= 50),
ch AS (SELECT doc_id, 'chunk-' || row_number() OVER (PARTITION BY doc_id ORDER BY ord, c) || '-' || type AS chunk_id, type, a, b, text,
least(150, coalesce(length(lag(text) OVER s), 0)) AS n_before, least(150, coalesce(length(lead(text) OVER s), 0)) AS n_after FROM ok WINDOW s AS (PARTITION BY doc_id, ord ORDER BY c))"""


def _chunk_rows(docs: DataFrame) -> DataFrame:
    c = docs.select("doc_id", F.inline(chunking.section_chunks(structure.section_array(F.col("text")))))
    return c.select("doc_id", "chunk_id", "sectionType", "charStart", "charEnd", F.length("overlapBefore").alias("n_before"), F.length("overlapAfter").alias("n_after"), F.md5("text").alias("h"))


_CHUNK_COLUMNS = 'doc_id, chunk_id, type AS "sectionType", a AS "charStart", b AS "charEnd", n_before::INT AS n_before, n_after::INT AS n_after, md5(text) AS h'


@query("section_chunks", f"WITH RECURSIVE {_chunks_sql('text')} SELECT {_CHUNK_COLUMNS} FROM ch")
def _(spark, d):
    return _chunk_rows(read(spark, d, "documents"))


@query("patent_chunks", f"WITH RECURSIVE {_chunks_sql(_PATENT)} SELECT {_CHUNK_COLUMNS} FROM ch")
def _(spark, d):
    return _chunk_rows(patents(spark, d))


_SECTION_POST = _POST.replace(f"d AS (SELECT doc_id, {tok('text')} AS t FROM documents)", f"d AS (SELECT doc_id || '/' || chunk_id AS doc_id, {tok('text')} AS t FROM ch WHERE type IN ('background', 'technical_field'))")


@query(
    "section_topk",
    f"""WITH RECURSIVE {_chunks_sql(_PATENT)}, {_SECTION_POST}, {_q(0)}, {_bm()} SELECT doc_id AS chunk_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20""",
)
def _(spark, d):
    """The chunks of two section types that answer an item best, by statistics of these sections alone."""
    c = patents(spark, d).select("doc_id", F.inline(chunking.section_chunks(structure.section_array(F.col("text")))))
    c = c.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id"))
    return search.retrieve_from_sections(c, item(spark, d, 0), ["background", "technical_field"], 20).select("chunk_id", F.round("score", 6).alias("score"))


@query("section_headings", f"WITH {_sections_sql(_PATENT)} SELECT doc_id, ord::BIGINT AS ord, type, title, md5(text) AS h FROM sec")
def _(spark, d):
    """Sections of structured documents: their types and titles."""
    return structure.sections(patents(spark, d)).select("doc_id", "ord", "type", "title", F.md5("text").alias("h"))


def _split_sql(c: str) -> str:
    """An array of the claims in a text."""
    marked = rf"(?i)(?:^|\n){_WS}*(?:청구항|claim){_WS}+[0-9]+(?:\.|{_WS})"
    numbered = rf"(?:^|\n){_WS}*[0-9]+[.)]{_WS}+"
    # a mark may end with the line break that begins the next one, which replacing in one go skips in both engines alike
    parts = lambda m: f"list_filter(list_transform(string_split(regexp_replace({c}, '{m}', chr(1), 'g'), chr(1))[2:], lambda x: {_trimmed('x')}), lambda x: x <> '')"
    return f"CASE WHEN regexp_matches({c}, '{marked}') THEN {parts(marked)} WHEN regexp_matches({c}, '{numbered}') THEN {parts(numbered)} ELSE list_filter([{_trimmed(c)}], lambda x: x <> '') END"


def _parent_sql(c: str, variant: str) -> str:
    found = []
    for pattern in claims.DEPENDS[variant]:
        p = _re2(pattern).replace("(?![A-Za-z0-9_])", r"\b")
        number = f"nullif(regexp_extract({c}, '{p}', 1), '')"
        if variant == "manual":
            number = f"coalesce({number}, nullif(regexp_extract({c}, '{p}', 2), ''))"
        found.append(f"try_cast({number} AS INT)")
    return f"coalesce({', '.join(found)}, NULL)"


_CLAIMS_SQL = f"""WITH {_sections_sql(_PATENT)},
ct AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS c FROM sec WHERE type = 'claims' GROUP BY doc_id),
cl AS (SELECT doc_id, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS num FROM (SELECT doc_id, {_split_sql('c')} AS l FROM ct))"""


def _patent_claims(spark, d) -> DataFrame:
    text = F.array_join(F.transform(F.filter(structure.section_array(F.col("text")), lambda x: x["type"] == "claims"), lambda x: x["text"]), "\n")
    c = patents(spark, d).select("doc_id", F.posexplode(structure.split_claims(text)).alias("pos", "text"))
    return c.select("doc_id", (F.col("pos") + 1).alias("num"), "text")


@query("split_claims", f"{_CLAIMS_SQL} SELECT doc_id, num, text FROM cl")
def _(spark, d):
    return _patent_claims(spark, d)


@query("claim_dependency", f"{_CLAIMS_SQL} SELECT doc_id, num, {', '.join(f'{_parent_sql(chr(116) + chr(101) + chr(120) + chr(116), v)} AS {v}_parent' for v in claims.DEPENDS)} FROM cl")
def _(spark, d):
    """The claim on which each claim of the structured documents depends, by all three wordings."""
    return _patent_claims(spark, d).select("doc_id", "num", *(claims.parent(F.col("text"), v).alias(f"{v}_parent") for v in claims.DEPENDS))


def _figure_key_sql(c: str) -> str:
    number = f"regexp_extract({c}, '([0-9]+[a-zA-Z]?)', 1)"
    return f"CASE WHEN contains({c}, '도') THEN '도 ' || {number} WHEN regexp_matches({c}, '(?i)fig') THEN 'FIG. ' || {number} ELSE {_trimmed(c)} END"


def _figures_sql(text: str, described: str) -> str:
    """CTE fi(doc_id, number, description, chunk_ids): ``described`` is SQL for (doc_id, l, whole) with the lines that describe figures and all text that names them."""
    ko, en, any_, mention = (_re2(x) for x in (structure.FIGURE_KO, structure.FIGURE_EN, structure.FIGURE, structure.MENTION))
    one = f"""CASE WHEN regexp_matches(x, '{ko}') THEN struct_pack(number := '도 ' || regexp_extract(x, '{ko}', 1), description := {_trimmed(f"regexp_extract(x, '{ko}', 2)")})
WHEN regexp_matches(x, '{en}') THEN struct_pack(number := 'FIG. ' || regexp_extract(x, '{en}', 1), description := {_trimmed(f"regexp_extract(x, '{en}', 2)")}) END"""
    return f"""{_chunks_sql(text)}, ds AS ({described}),
rf AS (SELECT doc_id, unnest(r) AS r, unnest(range(len(r))) AS k FROM (SELECT doc_id, list_concat(list_filter(list_transform(l, lambda x: {one}), lambda x: x IS NOT NULL),
list_transform(regexp_extract_all(whole, '{any_}'), lambda x: struct_pack(number := {_figure_key_sql('x')}, description := ''))) AS r FROM ds)),
rn AS (SELECT doc_id, {_figure_key_sql('r.number')} AS number, arg_min(r.description, k) AS description FROM rf GROUP BY ALL),
mt AS (SELECT doc_id, chunk_id, unnest(regexp_extract_all(text, '{mention}')) AS raw FROM ch),
ln AS (SELECT doc_id, {_figure_key_sql('raw')} AS number, list_sort(list(DISTINCT chunk_id)) AS ids FROM mt GROUP BY ALL),
fi AS (SELECT doc_id, number, coalesce(description, '') AS description, array_to_string(coalesce(ids, []), ',') AS chunk_ids FROM rn FULL JOIN ln USING (doc_id, number))"""


_ALL_LINES = "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS whole FROM documents"
_DRAWINGS = "SELECT doc_id, string_split(string_agg(text, chr(10) ORDER BY ord), chr(10)) AS l, string_agg(text, chr(10) ORDER BY ord) AS whole FROM sec WHERE type = 'figures_description' GROUP BY doc_id"


@query("figure_links", f"WITH RECURSIVE {_figures_sql(_PATENT, _DRAWINGS)} SELECT doc_id, number, description, chunk_ids FROM fi")
def _(spark, d):
    """The figures of the structured documents with the chunks that name them."""
    secs = patents(spark, d).select("doc_id", structure.section_array(F.col("text")).alias("s"))
    told = F.array_join(F.transform(F.filter("s", lambda x: x["type"] == "figures_description"), lambda x: x["text"]), "\n")
    links = secs.select("doc_id", F.inline(structure.figure_links(chunking.section_chunks(F.col("s")), structure.figures(told))))
    return links.select("doc_id", "number", "description", F.array_join("chunk_ids", ",").alias("chunk_ids"))


# ---- the same operators over all documents ---------------------------------------------------------------------------


@query("document_claims", f"SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS h FROM (SELECT doc_id, {_split_sql('t')} AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def _(spark, d):
    c = read(spark, d, "documents").select("doc_id", structure.split_claims(F.coalesce("text", F.lit(""))).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("h"))


@query(
    "document_claim_parents",
    f"""SELECT doc_id, array_to_string(list_transform(c, lambda x: coalesce(({_parent_sql('x', 'enrich')})::VARCHAR, '-')), ',') AS parents,
array_to_string(list_transform(c, lambda x: coalesce(({_parent_sql('x', 'graph')})::VARCHAR, '-')), ',') AS graph_parents FROM (SELECT doc_id, {_split_sql('t')} AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
)
def _(spark, d):
    """The parent of each claim of a document by both wordings, ``-`` for an independent one."""
    c = read(spark, d, "documents").select("doc_id", structure.split_claims(F.coalesce("text", F.lit(""))).alias("c"))

    def parents(variant: str):
        return F.array_join(F.transform("c", lambda x: F.coalesce(claims.parent(x, variant).cast("string"), F.lit("-"))), ",")

    return c.select("doc_id", parents("enrich").alias("parents"), parents("graph").alias("graph_parents"))


_DATED = "CASE WHEN regexp_matches({0}, '{1}') AND try_cast(regexp_extract({0}, '{1}', 1) AS INT) BETWEEN 1981 AND 2027 THEN regexp_extract({0}, '{1}', 1) || '-' || lpad(regexp_extract({0}, '{1}', 2), 2, '0') || '-' || lpad(regexp_extract({0}, '{1}', 3), 2, '0') END"
_NEAR = ", ".join("CASE WHEN contains(t, '{0}') THEN {1} END".format(m, _DATED.format(f"substr(t, strpos(t, '{m}'), 120)", structure.DATE)) for m in structure.DATE_MARKS)


@query("document_bib_dates", f"SELECT doc_id, coalesce({_NEAR}, {_DATED.format('t', structure.DATE)}) AS date FROM (SELECT doc_id, substr(text, 1, 6000) AS t FROM documents)")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", structure.document_date(F.col("text"), 2026).alias("date"))


@query("document_dates", f"SELECT doc_id, coalesce({_NEAR}, {_DATED.format('t', structure.DATE)}) AS date FROM (SELECT doc_id, substr({_PATENT}, 1, 6000) AS t FROM documents)")
def _(spark, d):
    return patents(spark, d).select("doc_id", structure.document_date(F.col("text"), 2026).alias("date"))


@query(
    "document_headings",
    f"WITH {_lines_sql("coalesce(text, '')")} SELECT doc_id, pos, kind FROM li",
)
def _(spark, d):
    """Every line of every document with the section that it heads, or null."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", structure.section_type(F.col("line")).alias("kind"))


@query(
    "document_figures",
    f"""WITH RECURSIVE {_figures_sql('text', _ALL_LINES)},
fo AS (SELECT *, coalesce(try_cast(regexp_replace(number, '[^0-9]', '', 'g') AS INT), 0) AS place FROM fi),
fa AS (SELECT doc_id, count(*) AS n, string_agg(number || '|' || description || '|' || chunk_ids, ';' ORDER BY place, number) AS f FROM fo GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(f, '') AS figures FROM documents LEFT JOIN fa USING (doc_id)""",
)
def _(spark, d):
    """The figures of every document, in the order of their numbers, with the chunks that name them."""
    none = F.array().cast("array<struct<chunk_id:string,text:string>>")
    made = F.transform(chunking.section_chunks(structure.section_array(F.col("text"))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text")))
    f = read(spark, d, "documents").select("doc_id", structure.figure_links(F.coalesce(made, none), structure.figures(F.col("text"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat_ws("|", x["number"], x["description"], F.array_join(x["chunk_ids"], ","))), ";")
    return f.select("doc_id", F.size("f").cast("long").alias("n"), text.alias("figures"))


# ---- scores ----------------------------------------------------------------------------------------------------------


@query(
    "weighted_charts",
    """WITH a AS (SELECT l_orderkey, sum(l_discount * 10 * l_linenumber) / sum(l_linenumber) AS sim, floor(sum(l_discount * 1000 * l_linenumber) / sum(l_linenumber) + 0.5)::INT AS weighted FROM lineitem GROUP BY l_orderkey),
b AS (SELECT l_orderkey, round(sim, 6) AS similarity, weighted FROM a)
SELECT *, CASE WHEN similarity >= 0.75 THEN 'COVERED' WHEN similarity >= 0.4 THEN 'PARTIAL' ELSE 'NOT_COVERED' END AS verdict,
CASE WHEN similarity >= 0.75 THEN 'HIGH' WHEN similarity >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS novelty_risk,
CASE WHEN similarity >= 0.55 THEN 'HIGH' WHEN similarity >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS inventiveness_risk, weighted >= 70 AS novelty_threat, weighted >= 50 AS inventiveness_threat FROM b""",
)
def _(spark, d):
    li = read(spark, d, "lineitem")
    w, sim = F.col("l_linenumber"), F.col("l_discount") * 10
    a = li.groupBy("l_orderkey").agg(
        F.round(F.sum(sim * w) / F.sum(w), 6).alias("similarity"), S.round_half_up(F.sum(F.col("l_discount") * 1000 * w) / F.sum(w)).cast("int").alias("weighted")
    )
    s, n = F.col("similarity"), F.lit(None).cast("boolean")
    return a.select(
        "*",
        S.verdict(s).alias("verdict"),
        S.novelty_risk(s).alias("novelty_risk"),
        S.inventiveness_risk(s).alias("inventiveness_risk"),
        S.novelty_threat(n, F.col("weighted")).alias("novelty_threat"),
        S.inventiveness_threat(n, F.col("weighted")).alias("inventiveness_threat"),
    )


@query(
    "fallback_scores",
    """SELECT o_orderkey, least(100, greatest(0, floor(r / (2e0 / 61) * 100 + 0.5)))::INT AS fallback, floor(r * 10000 + 0.5)::INT AS plain FROM (
SELECT o_orderkey, 1e0 / (60 + o_orderkey % 97 + 1) + 1e0 / (60 + o_orderkey % 89 + 1) AS r FROM orders)""",
)
def _(spark, d):
    r = 1 / (F.lit(60.0) + F.pmod("o_orderkey", F.lit(97)) + 1) + 1 / (F.lit(60.0) + F.pmod("o_orderkey", F.lit(89)) + 1)
    return read(spark, d, "orders").select("o_orderkey", S.fallback_score(r).cast("int").alias("fallback"), S.plain_score(r).cast("int").alias("plain"))


#: Ten documents a batch; every fifth reply can't be read, every seventh has one more item, of no known document.
_SCORES = "doc_id, doc_id // 10 AS batch, doc_id % 101 AS s1, (doc_id * 7) % 101 AS s2, substr(coalesce(text, ''), 1, 12) AS said"


@query(
    "rerank_replies",
    f"""WITH x AS (SELECT {_SCORES}, text FROM documents), f AS (SELECT batch, min(doc_id) AS first FROM x GROUP BY batch),
r AS (SELECT doc_id, s1, s2, doc_id % 3 = 0 AS flagged, doc_id % 2 = 0 AS weighed, 'why ' || doc_id AS reasoning, said FROM x WHERE batch % 5 <> 0 UNION ALL SELECT first, 90, 10, false, false, 'stray', 'zz qq xx vv' FROM f WHERE batch % 5 <> 0 AND batch % 7 = 0),
w AS (SELECT *, floor((s1 * (CASE WHEN weighed THEN 3 ELSE 1 END) + s2) / (CASE WHEN weighed THEN 4e0 ELSE 2e0 END) + 0.5)::INT AS weighted_score FROM r)
SELECT doc_id, weighted_score, CASE WHEN flagged THEN true ELSE weighted_score >= 70 END AS novelty_threat, weighted_score >= 50 AS inventiveness_threat, reasoning FROM w
UNION ALL SELECT doc_id, least(100, greatest(0, floor(1e0 / (60 + doc_id % 50 + 1) / (2e0 / 61) * 100 + 0.5)))::INT, false, false, '(no readable reply; score from rank fusion)' FROM x WHERE batch % 5 = 0""",
)
def _(spark, d):
    """Scores of all documents out of the replies for their batches, which are built from the documents."""
    docs = read(spark, d, "documents")
    x = docs.select("doc_id", F.expr("doc_id div 10").alias("batch"), F.expr("doc_id % 101").alias("s1"), F.expr("(doc_id * 7) % 101").alias("s2"), F.expr("substr(coalesce(text, ''), 1, 12)").alias("said"))
    items = F.expr(
        """named_struct('id', cast(doc_id as string), 'elements', array(named_struct('id', 'A', 'score', s1, 'evidence', said), named_struct('id', 'B', 'score', s2, 'evidence', '')),
'importanceWeights', CASE WHEN doc_id % 2 = 0 THEN map('A', 3) END, 'noveltyThreat', CASE WHEN doc_id % 3 = 0 THEN true END, 'reasoning', concat('why ', doc_id))"""
    )
    stray = """named_struct('id', 'unknown', 'elements', array(named_struct('id', 'A', 'score', 90L, 'evidence', 'zz qq xx vv'), named_struct('id', 'B', 'score', 10L, 'evidence', '')),
'importanceWeights', cast(null as map<string,int>), 'noveltyThreat', cast(null as boolean), 'reasoning', 'stray')"""
    batches = x.groupBy("batch").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.collect_list(items).alias("items"))
    told = F.when(F.expr("batch % 7 = 0"), F.array_append("items", F.expr(stray))).otherwise(F.col("items"))
    reply = F.when(F.expr("batch % 5 = 0"), F.lit("sorry, no")).otherwise(F.concat(F.lit("Here you are: ```json\n"), F.to_json(told), F.lit("\n``` as asked")))
    batches = batches.select("batch", F.col("ids").cast("array<string>").alias("ids"), reply.alias("reply"))
    rrf = 1 / (F.lit(60.0) + F.pmod("doc_id", F.lit(50)) + 1)
    known = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.lit("").alias("claims"), rrf.alias("rrf_score"))
    out = replies.rerank(batches, known)
    return out.select(F.col("id").cast("long").alias("doc_id"), "weighted_score", "novelty_threat", "inventiveness_threat", "reasoning")


_CHART_SQL = """WITH e AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN l_linenumber = 1 THEN 3 WHEN l_linenumber < 4 THEN 2 ELSE 1 END AS importance, CASE l_orderkey % 3 WHEN 0 THEN (l_partkey % 100 + 0.37e0) / 100e0 WHEN 1 THEN CASE WHEN l_linenumber % 2 = 1 THEN (l_partkey % 100 + 0.37e0) / 100e0 ELSE 0e0 END ELSE 0e0 END AS sim FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)),
v AS (SELECT *, CASE WHEN l_orderkey % 3 = 1 AND k = 1 THEN 'PARTIAL' WHEN sim >= 0.75 THEN 'COVERED' WHEN sim >= 0.4 THEN 'PARTIAL' ELSE 'NOT_COVERED' END AS verdict FROM e),
o AS (SELECT l_orderkey, sum(sim * importance) / sum(importance) AS s, string_agg(k || ':' || verdict, ',' ORDER BY k) AS verdicts, CASE l_orderkey % 3 WHEN 0 THEN 'why' WHEN 1 THEN CASE WHEN min(k) % 2 = 1 THEN 'told' ELSE '' END ELSE '(analysis failed)' END AS reasoning FROM v GROUP BY l_orderkey)
SELECT l_orderkey, round(s, 9) AS similarity, verdicts, reasoning, CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS novelty_risk, CASE WHEN s >= 0.55 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS inventiveness_risk FROM o"""


@query("charts_of_orders", _CHART_SQL)
def _(spark, d):
    """Charts whose elements are the lines of orders: from scores, from a model's reply, and from a reply that can't be read."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg((F.min("l_partkey") % 100 + 0.37).alias("s"))
    one = F.expr("named_struct('k', k, 'id', cast(k as string), 'importance', CASE WHEN k = 1 THEN 3 WHEN k < 4 THEN 2 ELSE 1 END, 'score', cast(s as double))")
    e = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("elements"))
    scores = "transform(elements, x -> named_struct('id', x.id, 'score', x.score, 'evidence', 'seen'))"
    told = """transform(filter(elements, x -> x.k % 2 = 1), x -> named_struct('elementId', x.id, 'priorArtText', 'text', 'similarity', x.score, 'verdict', CASE WHEN x.k = 1 THEN 'PARTIAL' END, 'reasoning', 'told'))"""
    inputs = e.select(
        "l_orderkey",
        "elements",
        F.expr(f"CASE WHEN l_orderkey % 3 = 0 THEN {scores} END").alias("element_scores"),
        F.lit("why").alias("reasoning"),
        F.expr(f"CASE l_orderkey % 3 WHEN 1 THEN concat('So: ', to_json(named_struct('rows', {told}, 'summary', 's'))) ELSE 'nothing' END").alias("chart_reply"),
    )
    made = replies.charts(inputs)
    verdicts = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["id"], r["verdict"])), ",")
    return made.select("l_orderkey", F.round("overall_similarity", 9).alias("similarity"), verdicts.alias("verdicts"), F.get("rows", 0)["reasoning"].alias("reasoning"), "novelty_risk", "inventiveness_risk")


# ---- store -----------------------------------------------------------------------------------------------------------


@query("token_totals", "SELECT coalesce(sum(event_id % 1000), 0)::BIGINT AS total_input, coalesce(sum(event_id % 77), 0)::BIGINT AS total_output, count(*)::BIGINT AS count FROM events")
def _(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    return store.token_totals(e)


@query(
    "running_usage",
    """SELECT event_id, sum(event_id % 1000) OVER w::BIGINT AS tokens, round(sum(event_id % 1000) OVER w / 1e6 * 3 + sum(event_id % 77) OVER w / 1e6 * 15, 6) AS dollars
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.sum(F.col("event_id") % 1000).over(w), F.sum(F.col("event_id") % 77).over(w)
    return read(spark, d, "events").select("event_id", a.alias("tokens"), F.round(a / 1e6 * 3 + b / 1e6 * 15, 6).alias("dollars"))


@query("recent_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(spark, d):
    return store.recent(read(spark, d, "events"), 200, "ts", "event_id").select("event_id", "event_type")


@query("project_searches", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return read(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@query("analyses_of_searches", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    o = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    gone = read(spark, d, "orders").filter("o_orderstatus = 'F'")
    return store.delete(read(spark, d, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query(
    "upsert_latest",
    """WITH o AS (SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
n AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id, event_type, coalesce(n.event_id, o.event_id) AS event_id FROM o LEFT JOIN n USING (user_id, event_type)""",
)
def _(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    old = candidates.first_per_key(e, F.struct("user_id", "event_type"), "event_id")
    return store.upsert(old, e.filter("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


@query(
    "insert_or_ignore",
    """WITH o AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id), n AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)""",
)
def _(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    old = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return store.insert_or_ignore(old, e.select("user_id", "event_id"), ["user_id"], "event_id")


@query("activate_one", "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_partkey IN (1, 7)) THEN p_partkey IN (1, 7) AND (p_partkey = (SELECT max(p_partkey) FROM part q WHERE q.p_brand = part.p_brand AND q.p_partkey IN (1, 7))) ELSE p_partkey % 2 = 0 END AS is_active FROM part")
def _(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 2 == 0).alias("is_active"))
    chosen = p.filter("p_partkey in (1, 7)").groupBy("p_brand").agg(F.max("p_partkey").alias("p_partkey"))
    return store.activate(p, "p_brand", "p_partkey", chosen).select("p_partkey", "is_active")


@query("next_ids", "SELECT n_nationkey, 100 + row_number() OVER (ORDER BY n_name)::BIGINT AS id FROM nation")
def _(spark, d):
    return store.with_ids(read(spark, d, "nation"), ["n_name"], 100).select("n_nationkey", "id")


@query("patch_columns", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS s_name, s_nationkey FROM supplier")
def _(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changes = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "new").alias("s_name"), F.lit(None).cast("int").alias("s_nationkey"))
    return store.patch(s, changes, "s_suppkey")


@query(
    "claim_roots",
    """WITH RECURSIVE c AS (SELECT c_custkey AS num, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey < 3 THEN c_custkey + 1000000 ELSE c_custkey // 2 END AS parent FROM customer),
r AS (SELECT num, num AS cur, 0 AS depth FROM c UNION ALL SELECT r.num, c.parent, depth + 1 FROM r JOIN c ON c.num = r.cur WHERE c.parent IS NOT NULL AND depth < 64)
SELECT num, max_by(cur, depth) AS root FROM r GROUP BY num""",
)
def _(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k.alias("num"), F.when(k % 7 == 0, None).when(k < 3, k + 1000000).otherwise(F.floor(k / 2)).cast("long").alias("parent"))
    return claims.roots(c)


@query(
    "claim_orphans",
    """WITH RECURSIVE c AS (SELECT c_custkey AS num, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey < 3 THEN c_custkey + 1000000 ELSE c_custkey // 2 END AS parent FROM customer),
r AS (SELECT num, num AS cur, 0 AS depth FROM c UNION ALL SELECT r.num, c.parent, depth + 1 FROM r JOIN c ON c.num = r.cur WHERE c.parent IS NOT NULL AND depth < 64),
e AS (SELECT num, max_by(cur, depth) AS root FROM r GROUP BY num)
SELECT num FROM e JOIN c USING (num) WHERE c.parent IS NOT NULL AND root NOT IN (SELECT num FROM c WHERE parent IS NULL)""",
)
def _(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k.alias("num"), F.when(k % 7 == 0, None).when(k < 3, k + 1000000).otherwise(F.floor(k / 2)).cast("long").alias("parent"))
    return claims.orphans(c)


# ---- streams ---------------------------------------------------------------------------------------------------------


@query("delta_assembly", "SELECT conv_id AS requestId, count(*)::BIGINT AS n, md5(string_agg(coalesce(text, ''), '' ORDER BY turn, text)) AS h FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("requestId"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    return deltas.assembled(c).select("requestId", "n", F.md5("text").alias("h"))


@query("delta_lines", "SELECT conv_id AS requestId, len(list_filter(string_split(string_agg(coalesce(text, ''), '' ORDER BY turn, text), chr(10)), lambda x: x <> ''))::BIGINT AS n_lines FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("requestId"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    return deltas.assembled(c).select("requestId", F.size(deltas.lines(F.col("text"))).cast("long").alias("n_lines"))


@query("streamed_counts", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def _(spark, d):
    schema = read(spark, d, "events").schema.simpleString()[7:-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read(spark, d, "events").schema.fields)
    assert schema
    made = deltas.run_available(
        spark, f"{d}/events.parquet*", fields, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), deltas.work_folder(spark), "complete"
    )
    return made


_LINES = "list_filter(string_split(string_agg(coalesce(text, ''), '' ORDER BY turn, text), chr(10)), lambda x: x <> '')"


@query("streamed_lines", f"SELECT conv_id::VARCHAR AS \"requestId\", len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS h FROM (SELECT conv_id, {_LINES} AS l FROM conversations GROUP BY conv_id)")
def _(spark, d):
    """Lines of conversations whose turns come in any order, over several micro-batches, some of them twice."""
    c = read(spark, d, "conversations").filter("conv_id is not null")
    by = Window.partitionBy("conv_id").orderBy("turn", "text")
    last = F.count("*").over(Window.partitionBy("conv_id"))
    seq = F.row_number().over(by) - 1
    deltas_ = c.select(F.col("conv_id").cast("string").alias("requestId"), seq.alias("seq"), F.coalesce("text", F.lit("")).alias("delta"), (seq == last - 1).alias("done"))
    deltas_ = deltas_.withColumns({"error": F.lit(None).cast("string"), "cancelled": F.lit(False)})
    place = F.pmod(F.xxhash64("requestId", "seq"), F.lit(6))
    # a part of the deltas that are not the last comes again in the next file
    twice = deltas_.withColumn("place", place).unionByName(deltas_.filter((place % 3 == 0) & ~F.col("done") & (place < 5)).withColumn("place", place + 1))
    folder = deltas.work_folder(spark)
    twice.repartitionByRange(6, "place").drop("place").write.parquet(f"{folder}/in")
    events = deltas.run_available(spark, f"{folder}/in", ordered.DELTAS, ordered.ordered_lines, f"{folder}/out", timers=True)
    lines = events.filter("kind = 'line'").groupBy("requestId").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    ended = events.filter("kind = 'done'").select("requestId").join(lines, "requestId", "left")
    text = F.array_join(F.transform(F.coalesce("l", F.array().cast("array<struct<n:int,text:string>>")), lambda x: x["text"]), "|")
    return ended.select("requestId", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n"), F.md5(text).alias("h"))


# ---- workspace -------------------------------------------------------------------------------------------------------


@query(
    "dependents_by_root",
    """WITH RECURSIVE c AS (SELECT s_suppkey AS num, CASE WHEN s_suppkey % 9 = 1 THEN NULL ELSE s_suppkey - 1 END AS parent FROM supplier),
r AS (SELECT num, num AS cur, 0 AS depth FROM c UNION ALL SELECT r.num, c.parent, depth + 1 FROM r JOIN c ON c.num = r.cur WHERE c.parent IS NOT NULL),
e AS (SELECT num, max_by(cur, depth) AS root FROM r GROUP BY num)
SELECT root, string_agg(num::VARCHAR, ',' ORDER BY num) AS dependents FROM e JOIN c USING (num) WHERE parent IS NOT NULL GROUP BY root""",
)
def _(spark, d):
    k = F.col("s_suppkey")
    c = read(spark, d, "supplier").select(k.alias("num"), F.when(k % 9 != 1, k - 1).alias("parent"))
    return workspace.dependents_by_root(c).select("root", F.array_join("dependents", ",").alias("dependents"))


@query(
    "claim_counts",
    "SELECT count(*) FILTER (p_size IS NULL OR p_size % 3 = 0) AS independent, count(*) FILTER (p_size % 3 <> 0) AS dependent, (SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part)) AS domains FROM part",
)
def _(spark, d):
    p = read(spark, d, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("parent"), F.col("p_brand").alias("technicalDomain"))
    return workspace.claim_counts(p).withColumn("domains", F.array_join("domains", "|"))


@query(
    "usage_by_type",
    """SELECT event_id, sum(event_id % 100) OVER w::BIGINT AS total_in, sum(event_id % 10) OVER w::BIGINT AS total_out,
round(sum(event_id % 100) OVER w * 0.000003e0 + sum(event_id % 10) OVER w * 0.000015e0, 6) AS dollars FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"))
    return workspace.usage(e, ["event_type"], ["event_id"]).select("event_id", "total_in", "total_out", "dollars")


@query("query_elements", f"WITH {_parts_sql('benchmark', 'item_id')} SELECT item_id, text || ' ' || array_to_string(l, ' ') AS q FROM e JOIN benchmark USING (item_id)")
def _(spark, d):
    return _query_elements(read(spark, d, "benchmark"))


def _query_elements(b: DataFrame) -> DataFrame:
    parts = F.transform(claims.elements(F.col("text")), lambda e: e["text"])
    return b.select("item_id", candidates.query_text(F.col("text"), parts).alias("q"))


@query("stored_records", "SELECT o_orderkey AS oOrderkey, o_orderkey % 2 = 1 AS oFlag, 'x' || (o_orderkey % 3)::VARCHAR AS oTag FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select("o_orderkey", (k % 2).alias("o_flag"), F.to_json(F.struct(F.concat(F.lit("x"), k % 3).alias("t"))).alias("o_tag"))
    return workspace.camel(rows, ("o_flag",), {"o_tag": "t string"}).withColumn("oTag", F.col("oTag.t"))


# ---- smaller operations over whole tables ----------------------------------------------------------------------------


@query("score_colours", "SELECT o_orderkey, CASE WHEN o_orderkey % 101 >= 70 THEN 'red' WHEN o_orderkey % 101 >= 40 THEN 'yellow' ELSE 'green' END AS colour FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.score_colour(F.col("o_orderkey") % 101).alias("colour"))


@query(
    "cost_texts",
    """SELECT event_id, dollars, CASE WHEN dollars < 0.001 THEN '< $0.001' ELSE '$' || printf('%.3f', dollars) END AS shown FROM (
SELECT event_id, round((event_id % 1000 * 1000) / 1e6 * 3 + (event_id % 77 * 1000) / 1e6 * 15, 4) AS dollars FROM events)""",
)
def _(spark, d):
    dollars = S.cost(F.col("event_id") % 1000 * 1000, F.col("event_id") % 77 * 1000)
    return read(spark, d, "events").select("event_id", dollars.alias("dollars")).withColumn("shown", S.cost_text(F.col("dollars")))


@query(
    "retries",
    """SELECT o_orderkey, least(1000 * 2 ** (o_orderkey % 9), 30000)::BIGINT AS delay_ms,
o_orderkey % 600 = 429 OR o_orderkey % 600 >= 500 OR regexp_matches('code ' || (o_orderkey % 1000), 'rate limit|timeout|econnreset|503|529|overloaded') AS again FROM orders""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    message = F.concat(F.lit("Code "), (k % 1000).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", S.retry_delay(k % 9 + 1).alias("delay_ms"), S.retryable(k % 600, message).alias("again"))


@query(
    "weighted_scores",
    """SELECT l_orderkey, floor(sum(l_partkey % 101 * w) / sum(w) + 0.5)::INT AS score FROM (
SELECT l_orderkey, l_partkey, (CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END)::DOUBLE AS w FROM lineitem) GROUP BY l_orderkey""",
)
def _(spark, d):
    one = F.struct(F.col("l_linenumber").cast("string").alias("id"), (F.col("l_partkey") % 101).cast("int").alias("score"))
    weights = F.create_map(F.lit("1"), F.lit(3.0), F.lit("2"), F.lit(2.0))
    scores = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("s"))
    return scores.select("l_orderkey", S.weighted_score(F.col("s"), weights).alias("score"))


@query(
    "element_lines",
    """SELECT l_orderkey, string_agg('[' || chr(64 + l_linenumber::INT) || '] ' || repeat('*', (l_partkey % 3 + 1)::INT) || ' ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey % 3, l_partkey::VARCHAR) AS lines
FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    one = F.struct(n.alias("n"), F.char(n + 64).alias("id"), (k % 3).cast("int").alias("importance"), k.cast("string").alias("text"))
    elements = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("e"))
    return elements.select("l_orderkey", workspace.element_lines(F.col("e")).alias("lines"))


@query("target_claims", "SELECT l_orderkey, l_linenumber AS num FROM lineitem WHERE l_linenumber IN (1, 3)")
def _(spark, d):
    return workspace.target_claims(read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("num")), [1, 3])


@query(
    "enriched_claims",
    "SELECT o_orderkey AS num, part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS part FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey",
)
def _(spark, d):
    enriched = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("num"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"))
    return workspace.with_enriched(read(spark, d, "orders").select(F.col("o_orderkey").alias("num")), enriched)


@query(
    "claim_summary",
    """WITH r AS (SELECT l_orderkey AS node, l_partkey AS top, l_quantity AS weighted_score FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS top, CASE l_partkey % 3 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS novelty_risk, CASE l_partkey % 2 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS inventiveness_risk FROM lineitem)
SELECT o_orderkey AS node, top, weighted_score, novelty_risk, inventiveness_risk FROM orders LEFT JOIN r ON r.node = o_orderkey LEFT JOIN c USING (node, top)""",
)
def _(spark, d):
    li = read(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "node", "l_partkey": "patent_number"})
    risk = lambda m: F.when(F.col("patent_number") % m == 0, "HIGH").otherwise("LOW")
    charts = li.select("node", "patent_number", risk(3).alias("novelty_risk"), risk(2).alias("inventiveness_risk"))
    reranked = li.select("node", "patent_number", F.col("l_quantity").alias("weighted_score"), F.col("l_linenumber").alias("stage2_rank"))
    return workspace.claim_summary(read(spark, d, "orders").select(F.col("o_orderkey").alias("node")), reranked, charts)


@query("active_items", "SELECT count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS active FROM orders")
def _(spark, d):
    return workspace.active_items(read(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).alias("active")))


@query(
    "templates_merged",
    """WITH a AS (SELECT r_regionkey AS id, r_name AS name, 0 AS s FROM region WHERE r_regionkey NOT IN (SELECT n_nationkey + 3 FROM nation) UNION ALL SELECT n_nationkey + 3, n_name, 1 FROM nation)
SELECT id, name, row_number() OVER (ORDER BY s, id)::INT AS ord FROM a""",
)
def _(spark, d):
    stored = read(spark, d, "nation").select((F.col("n_nationkey") + 3).alias("id"), F.col("n_name").alias("name"))
    return workspace.with_builtins_first(stored, read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("prompt_variables", "SELECT doc_id, md5(coalesce(text, '')) AS claims, md5(coalesce(text, '')) AS claim_text, coalesce(lang, '') AS prior_art, coalesce(source, '') AS query FROM documents")
def _(spark, d):
    df = read(spark, d, "documents").select("doc_id", F.col("text").alias("claims"), F.col("lang").alias("prior_art"), F.col("source").alias("query"))
    v = providers.prompt_variables(df)
    return v.select("doc_id", F.md5("v_claims").alias("claims"), F.md5("v_claim_text").alias("claim_text"), F.col("v_prior_art").alias("prior_art"), F.col("v_query").alias("query"))


@query("prompt_context", "SELECT string_agg(n_name || ': ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation WHERE n_nationkey < 3")
def _(spark, d):
    hits = read(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("rank"), F.col("n_name").alias("patentNumber"), F.col("n_regionkey").cast("string").alias("title"))
    return workspace.prompt_context(hits)


@query(
    "uri_components",
    """SELECT doc_id, md5(replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')) AS h FROM documents""",
)
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.uri_component(F.col("text"))).alias("h"))
