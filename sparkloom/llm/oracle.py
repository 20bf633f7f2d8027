"""DuckDB SQL of the queries that SQL can express in bearable time on small tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)::VARCHAR || '#'] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS comp FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.comp) AS component_id, d.doc_id = min(r.comp) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS x FROM (SELECT *, least(13, len(w)) AS m FROM b) WHERE m > 0),
t AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k, w FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT doc_id, k, t.m, item_id FROM t JOIN p ON p.m = t.m AND p.x = array_to_string(t.w[t.k:t.k + t.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 4) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g AS phrase, string_split(g, ' ') AS w, c AS a FROM f WHERE k > 1 AND c >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang, cuts.k, phrase, a, cut, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.g = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.g = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:], ' ')]) AS inside FROM c WHERE k > 2),
left_over AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.inside = b.phrase AND 100 * e.a >= 50 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


def _rounds(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assigning and averaging, one after another; vectors are told apart by ``u``, components are rows."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT"
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM v QUALIFY k < %d)""" % k
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT u, min(struct_pack(d := d, k := k)) AS x FROM (SELECT u, k, {far} AS d FROM v, c{r} c) GROUP BY u)")
        if r < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(
                f"s{r} AS (SELECT x.k AS k, i, sum(v.v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN v USING (u), range(1, 65) t(i) GROUP BY ALL)"
            )
            steps.append(f"m{r} AS (SELECT k, list({mean} ORDER BY i)::BIGINT[] AS m FROM s{r} GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k)")
    return "WITH " + ",\n".join(steps) + (
        f"""
SELECT vec_id, x.k::INT AS cluster, x.d AS distance, (sum(x.d) OVER (PARTITION BY x.k))::BIGINT AS cluster_inertia, (sum(x.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (u) JOIN c{rounds} c ON c.k = x.k"""
    )


def _urls() -> str:
    from . import url_rules as u

    fits = lambda host, path: f"((host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}'))"
    order = sorted((u.site_rule(v, t) for v, t in u.SITES), key=lambda r: r.rank)
    parts = [(r, r.text.partition("/")) for r in order]
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, s + p)} THEN '{what(r)}'" for r, (h, s, p) in parts)
    rules = [u.pattern_rule(t) for t in u.PATTERNS]
    expression = lambda r: r.expression.replace("\\Z", "\\z").replace("'", "''")
    searched = lambda r: f"regexp_matches(low, '{expression(r)}', 's')"
    named = lambda verdict: "CASE " + " ".join(f"WHEN {searched(r)} THEN '{r.text}'" for r in rules if r.verdict == verdict) + " END"
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
r AS (SELECT *, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM u),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM r),
s AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h),
d AS (SELECT *, {case(lambda r: r.text)} END AS rule, {named("block")} AS blocks, {named("allow")} AS allows FROM s)
SELECT page_id, host, path, rule, {case(lambda r: r.verdict)} WHEN blocks IS NOT NULL AND allows IS NULL THEN 'block' ELSE 'allow' END AS verdict,
CASE WHEN rule IS NULL AND blocks IS NOT NULL THEN coalesce(allows, blocks) END AS pattern FROM d"""


ORACLE = {
    "op5_minmax_near_dedup": NEAR_DEDUP,
    "op7_wu_manber_decontaminate": DECONTAMINATE,
    "op9_ball_tree_top_k": TOP_K,
    "op11_collocations": COLLOCATIONS,
    "op12_centroid_clusters": _rounds(),
    "op13_url_rules": _urls(),
}
