"""Truths and indications of dialogs, summaries of facts, matched paths and overviews, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.operators import context as X
from klarspan.operators import decisions as D
from klarspan.operators import packages as P
from klarspan.operators import relations as R

KINDS = ("answer", "confirm", "capture", "supersede", "dismiss", "answer", "capture")


def _steps(spark, d):
    """The turns of conversations as steps: their kinds by turn, their keys by conversation."""
    c = A.table(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    ord_ = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(ord_.cast("long").alias("ord"), F.col("conv_id").alias("thread_id"), A.pick(KINDS, F.col("conv_id") + F.col("turn")).alias("kind"), F.concat(F.lit("k"), (F.col("conv_id") % 40).cast("string")).alias("canonical_key"), (ord_ % 7).cast("string").alias("value"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 2, F.lit(" ")).otherwise(F.concat_ws(" ", F.lit("said"), ord_.cast("string"))).alias("content"))


def dialog_truths(spark, d):
    """What the confirmations in conversations make of the nations' truths."""
    n = A.table(spark, d, "nation")
    truths = n.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("canonical_key"), F.col("n_name").alias("normalized_value"), F.when(F.col("n_regionkey") % 2 == 0, "active").otherwise("superseded").alias("truth_status"))
    return D.dialog_truths(truths, _steps(spark, d))


def captured_indications(spark, d):
    return D.captured_indications(_steps(spark, d))


def registry_summary(spark, d):
    """Facts of orders over the months as runs: how many there are, recur, were opened again, and the newest."""
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    month = F.date_format("o_orderdate", "yyyy-MM")
    e = o.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fact_key"), F.concat(month, F.lit("/"), F.lpad(k.cast("string"), 12, "0")).alias("run"), A.pick(("open", "confirmed", "resolved"), k).alias("status"), A.pick(("new", "continued", "reopened", "continued"), k).alias("mode"))
    return P.registry_summary(e)


def path_matches(spark, d):
    """Documented and implemented paths of each size of parts, best first."""
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    step = lambda m, by: F.concat(F.lit(by), (k % m).cast("string"))
    path = F.array(step(2, "a"), step(3, "b"), step(5, "c"))
    return R.matched_paths(p.where("p_partkey % 400 < 150").select(F.concat(F.lit("t"), (F.floor(k / 400) * 50 + F.col("p_size")).cast("string")).alias("subject_key"), F.when(k % 7 < 3, "documented").otherwise("implemented").alias("side"), path.alias("path")))


def repository_overview(spark, d):
    """Folders, services, routes and settings of files made from parts."""
    p, k = A.table(spark, d, "part"), F.col("p_partkey").cast("string")
    s = (F.col("p_partkey") % 31).cast("string")
    text = F.concat(F.lit("class Svc"), s, F.lit(":\n    @app.get('/item/"), s, F.lit("')\n    def show(self):\n        return SHOP_KEY_"), s, F.lit("\n    def _hidden(self):\n        pass\n    def keep(self):\n        pass\n"))
    return X.repository_overview(p.select(F.concat(F.lit("src/m"), s, F.lit("/f"), k, F.lit(".py")).alias("source_id"), text.alias("text")))


def wiki_map(spark, d):
    """The documents' sources as spaces, with their first documents."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("space"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## On "), F.col("lang"), F.lit("\n"))).otherwise(""), F.lit("body\n")).alias("text"))
    return X.wiki_map(docs.where("page_id IS NOT NULL"))


QUERIES = {f.__name__: f for f in (dialog_truths, captured_indications, registry_summary, path_matches, repository_overview, wiki_map)}
_STEPS = f"""e AS (SELECT DISTINCT CAST(conv_id * 1000 + turn AS BIGINT) AS ord, conv_id AS thread_id, {A._pick_sql(KINDS, '(conv_id + turn)')} AS kind, 'k' || (conv_id % 40) AS canonical_key, CAST((conv_id * 1000 + turn) % 7 AS VARCHAR) AS value, CASE WHEN (conv_id + turn) % 7 = 2 THEN ' ' ELSE 'said ' || (conv_id * 1000 + turn) END AS content FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""
ORACLES = {
    "dialog_truths": f"""WITH {_STEPS}, s AS (SELECT * FROM e WHERE kind IN ('confirm', 'supersede')),
h AS (SELECT s.*, n_nationkey IS NOT NULL OR coalesce(min(CASE WHEN kind = 'confirm' THEN ord END) OVER (PARTITION BY canonical_key) < ord, false) AS held FROM s LEFT JOIN nation ON canonical_key = 'k' || n_nationkey AND n_regionkey % 2 = 0),
o AS (SELECT *, CASE WHEN kind = 'confirm' THEN CASE WHEN held THEN 'conflict' ELSE 'created' END WHEN held THEN 'superseded' ELSE 'rejected' END AS outcome FROM h)
SELECT ord, thread_id, canonical_key, kind, value, outcome, CASE WHEN outcome IN ('created', 'superseded') THEN CASE WHEN ord = max(CASE WHEN outcome IN ('created', 'superseded') THEN ord END) OVER (PARTITION BY canonical_key) THEN 'active' ELSE 'superseded' END END AS truth_status FROM o""",
    "captured_indications": f"""WITH {_STEPS}, v AS (SELECT c.thread_id, c.ord, coalesce(nullif(trim(c.content), ''), (SELECT arg_max(trim(a.content), a.ord) FROM e a WHERE a.thread_id = c.thread_id AND a.ord < c.ord AND a.kind = 'answer')) AS value FROM e c WHERE c.kind = 'capture')
SELECT 'clarification:' || thread_id AS source_id, ord, 'user_indication' AS predicate, value, CAST(0.8 AS DOUBLE) AS confidence, 'clarification:' || thread_id || ':' || left(value, 50) AS fingerprint FROM v WHERE value IS NOT NULL""",
    "registry_summary": f"""WITH e AS (SELECT 'f' || o_custkey AS fact_key, strftime(o_orderdate, '%Y-%m') || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run, {A._pick_sql(("open", "confirmed", "resolved"), 'o_orderkey')} AS status, {A._pick_sql(("new", "continued", "reopened", "continued"), 'o_orderkey')} AS mode FROM orders),
f AS (SELECT fact_key, arg_max(status, run) AS status, arg_max(mode, run) AS mode, count(DISTINCT run) AS runs, max(run) AS last_run FROM e GROUP BY 1)
SELECT 'total' AS section, 'entries' AS key, count(*) AS n FROM e UNION ALL SELECT 'total', 'facts', count(*) FROM f UNION ALL SELECT 'total', 'recurring', count(*) FROM f WHERE runs > 1 UNION ALL SELECT 'total', 'reopened', count(*) FROM f WHERE mode = 'reopened'
UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'latest', fact_key, runs FROM f ORDER BY last_run DESC, fact_key LIMIT 12)""",
    "path_matches": """WITH RECURSIVE p AS (SELECT p_partkey AS k, 't' || CAST(p_partkey // 400 * 50 + p_size AS BIGINT) AS subject_key, p_partkey % 7 < 3 AS doc, ['a' || (p_partkey % 2), 'b' || (p_partkey % 3), 'c' || (p_partkey % 5)] AS path FROM part WHERE p_partkey % 400 < 150),
pairs AS (SELECT a.subject_key, a.k AS l, b.k AS r, array_to_string(a.path, '>') AS documented, array_to_string(b.path, '>') AS implemented,
  CAST(len(list_filter(range(1, 4), lambda i: a.path[1:i] = b.path[1:i])) + len(list_filter(range(1, 4), lambda i: a.path[i:3] = b.path[i:3])) AS BIGINT) AS shared, 6 - 2 * len(list_intersect(a.path, b.path)) AS apart FROM p a JOIN p b ON a.subject_key = b.subject_key AND a.doc AND NOT b.doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY shared DESC, apart, documented, implemented, l, r) AS rank FROM pairs),
m AS (SELECT subject_key, rank, [l] AS ls, [r] AS rs FROM ranked WHERE rank = 1
  UNION ALL SELECT m.subject_key, q.rank, list_append(m.ls, q.l), list_append(m.rs, q.r) FROM m JOIN ranked q ON q.subject_key = m.subject_key AND q.rank > m.rank AND NOT list_contains(m.ls, q.l) AND NOT list_contains(m.rs, q.r)
  QUALIFY q.rank = min(q.rank) OVER (PARTITION BY m.subject_key, m.rank))
SELECT subject_key, documented, implemented, shared FROM m JOIN ranked USING (subject_key, rank)""",
    "repository_overview": """WITH p AS (SELECT p_partkey AS k, p_partkey % 31 AS s FROM part),
r AS (SELECT 'folder' AS section, 'src/m' || s || '/ (' || count(*) || ' files)' AS line, 'src/m' || s AS name FROM p GROUP BY s UNION ALL SELECT 'service', 'Svc' || s || ' (src/m' || s || '/f' || k || '.py): show, keep' AS x, x FROM p
  UNION ALL SELECT DISTINCT 'route', 'GET /item/' || s AS x, x FROM p UNION ALL SELECT DISTINCT 'setting', 'SHOP_KEY_' || s AS x, x FROM p),
n AS (SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY name, line) AS INT) AS place, line FROM r)
SELECT * FROM n WHERE place <= CASE section WHEN 'folder' THEN 20 WHEN 'service' THEN 15 WHEN 'route' THEN 20 ELSE 10 END""",
    "wiki_map": """WITH d AS (SELECT *, coalesce(nullif(source, ''), 'default') AS space FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT space, count(*) OVER (PARTITION BY space) AS n_pages, CAST(row_number() OVER (PARTITION BY space ORDER BY doc_id) AS INT) AS place, 'Page ' || doc_id || CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN ': On ' || lang ELSE '' END AS line FROM d)
SELECT * FROM n WHERE place <= 25""",
}
