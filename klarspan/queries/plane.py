"""Ranking, packages, facts, review, pages and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import scoring, semantics, text
from klarspan.operators.graph import kept
from klarspan.operators import packages as P
from klarspan.operators import pages as G
from klarspan.operators import review as V
from klarspan.operators import sections as E
from klarspan.queries import sql as S
from klarspan.queries.relations import FINDINGS_SQL, _findings, _first_distinct

_CONFLICT = f"CASE WHEN category IN ('contradiction', 'policy_conflict') THEN 0 WHEN category IN ({', '.join(map(S.quoted, scoring.SUPPORTING))}) THEN 2 ELSE 1 END"
_ORDER = f"priority, {_CONFLICT}, {S.lookup('severity', scoring.SEVERITY, 9)}, CAST(category IN ({', '.join(map(S.quoted, scoring.SUPPORTING))}) AS INT), CASE WHEN delta THEN 0 ELSE 1 END, object_key, title, finding_ord"
_RANK = S.lookup("severity", scoring.SEVERITY, 9)
_PENALTY = f"CAST(category IN ({', '.join(map(S.quoted, scoring.SUPPORTING))}) AS INT)"
_CORE = "bucket IN (" + ", ".join(map(S.quoted, scoring.CORE)) + ")"


def finding_order(spark, d):
    return P.ranked(_findings(spark, d)).select("finding_ord", "place")


def findings_for_retrieval(spark, d):
    return P.for_retrieval(_findings(spark, d))


def _clustered(spark, d):
    return _findings(spark, d).withColumn("cluster", semantics.scope_key(F.col("object_key")))


def decision_packages(spark, d):
    return P.packages(_clustered(spark, d))


def dominant_category(spark, d):
    return P.dominant_category(_clustered(spark, d))


def _problems(spark, d):
    f = _clustered(spark, d)
    return f.select(F.concat_ws(":", "object_key", "category").alias("fact_key"), F.col("finding_ord").alias("ord"), "title", F.concat_ws("/", "cluster", "bucket").alias("package"), "source_id").withColumnRenamed("title", "summary")


def atomic_facts(spark, d):
    return P.atomic_facts(_problems(spark, d))


def _entries(spark, d):
    f = _findings(spark, d)
    return f.select(F.concat_ws(":", "object_key", "category").alias("fact_key"), (F.col("finding_ord") % 5).cast("int").alias("run"), A.pick(("open", "resolved", "confirmed", "superseded"), F.col("finding_ord") / 25).alias("status"), A.pick(("new", "continued", "reopened"), F.col("finding_ord") / 25).alias("mode"), (1 + F.col("finding_ord") % 3).cast("int").alias("occurrences"), "finding_ord")


def fact_history(spark, d):
    e = _entries(spark, d)
    before = P.latest(e.withColumn("run", (F.col("finding_ord") / 25 % 4).cast("int")), ["fact_key", "run"], [F.desc("finding_ord")])
    return P.fact_history(e.select("fact_key").distinct(), before.where("run < 3"))


def fact_registry(spark, d):
    e = P.latest(_entries(spark, d).withColumn("run", (F.col("finding_ord") / 25 % 4).cast("int")), ["fact_key", "run"], [F.desc("finding_ord")])
    return P.fact_registry(e)


def action_lanes(spark, d):
    c = A.claims(spark, d).groupBy("subject_key").agg(*(F.bool_or(F.col("source_type").isin(*k)).alias(n) for n, k in (("doc", ("confluence_page", "local_doc")), ("code", ("github_file",)), ("model", ("metamodel",)))))
    return c.select("subject_key", P.action_lane(F.col("doc"), F.col("code"), F.col("model")).alias("lane"))


def cache_retention(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("source_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY") * (F.col("event_id") % 60)).alias("cached_at"))
    return P.retained(e, 3).select("row_id", "source_id", "place")


def latest_event(spark, d):
    return P.latest(A.table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def source_set_hash(spark, d):
    c = A.claims(spark, d).select("source_type", F.col("claim_id").alias("source_id"), F.col("fingerprint").alias("content_hash"))
    return P.source_set_hash(c)


def schema_registry(spark, d):
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    t = p.select(F.concat(A.pick(("Node:", "Relationship:", "History:"), k), F.upper(F.substring("p_brand", 1, 8)), (k % 20).cast("string")).alias("schema_key"), A.pick(("unconfirmed", "observed_only", "confirmed", "unconfirmed"), F.col("p_size")).alias("status"), (k % 300).alias("claim"))
    return P.schema_registry(t)


GOLD = (("g1", "expected", "contradiction", "NATION_1_0.write_path"), ("g2", "expected", "policy_conflict", "NATION_7_1.policy"), ("g3", "forbidden", "contradiction", "NATION_99_0.policy"), ("g4", "expected", "contradiction", "none"))


def gold_gate(spark, d):
    f = _findings(spark, d).select("category", F.col("object_key").alias("subject_key"))
    return P.gate(spark.createDataFrame(list(GOLD), "case_id string, polarity string, category string, subject_key string"), f)


def answer_indications(spark, d):
    return P.indications(A.table(spark, d, "conversations"))


def operational_counts(spark, d):
    e = A.table(spark, d, "events")
    return e.agg(F.count("*").alias("spans"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("slow"), F.count_distinct("user_id").alias("workers"), F.max("event_id").alias("last"))


def severity_histogram(spark, d):
    return _findings(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))


def _docs(spark, d):
    """Documents of all kinds: each line a paragraph; every third has a heading, the code a function."""
    k = F.col("doc_id")
    t = A.table(spark, d, "documents").select("doc_id", A.pick(A.SOURCES, k).alias("source_type"), A.pick(A.TITLES, k).alias("title"), A.pick(("added", "changed", "unchanged"), k).alias("delta_status"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    lead = F.when(k % 3 == 0, F.concat(F.lit("## 1. Intro "), "title", F.lit("\n"))).when(F.col("source_type") == "github_file", "def read_it(x):\n").otherwise("")
    return t.withColumn("text", F.concat(lead, "text"))


def review_sections(spark, d):
    s = V.prioritised(V.sections(_docs(spark, d)))
    return s.select("section_id", "doc_id", "priority", F.size("tokens").alias("n_tokens"))


def review_candidates(spark, d):
    return V.candidates(kept(V.prioritised(V.sections(_docs(spark, d)))))


def review_cards(spark, d):
    s = kept(V.prioritised(V.sections(_docs(spark, d))))
    return V.cards(s, V.candidates(s))


TITLE_STARTS = ("", "API guide ", "Overview ", "", "Deployment ", "Process ", "")


def _pages(spark, d):
    k = F.col("doc_id")
    return A.table(spark, d, "documents").select(k.alias("node"), F.when(k > 0, (k / 5).cast("long")).alias("parent"), F.concat(A.pick(TITLE_STARTS, k), F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)).alias("title"))


def page_issues(spark, d):
    return G.page_issues(_pages(spark, d))


def page_key_figures(spark, d):
    return G.key_figures(page_issues(spark, d))


def page_scores(spark, d):
    """Figures of the whole wiki: classes, issues, orphans, coverage and scores, with the nations as findings."""
    pages = _pages(spark, d)
    return G.scores(pages, G.page_issues(pages), A.table(spark, d, "nation"))


def page_suggestions(spark, d):
    return G.suggestions(_pages(spark, d), page_issues(spark, d))


def text_functions(spark, d):
    """Slugs, hashes, keywords and overlaps of parts' names."""
    p = A.table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    words = text.keywords(name, 4)
    return p.select("p_partkey", text.slugify(name).alias("slug"), text.truncate(name, 18).alias("short"), text.content_hash(name).alias("hash"), text.section_id(F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("section"), F.array_join(words, "|").alias("words"), F.round(text.keyword_overlap(words, text.keywords(F.concat_ws(" ", "p_type", "p_brand"), 4)), 6).alias("overlap"))


def path_divergence(spark, d):
    """Documented against implemented paths: what they share at both ends and where they part."""
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    step = lambda i, m: F.concat(F.lit("s"), ((k + i) % m).cast("string"))
    a = F.array(F.lit("start"), step(0, 3), step(1, 4), F.lit("end"))
    b = F.when(k % 5 == 0, a).when(k % 5 == 1, F.array(F.lit("begin"), step(0, 3), F.lit("end"))).otherwise(F.array(F.lit("start"), step(0, 4), step(1, 5), step(1, 4), F.lit("end")))
    x = p.select("p_partkey", text.path_divergence(a, b).alias("x"))
    return x.select("p_partkey", "x.prefix", "x.suffix", F.array_join("x.documented_gap", ">").alias("documented_gap"), F.array_join("x.implemented_gap", ">").alias("implemented_gap"), "x.mode")


def section_overlap(spark, d):
    """Subjects whose section path overlaps changed sections."""
    c = A.claims(spark, d).select("record_ord", "section_path")
    target = F.array(F.lit("flow"))
    return c.select("record_ord", text.sections_overlap(target, text.section_tokens(F.col("section_path"))).alias("affected"))


def vector_cosine(spark, d):
    e = A.table(spark, d, "embeddings")
    first = e.where("vec_id = 1").select(F.col("embedding").alias("one"))
    return e.join(F.broadcast(first), how="cross").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("one")), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (finding_order, findings_for_retrieval, decision_packages, dominant_category, atomic_facts, fact_history, fact_registry, action_lanes, cache_retention, latest_event, source_set_hash, schema_registry, gold_gate, answer_indications, operational_counts, severity_histogram, review_sections, review_candidates, review_cards, page_issues, page_key_figures, page_scores, page_suggestions, text_functions, path_divergence, section_overlap, vector_cosine)}
_SCOPE = S.scope("object_key")
_ENTRIES = FINDINGS_SQL + f""", e AS (SELECT object_key || ':' || category AS fact_key, CAST(finding_ord // 25 % 4 AS INT) AS run, {A._pick_sql(("open", "resolved", "confirmed", "superseded"), "finding_ord // 25")} AS status, {A._pick_sql(("new", "continued", "reopened"), "finding_ord // 25")} AS mode, 1 + finding_ord % 3 AS occurrences, finding_ord FROM findings),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY fact_key, run ORDER BY finding_ord DESC) = 1)"""
_FIRST = [FINDINGS_SQL + f", base AS (SELECT finding_ord, bucket FROM ranked ORDER BY {_ORDER} LIMIT 12), more AS (SELECT finding_ord FROM ranked WHERE finding_ord NOT IN (SELECT finding_ord FROM base) AND (truth OR ({_CORE} AND ({_RANK} <= 1 OR bucket NOT IN (SELECT bucket FROM base WHERE {_CORE})))) ORDER BY CASE WHEN truth THEN 0 ELSE 1 END, priority, {_RANK}, CASE WHEN delta THEN 0 ELSE 1 END, -confidence, object_key, title, finding_ord LIMIT 12) SELECT finding_ord, true AS base FROM base UNION ALL SELECT finding_ord, false FROM more"]
_CODE, _HEADING = E.CODE_BLOCK.replace("^", "", 1), r"#{1,6}[ \t]+[^\n]+"
_CLEAN = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PARTS = rf"""WITH doc0 AS (SELECT doc_id, {A._pick_sql(A.SOURCES, "doc_id")} AS source_type, {A._pick_sql(A.TITLES, "doc_id")} AS title, {A._pick_sql(("added", "changed", "unchanged"), "doc_id")} AS delta_status, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents),
doc AS (SELECT * EXCLUDE (t), {_CLEAN.format("CASE WHEN doc_id % 3 = 0 THEN '## 1. Intro ' || title || chr(10) || t WHEN source_type = 'github_file' THEN 'def read_it(x):' || chr(10) || t ELSE t END")} AS t FROM doc0),
cut AS (SELECT *, CASE WHEN source_type = 'github_file' THEN string_split(regexp_replace(t, '(?m)^({_CODE[1:-1]})', chr(1) || '\1', 'g'), chr(1))[2:] ELSE [] END AS code, string_split(regexp_replace(t, '(?m)^({_HEADING})', chr(1) || '\1', 'g'), chr(1))[2:] AS heads FROM doc),
headed AS (SELECT *, list_filter([{{'h': {_CLEAN.format("ltrim(regexp_extract(x, '^[^\\n]+'), '#')")}, 'b': {_CLEAN.format("regexp_replace(x, '^[^\\n]+', '')")}}} FOR x IN heads], lambda s: s.b <> '') AS hs, list_filter([{_CLEAN.format("x")} FOR x IN regexp_split_to_array(t, '\n\s*\n')], lambda x: x <> '') AS ps FROM cut),
folded AS (SELECT *, list_reduce([{{'done': []::VARCHAR[], 'held': x, 'n': length(x)}} FOR x IN ps], lambda a, b: CASE WHEN a.n >= 900 THEN {{'done': list_append(a.done, a.held), 'held': b.held, 'n': b.n}} ELSE {{'done': a.done, 'held': a.held || chr(10) || chr(10) || b.held, 'n': a.n + b.n}} END, {{'done': []::VARCHAR[], 'held': '', 'n': 0::BIGINT}}) AS f FROM headed),
part0 AS (SELECT doc_id, source_type, title, delta_status, CASE WHEN len(code) > 0 THEN [{{'h': regexp_extract(x, '^({_CODE[1:-1]})'), 'b': x}} FOR x IN code] WHEN len(hs) > 0 THEN hs ELSE [{{'h': title, 'b': x}} FOR x IN list_append(f.done, f.held)] END AS parts FROM folded),
part AS (SELECT * EXCLUDE (parts), unnest(range(0, len(parts))) AS i, unnest(parts) AS p FROM part0)"""
_topics = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]{{4,}}'), lambda w: w NOT IN ({', '.join(map(S.quoted, text.STOPWORDS))})))"
_SECTIONS = _PARTS + f""", row AS (SELECT * EXCLUDE (p), p.h AS heading, trim(regexp_replace(p.b, '\\s+', ' ', 'g')) AS body FROM part),
sec AS (SELECT *, left(sha1(doc_id || '|' || i || '|' || heading), 16) AS section_id, {_topics("title || chr(10) || heading || chr(10) || body")} AS tokens, {_topics("heading")} AS hts,
  {S.lookup('source_type', V.SOURCE_POINTS, 1)} + {S.lookup('delta_status', V.DELTA_POINTS, 2)} + {" + ".join(f"CAST(contains(lower(heading || chr(10) || body), '{t}') AS INT)" for t in V.TERMS)} AS priority FROM row WHERE length(body) >= 60 ORDER BY priority DESC, section_id LIMIT 48)"""
_PAIRS = _SECTIONS + """, p AS (SELECT l.section_id AS ls, r.section_id AS rs, l.priority AS lp, len(list_intersect(l.tokens, r.tokens)) AS overlap, 2 * len(list_intersect(l.tokens, r.tokens)) + 3 * len(list_intersect(l.hts, r.hts)) + CASE WHEN l.delta_status <> 'unchanged' OR r.delta_status <> 'unchanged' THEN 2 ELSE 0 END AS score FROM sec l JOIN sec r ON l.section_id <> r.section_id AND l.doc_id <> r.doc_id AND list_has_any(l.tokens, r.tokens)),
b AS (SELECT *, row_number() OVER (PARTITION BY ls ORDER BY score DESC, rs) AS place FROM p WHERE score >= 3 QUALIFY place <= 2),
once AS (SELECT least(ls, rs) AS left_id, greatest(ls, rs) AS right_id, max(score) AS score, max(overlap) AS overlap, min((-lp, ls, place)) AS turn FROM b GROUP BY 1, 2
  UNION ALL SELECT section_id, NULL, priority, 0, (-priority, section_id, 1) FROM sec WHERE priority >= 8 AND section_id NOT IN (SELECT ls FROM b)),
pair AS (SELECT left_id, right_id, score, overlap FROM once ORDER BY turn LIMIT 14)"""
_TITLE = "(CASE WHEN a > 0 AND b > 0 THEN 'mixed' WHEN a > b THEN 'technical' WHEN b > a THEN 'subject' ELSE 'unclear' END)"
_PAGES = f"""WITH RECURSIVE page AS (SELECT doc_id AS node, CASE WHEN doc_id > 0 THEN doc_id // 5 END AS parent, {A._pick_sql(TITLE_STARTS, 'doc_id')} || string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents),
up(node, parent, level) AS (SELECT node, parent, 0 FROM page UNION ALL SELECT up.node, t.parent, level + 1 FROM up LEFT JOIN page t ON up.parent = t.node WHERE up.parent IS NOT NULL AND level <= 20),
deep AS (SELECT node, max(level) AS depth FROM up GROUP BY node),
kid AS (SELECT parent AS node, count(*) AS children FROM page GROUP BY 1),
c AS (SELECT page.*, depth, coalesce(children, 0) AS children, {" + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in G.TECHNICAL)} AS a, {" + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in G.SUBJECT)} AS b, count(*) OVER (PARTITION BY lower(trim(title))) AS same FROM page JOIN deep USING (node) LEFT JOIN kid USING (node)),
i AS (SELECT node, depth, children, {_TITLE} AS class, list_filter([CASE WHEN depth > 4 THEN 'deep' END, CASE WHEN length(title) > 80 THEN 'long' END, CASE WHEN length(title) < 4 THEN 'short' END, CASE WHEN regexp_matches(title, '__|---') THEN 'runs' END, CASE WHEN children > 12 THEN 'fat' END, CASE WHEN {_TITLE} = 'mixed' THEN 'mixed' END, CASE WHEN {_TITLE} = 'unclear' THEN 'unclear' END, CASE WHEN same > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) AS issues FROM c)"""
_KINDS = ("deep", "long", "short", "fat", "mixed", "unclear", "duplicate")
_PART_NAME = "p_name || ' ' || p_brand || ' ' || p_type"
_PW = "list_filter(regexp_extract_all(lower({}), '[a-z0-9_]{{3,}}'), lambda w: w NOT IN (" + ", ".join(map(S.quoted, text.STOPWORDS)) + "))"
ORACLES = {
    "finding_order": FINDINGS_SQL + f" SELECT finding_ord, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS place FROM ranked",
    "findings_for_retrieval": _FIRST[0],
    "decision_packages": FINDINGS_SQL + f""", f AS (SELECT *, {_SCOPE} AS cluster, {_RANK} AS sr, {_PENALTY} AS dp, {_CONFLICT} AS cp FROM ranked), lead AS (SELECT cluster, arg_min(bucket, priority) FILTER (WHERE {_CORE}) AS lb FROM f GROUP BY 1),
a AS (SELECT f.*, CASE WHEN lb IS NULL OR {_CORE} THEN bucket ELSE lb END AS assigned FROM f JOIN lead USING (cluster)),
g AS (SELECT cluster, assigned, min(sr) AS severity_rank, count(*) AS n_findings, arg_min(finding_ord, (bucket <> assigned, NOT truth, cp, dp, sr, title, finding_ord)) AS primary_ord, bool_or(delta) AS rerender_required, count(DISTINCT source_id) AS n_sources FROM a GROUP BY ALL)
SELECT *, 10 * {S.lookup('assigned', scoring.ROOT_CAUSE, 99)} + severity_rank AS sort_key FROM g""",
    "dominant_category": FINDINGS_SQL + f", e AS (SELECT {_SCOPE} AS cluster, category, count(*) AS n, min({_RANK}) AS r FROM findings GROUP BY ALL) SELECT cluster, category FROM e QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY r, n DESC, category) = 1",
    "atomic_facts": FINDINGS_SQL + f""", p AS (SELECT object_key || ':' || category AS fact_key, finding_ord AS o, title, {_SCOPE} || '/' || bucket AS package, source_id FROM findings), g AS (SELECT fact_key, arg_min(title, o) AS summary, arg_min(package, o) AS primary_package, list(package ORDER BY o) AS ps, list(source_id ORDER BY o) AS ss, count(*) AS n_problems FROM p GROUP BY 1)
SELECT fact_key, summary, primary_package, array_to_string({_first_distinct('ps', 100000)}, '|') AS packages, array_to_string({_first_distinct('ss', 100000)}, '|') AS sources, n_problems FROM g""",
    "fact_history": _ENTRIES + """, b AS (SELECT fact_key, arg_max(status, run) AS st, arg_max(occurrences, run) AS oc, count(DISTINCT run) AS runs FROM l WHERE run < 3 GROUP BY 1)
SELECT fact_key, CASE WHEN st IS NULL THEN 'new' WHEN st IN ('open', 'confirmed') THEN 'continued' ELSE 'reopened' END AS mode, CASE WHEN st IN ('open', 'confirmed') THEN st ELSE 'open' END AS status, CAST(coalesce(greatest(runs + 1, oc + 1), 1) AS BIGINT) AS occurrences FROM (SELECT DISTINCT fact_key FROM e) LEFT JOIN b USING (fact_key)""",
    "fact_registry": _ENTRIES + " SELECT fact_key, arg_max(status, run) AS status, arg_max(mode, run) AS mode, count(DISTINCT run) AS runs, max(run) AS last_run FROM l GROUP BY 1",
    "action_lanes": f"WITH {A.CLAIMS_SQL}, g AS (SELECT subject_key, bool_or(source_type IN ('confluence_page', 'local_doc')) AS doc, bool_or(source_type = 'github_file') AS code, bool_or(source_type = 'metamodel') AS model FROM claims GROUP BY 1) SELECT subject_key, CASE WHEN doc AND code THEN 'both' WHEN model THEN 'artifact' WHEN doc THEN 'document' ELSE 'code' END AS lane FROM g",
    "cache_retention": "WITH ev AS (SELECT event_id, user_id, ts + INTERVAL 1 DAY * (event_id % 60) AS ts FROM events), e AS (SELECT event_id AS row_id, 'u' || (user_id % 40) AS source_id, ts, CAST(row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM ev) SELECT row_id, source_id, place FROM e WHERE place <= 3 OR ts >= (SELECT max(ts) FROM ev) - INTERVAL 30 DAY",
    "latest_event": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "source_set_hash": f"WITH {A.CLAIMS_SQL} SELECT source_type, left(sha256(string_agg(claim_id || ':' || fingerprint, '|' ORDER BY claim_id || ':' || fingerprint)), 32) AS set_hash, count(*) AS n FROM claims GROUP BY 1",
    "schema_registry": f"""WITH t AS (SELECT {A._pick_sql(("Node:", "Relationship:", "History:"), "p_partkey")} || upper(substr(p_brand, 1, 8)) || (p_partkey % 20) AS schema_key, {A._pick_sql(("unconfirmed", "observed_only", "confirmed", "unconfirmed"), "p_size")} AS status, p_partkey % 300 AS claim FROM part)
SELECT schema_key, arg_min(status, CASE status WHEN 'confirmed' THEN 0 WHEN 'observed_only' THEN 1 WHEN 'unconfirmed' THEN 2 ELSE 3 END) AS status, count(DISTINCT claim) AS n_claims, CASE WHEN starts_with(schema_key, 'Node:') THEN 'node' WHEN starts_with(schema_key, 'Relationship:') THEN 'relationship' ELSE 'other' END AS schema_kind FROM t GROUP BY schema_key""",
    "gold_gate": FINDINGS_SQL + f""", g(case_id, polarity, category, object_key) AS (VALUES {", ".join(str(x) for x in GOLD)}), j AS (SELECT polarity = 'expected' AS w, EXISTS (SELECT 1 FROM findings f WHERE f.category = g.category AND f.object_key = g.object_key) AS hit FROM g),
s AS (SELECT count(*) FILTER (WHERE w) AS total, count(*) FILTER (WHERE w AND hit) AS matched, count(*) FILTER (WHERE NOT w AND hit) AS false_positives FROM j)
SELECT *, round(matched / total, 6) AS recall, CASE WHEN matched + false_positives > 0 THEN round(matched / (matched + false_positives), 6) ELSE 1.0 END AS precision, matched = total AND false_positives = 0 AS passed FROM s""",
    "answer_indications": f"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS x, lower(trim(coalesce(text, ''))) AS l FROM conversations WHERE length(trim(coalesce(text, ''))) > 10 AND NOT ends_with(trim(text), '?') AND lower(trim(text)) NOT IN ({", ".join(map(S.quoted, P.FILLERS))})),
m AS (SELECT *, {S.contains_any('l', P.DEFINITE)} AS d, {S.contains_any('l', P.NEGATED)} AS n, {S.contains_any('l', P.SCOPED)} AS s, list_has_any(regexp_split_to_array(l, '\\s+'), [{", ".join(map(S.quoted, P.ASSERTING))}]) AS a FROM t),
g AS (SELECT conv_id, turn, CASE WHEN d THEN 'definite' WHEN a AND (s OR n) THEN 'assertion' WHEN n THEN 'negation' WHEN a OR length(x) > 30 THEN 'general' END AS grade FROM m)
SELECT *, CAST(CASE grade WHEN 'definite' THEN 0.95 WHEN 'assertion' THEN 0.85 WHEN 'negation' THEN 0.75 ELSE 0.65 END AS DOUBLE) AS confidence FROM g WHERE grade IS NOT NULL""",
    "operational_counts": "SELECT count(*) AS spans, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS slow, count(DISTINCT user_id) AS workers, max(event_id) AS last FROM events",
    "severity_histogram": FINDINGS_SQL + " SELECT severity, count(*) AS n, count(DISTINCT category) AS categories FROM findings GROUP BY 1",
    "review_sections": _SECTIONS + " SELECT section_id, doc_id, priority, CAST(len(tokens) AS INT) AS n_tokens FROM sec",
    "review_candidates": _PAIRS + " SELECT left_id, right_id, CAST(score AS BIGINT) AS score, CAST(overlap AS BIGINT) AS overlap FROM pair",
    "review_cards": _PAIRS + rf""", b2 AS (SELECT pair.*, lower(x.body) AS lb, lower(y.body) AS rb FROM pair JOIN sec x ON left_id = x.section_id LEFT JOIN sec y ON right_id = y.section_id),
k AS (SELECT left_id, right_id, CAST(score AS BIGINT) AS score, CASE WHEN right_id IS NULL THEN 'gap' WHEN overlap < 2 THEN NULL WHEN {S.contains_any("(lb || chr(10) || rb)", V.OBSOLETE)} THEN 'obsolete' WHEN {S.contains_any("(lb || chr(10) || rb)", V.GAP)} THEN 'gap' WHEN regexp_matches(lb, '(^|[^a-z])(not|no|kein|nicht|never)([^a-z]|$)') <> regexp_matches(rb, '(^|[^a-z])(not|no|kein|nicht|never)([^a-z]|$)') THEN 'error' ELSE 'misunderstanding' END AS deviation_type FROM b2)
SELECT *, CAST(CASE WHEN right_id IS NULL THEN 0.62 WHEN deviation_type = 'misunderstanding' THEN 0.58 ELSE 0.68 END AS DOUBLE) AS confidence FROM k WHERE deviation_type IS NOT NULL""",
    "page_issues": _PAGES + " SELECT node, depth, children, class, array_to_string(issues, '|') AS issues FROM i",
    "page_key_figures": _PAGES + f""", k AS (SELECT count(*) AS pages, {", ".join(f"count(*) FILTER (WHERE list_contains(issues, '{x}')) AS {x}" for x in _KINDS)}, round(avg(depth), 1) AS avg_depth, max(depth) AS max_depth FROM i)
SELECT *, greatest(0, least(100, 100 - 8 * deep - 10 * fat - 15 * duplicate - 5 * mixed - 3 * unclear)) AS structure, greatest(0, least(100, 100 - 8 * long - 5 * short - 6 * mixed)) AS readability FROM k""",
    "page_scores": _PAGES + """, j AS (SELECT i.*, title, parent FROM i JOIN page USING (node)), n AS (SELECT count(*) AS f FROM nation),
k AS (SELECT count(*) AS pages, count(*) FILTER (WHERE class = 'subject') AS subject, count(*) FILTER (WHERE class = 'technical') AS technical, count(*) FILTER (WHERE class = 'mixed') AS mixed, count(*) FILTER (WHERE class = 'unclear') AS unclear, count(*) FILTER (WHERE len(issues) > 0) AS with_issues, CAST(sum(len(issues)) AS BIGINT) AS issues, round(avg(depth), 1) AS avg_depth, max(depth) AS max_depth,
  count(*) FILTER (WHERE parent IS NULL AND depth = 0 AND children = 0) AS orphans, count(*) FILTER (WHERE depth > 4) AS d, count(*) FILTER (WHERE children > 12) AS fat, count(*) FILTER (WHERE list_contains(issues, 'duplicate')) AS dup, count(*) FILTER (WHERE length(title) > 60) AS long, count(*) FILTER (WHERE length(title) < 8) AS short FROM j)
SELECT pages, subject, technical, mixed, unclear, with_issues, issues, avg_depth, max_depth, orphans, CAST(round(100 * (subject + technical) / pages) AS BIGINT) AS coverage, greatest(0, least(100, 100 - 8 * d - 10 * fat - 15 * dup - 5 * mixed - 3 * unclear)) AS structure, greatest(0, least(100, 100 - 8 * long - 5 * short - 6 * mixed)) AS readability, CAST(least(100, round(20 * f / pages)) AS BIGINT) AS cross_references FROM k, n""",
    "page_suggestions": _PAGES + ", s AS (SELECT unnest(issues) AS kind, CAST(node AS VARCHAR) AS key FROM i) SELECT * FROM s WHERE kind IN ('deep', 'fat', 'mixed', 'unclear') UNION ALL SELECT 'duplicate', lower(trim(title)) FROM page GROUP BY 2 HAVING count(*) > 1",
    "text_functions": f"""WITH p AS (SELECT *, {_PART_NAME} AS n, {_PW.format(_PART_NAME)} AS w0, {_PW.format("p_type || ' ' || p_brand")} AS v0 FROM part), q AS (SELECT *, {_first_distinct('w0', 4)} AS w, {_first_distinct('v0', 4)} AS v FROM p)
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(n)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(trim(n)) > 18 THEN rtrim(left(trim(n), 15)) || '...' ELSE trim(n) END AS short, 'sha256:' || sha256(n) AS hash, left(sha1(p_name || '|' || p_size || '|' || p_type), 16) AS section, array_to_string(w, '|') AS words, CASE WHEN len(w) > 0 AND len(v) > 0 THEN round(len(list_intersect(w, v)) / len(w), 6) ELSE 0.0 END AS overlap FROM q""",
    "path_divergence": """WITH p AS (SELECT p_partkey AS k, ['start', 's' || (p_partkey % 3), 's' || ((p_partkey + 1) % 4), 'end'] AS a, CASE WHEN p_partkey % 5 = 0 THEN ['start', 's' || (p_partkey % 3), 's' || ((p_partkey + 1) % 4), 'end'] WHEN p_partkey % 5 = 1 THEN ['begin', 's' || (p_partkey % 3), 'end'] ELSE ['start', 's' || (p_partkey % 4), 's' || ((p_partkey + 1) % 5), 's' || ((p_partkey + 1) % 4), 'end'] END AS b FROM part),
m AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS pre, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: list_reverse(a)[1:i] = list_reverse(b)[1:i])) AS suf FROM p)
SELECT k AS p_partkey, CAST(pre AS INT) AS prefix, CAST(suf AS INT) AS suffix, array_to_string(a[pre + 1:len(a) - suf], '>') AS documented_gap, array_to_string(b[pre + 1:len(b) - suf], '>') AS implemented_gap, CASE WHEN a = b THEN 'equal' WHEN pre > 0 AND suf > 0 THEN 'internal' WHEN pre > 0 THEN 'tail' WHEN suf > 0 THEN 'prefix' ELSE 'full' END AS mode FROM m""",
    "section_overlap": f"WITH {A.CLAIMS_SQL} SELECT record_ord, list_contains(list_transform(string_split(section_path, '>'), lambda x: lower(trim(x))), 'flow') AS affected FROM claims",
    "vector_cosine": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS cosine FROM embeddings",
}
