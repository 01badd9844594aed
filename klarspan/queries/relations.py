"""Links, similarity, retrieval and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import scoring, semantics, text
from klarspan.operators import graph as G
from klarspan.operators import relations as R
from klarspan.operators import retrieval as T
from klarspan.operators.claims import first_by
from klarspan.queries import sql as S

_CATEGORIES = ("contradiction", "policy_conflict", "implementation_drift", "missing_documentation")


def _findings(spark, d):
    """A finding for each value that is claimed of a subject, at its first claim."""
    c = first_by(A.claims(spark, d), ["subject_key", "normalized_value"], ["record_ord"]).withColumn("category", A.pick(_CATEGORIES, F.col("record_ord") / 25))
    bucket = scoring.root_cause(F.col("subject_key"), F.col("category"), F.col("normalized_value"), F.col("source_authority") == "ssot")
    return c.select(F.col("record_ord").alias("finding_ord"), F.concat_ws(":", "category", "subject_key", "predicate", "normalized_value").alias("canonical_key"), F.concat_ws(":", F.lit("g"), "source_id", semantics.scope_key(F.col("subject_key"))).alias("group_key"), F.when(F.col("source_authority") == "ssot", F.concat(F.lit("t"), F.col("source_id"))).alias("truth_key"), F.col("subject_key").alias("object_key"), "category", bucket.alias("bucket"), "title", A.pick(("critical", "high", "medium", "low"), F.col("record_ord") / 25).alias("severity"), (F.col("source_authority") == "ssot").alias("truth"), (F.col("line") % 2 == 0).alias("delta"), "source_id", "confidence", "matched_text")


def _sql_bucket(truth: str) -> str:
    words = "lower(subject_key || ' ' || category || ' ' || normalized_value)"
    return f"""CASE WHEN {truth} THEN 'truth' WHEN {S.ends_any('subject_key', ('write_path', 'read_path'))} OR category = 'read_write_gap' OR {S.contains_any(words, ('write contract', 'read contract', 'write path', 'read path'))} THEN 'write_contract'
  WHEN {S.ends_any('subject_key', ('policy', 'approval_policy', 'scope_policy'))} OR category IN ('policy_conflict', 'legacy_path_gap') OR {S.contains_any(words, ('approval', 'guardrail', 'policy'))} THEN 'policy'
  WHEN {S.ends_any('subject_key', ('lifecycle', 'review_status'))} OR {S.contains_any(words, ('lifecycle', 'review status', 'status-kanon', 'status canon'))} THEN 'lifecycle'
  WHEN subject_key = 'BSM.process' OR starts_with(subject_key, 'BSM.phase.') OR starts_with(subject_key, 'BSM.process.') OR {S.contains_any(words, ('bsm.process', 'bsm process', 'bsm phase', 'phase count', 'phase source', 'phasenmodell'))} THEN 'process'
  WHEN category = 'implementation_drift' THEN 'implementation' WHEN category IN ({', '.join(map(S.quoted, scoring.DOCUMENTARY))}) THEN 'documentation' WHEN category IN ('clarification_needed', 'open_decision') THEN 'clarification' ELSE 'misc' END"""


FINDINGS_SQL = f"""WITH RECURSIVE {A.CLAIMS_SQL},
f0 AS (SELECT *, {A._pick_sql(_CATEGORIES, "record_ord // 25")} AS category FROM claims QUALIFY row_number() OVER (PARTITION BY subject_key, normalized_value ORDER BY record_ord) = 1),
findings AS (SELECT record_ord AS finding_ord, category || ':' || subject_key || ':' || predicate || ':' || normalized_value AS canonical_key, 'g:' || source_id || ':' || {S.scope('subject_key')} AS group_key, CASE WHEN source_authority = 'ssot' THEN 't' || source_id END AS truth_key,
  subject_key AS object_key, category, {_sql_bucket("source_authority = 'ssot'")} AS bucket, title, {A._pick_sql(("critical", "high", "medium", "low"), "record_ord // 25")} AS severity, source_authority = 'ssot' AS truth, line % 2 = 0 AS delta, source_id, confidence, matched_text FROM f0),
ranked AS (SELECT *, {S.lookup('bucket', scoring.ROOT_CAUSE, 99)} AS priority FROM findings)
"""


def finding_links(spark, d):
    return R.finding_links(_findings(spark, d))


def finding_root_causes(spark, d):
    return _findings(spark, d).select("finding_ord", "bucket", scoring.root_cause_priority(F.col("bucket")).alias("priority"), scoring.severity_rank(F.col("severity")).alias("rank"), scoring.detail_penalty(F.col("category")).alias("penalty"))


def similar_pairs(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), A.pick(A.SOURCES, F.col("label")).alias("source"), F.concat(F.lit("V"), (F.col("vec_id") % 7).cast("string")).alias("value"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.15).alias("vector"))  # shifted, so that pairs reach the thresholds
    return R.similar_pairs(e).select("left_id", "right_id", F.round("cosine", 6).alias("cosine"), "severity")


def _parts(spark, d):
    p = A.table(spark, d, "part")
    key = F.col("p_partkey")
    return p.select(key.alias("segment_id"), F.concat(F.lit("s"), (key % 50).cast("string")).alias("source_id"), F.concat(F.lit("a"), (key % 97).cast("string")).alias("anchor"), F.concat(F.lit("Top > "), A.pick(("Flow", "Notes", "Other", "Rules", "Last", "Extra"), key), F.lit(" > "), (key % 200).cast("string")).alias("section_path"), (1 + key % 8 * 5).cast("int").alias("line_start"), (2 + key % 8 * 5).cast("int").alias("line_end"), text.keywords(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("low write read high")), 5).alias("words"))


def _few_claims(spark, d):
    return A.claims(spark, d).select("claim_id", "source_id", F.concat(F.lit("a"), (F.col("record_ord") % 211).cast("string")).alias("anchor"), F.concat_ws(" > ", "section_path", (F.col("record_ord") % 200).cast("string")).alias("section_path"), "line", text.keywords("matched_text", 8).alias("words"))


_WORDS_SQL = "list_filter(regexp_extract_all(lower({}), '[a-z0-9_]{{3,}}'), lambda w: w NOT IN (" + ", ".join(map(S.quoted, text.STOPWORDS)) + "))"


def _first_distinct(words: str, n: int) -> str:
    """The first n distinct words in order of appearance."""
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)[1:{n}]"


_PARTS_SQL = f"""parts0 AS (SELECT p_partkey AS k, {_WORDS_SQL.format("p_name || ' ' || p_type || ' ' || p_brand || ' low write read high'")} AS ws FROM part),
parts AS (SELECT k AS segment_id, 's' || (k % 50) AS source_id, 'a' || (k % 97) AS anchor, 'Top > ' || {A._pick_sql(("Flow", "Notes", "Other", "Rules", "Last", "Extra"), "k")} || ' > ' || (k % 200) AS section_path, 1 + k % 8 * 5 AS line_start, 2 + k % 8 * 5 AS line_end, {_first_distinct("ws", 5)} AS words FROM parts0)"""
_FEW_SQL = f"""few0 AS (SELECT claim_id, source_id, 'a' || (record_ord % 211) AS anchor, section_path || ' > ' || (record_ord % 200) AS section_path, line, {_WORDS_SQL.format("matched_text")} AS ws FROM claims),
few AS (SELECT * EXCLUDE (ws), {_first_distinct("ws", 8)} AS words FROM few0)"""


def claim_segment_links(spark, d):
    return R.claim_segment_links(_parts(spark, d), _few_claims(spark, d)).select("claim_id", "segment_id", F.round("score", 6).alias("score"), "relation_type")


def _segments(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("segment_id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.concat_ws(" ", "source", "lang").alias("keywords"), F.col("text").alias("content"))


def full_text_search(spark, d):
    """The best documents for each benchmark text, by BM25 over weighted fields."""
    seg = _segments(spark, d)
    asked = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.query_tokens(F.col("text")).alias("terms"))
    posted = G.kept(T.postings(seg, {"title": "title", "section": "section", "keywords": "keywords", "content": "content"}))
    return T.bm25(posted, asked, seg.count()).select("query_id", "segment_id", "bm25")


def snippets(spark, d):
    """The best parts as snippets for each finding, of those that it names or shares words with: direct matches, words and
    confidence together."""
    f = _findings(spark, d).select(F.col("finding_ord").alias("finding_id"), "source_id", F.concat(F.lit("a"), (F.col("finding_ord") % 211).cast("string")).alias("anchor"), text.keywords("matched_text", 8).alias("words"), T.snippet_budget(F.col("bucket"), F.col("severity")).alias("budget"), (F.col("confidence") - 0.9).alias("cosine"))
    found = T.met(f, _parts(spark, d)).join(f.select("finding_id", "budget", "cosine"), "finding_id").withColumn("lexical", F.lit(0.0))
    return T.snippets(T.hybrid(found)).select("finding_id", "segment_id", "score", "place")


def _edges(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    return p.select((k % 211).alias("src"), ((k * 13 + F.col("p_size")) % 211).alias("dst"), A.pick(("both", "truth_only", "none", "delta_only"), F.col("p_size")).alias("mode"), A.pick(("governs", "documents", "references", "contains", "other"), k).alias("relation"), (F.lit(40) + F.col("p_size")).cast("double").alias("c100")).withColumn("confidence", F.col("c100") / 100).withColumn("strength", F.col("confidence")).withColumn("write_relevant", F.col("src") % 3 == 0)


_EDGES_SQL = f"""edge AS (SELECT p_partkey % 211 AS src, (p_partkey * 13 + p_size) % 211 AS dst, {A._pick_sql(("both", "truth_only", "none", "delta_only"), "p_size")} AS mode, {A._pick_sql(("governs", "documents", "references", "contains", "other"), "p_partkey")} AS relation, (40 + p_size)::DOUBLE / 100 AS confidence, (p_partkey % 211) % 3 = 0 AS write_relevant FROM part)"""


def _seeds(spark):
    return spark.range(3).select((F.col("id") * 70).alias("node"))


def graph_expand(spark, d):
    return G.expand(_edges(spark, d), _seeds(spark))


def graph_best_paths(spark, d):
    return G.best_paths(_edges(spark, d), _seeds(spark)).select("seed", "node", F.round("score", 9).alias("score"), "hops")


def graph_closure(spark, d):
    return G.closure(_edges(spark, d))


def graph_edge_merge(spark, d):
    return G.merge_edges(_edges(spark, d))


def scope_groups(spark, d):
    """Sources reachable from s7 over claims of one subject, value, title and line."""
    c = A.claims(spark, d).select(F.concat_ws(":", "subject_key", "normalized_value", "title", "line").alias("claim_id"), F.col("source_id").alias("key"))
    return G.reachable_groups(c, spark.range(1).select(F.lit("s7").alias("key")))


QUERIES = {f.__name__: f for f in (finding_links, finding_root_causes, similar_pairs, claim_segment_links, full_text_search, snippets, graph_expand, graph_best_paths, graph_closure, graph_edge_merge, scope_groups)}
_SEARCH = """WITH seg AS (SELECT doc_id AS segment_id, source AS title, lang AS section, source || ' ' || lang AS keywords, text AS content FROM documents),
term AS (SELECT segment_id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]{2,}')) AS term, 4.0::DOUBLE AS w FROM seg UNION ALL SELECT segment_id, unnest(regexp_extract_all(lower(section), '[a-z0-9_]{2,}')), 2.0::DOUBLE FROM seg
  UNION ALL SELECT segment_id, unnest(regexp_extract_all(lower(keywords), '[a-z0-9_]{2,}')), 1.0::DOUBLE FROM seg UNION ALL SELECT segment_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{2,}')), 1.0::DOUBLE FROM seg),
posted AS (SELECT segment_id, term, sum(w) AS tf, count(*) AS n FROM term GROUP BY ALL),
"""
_QUERY_WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), lambda w: w NOT IN (" + ", ".join(map(S.quoted, text.STOPWORDS)) + "))"
ORACLES = {
    "finding_links": FINDINGS_SQL
    + """, p AS (SELECT l.finding_ord AS l, r.finding_ord AS r, l.priority > r.priority AS swapped, least(CASE WHEN l.canonical_key = r.canonical_key THEN 1 ELSE 9 END,
  CASE WHEN l.group_key = r.group_key THEN CASE WHEN l.priority <> r.priority THEN 2 ELSE 4 END ELSE 9 END, CASE WHEN l.truth_key = r.truth_key THEN CASE WHEN l.priority <> r.priority THEN 3 ELSE 5 END ELSE 9 END,
  CASE WHEN l.object_key = r.object_key THEN CASE WHEN l.category = r.category THEN 4 WHEN l.priority <> r.priority THEN 3 ELSE 6 END ELSE 9 END) AS rule FROM ranked l JOIN ranked r ON l.finding_ord < r.finding_ord)
SELECT CASE WHEN swapped AND rule IN (2, 3) THEN r ELSE l END AS from_ord, CASE WHEN swapped AND rule IN (2, 3) THEN l ELSE r END AS to_ord, ['duplicates', 'depends_on', 'depends_on', 'supports', 'supports', 'gap_hint'][rule] AS relation_type, [0.92, 0.86, 0.82, 0.84, 0.72, 0.72][rule]::DOUBLE AS score FROM p WHERE rule < 9""",
    "finding_root_causes": FINDINGS_SQL + f" SELECT finding_ord, bucket, priority, {S.lookup('severity', scoring.SEVERITY, 9)} AS rank, CAST(category IN ({', '.join(map(S.quoted, scoring.SUPPORTING))}) AS INT) AS penalty FROM ranked",
    "similar_pairs": f"""WITH v AS (SELECT vec_id, {A._pick_sql(A.SOURCES, "label")} AS source, 'v' || (vec_id % 7) AS value, [x::DOUBLE + 0.15 FOR x IN embedding] AS e FROM embeddings),
p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.source <> b.source AND a.value <> b.value)
SELECT left_id, right_id, round(c, 6) AS cosine, CASE WHEN c >= 0.85 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE c >= 0.70""",
    "claim_segment_links": f"""WITH RECURSIVE {A.CLAIMS_SQL}, {_PARTS_SQL}, {_FEW_SQL},
direct AS (SELECT claim_id, segment_id, CASE WHEN f.anchor = p.anchor THEN 1.0::DOUBLE ELSE 0.96::DOUBLE END AS score FROM few f JOIN parts p USING (source_id) WHERE f.anchor = p.anchor OR line BETWEEN line_start AND line_end OR f.section_path = p.section_path),
loose AS (SELECT claim_id, segment_id, len(list_intersect(f.words, p.words)) / len(f.words) AS o FROM few f JOIN parts p USING (source_id) WHERE claim_id NOT IN (SELECT claim_id FROM direct) AND list_has_any(f.words, p.words)
  QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o DESC, segment_id) <= 4),
every AS (SELECT * FROM direct UNION ALL SELECT claim_id, segment_id, least(0.9::DOUBLE, 0.45::DOUBLE + o) FROM loose)
SELECT claim_id, segment_id, round(score::DOUBLE, 6) AS score, CASE WHEN score >= 0.95 THEN 'evidence' ELSE 'scope_match' END AS relation_type FROM every""",
    "full_text_search": _SEARCH
    + f"""q0 AS (SELECT item_id AS query_id, {_QUERY_WORDS} AS ws FROM benchmark), q AS (SELECT query_id, unnest({_first_distinct("ws", 8)}) AS term FROM q0),
len AS (SELECT segment_id, sum(n) AS len FROM posted GROUP BY 1), tot AS (SELECT sum(len) AS al, (SELECT count(*) FROM seg) AS ns FROM len), df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
s AS (SELECT query_id, segment_id, round(sum(greatest(1e-6, ln((ns - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len * ns / al))), 6) AS b FROM q JOIN posted USING (term) JOIN df USING (term) JOIN len USING (segment_id), tot GROUP BY query_id, segment_id)
SELECT query_id, segment_id, b AS bm25 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b DESC, segment_id) <= 10""",
    "snippets": FINDINGS_SQL
    + f""", {_PARTS_SQL}, fw AS (SELECT *, {_WORDS_SQL.format("matched_text")} AS ws FROM findings), fd AS (SELECT *, {_first_distinct("ws", 8)} AS fwords, CASE WHEN severity IN ('critical', 'high') AND bucket IN ('truth', 'write_contract', 'policy') THEN 5 WHEN severity IN ('critical', 'high') THEN 4 ELSE 3 END AS budget FROM fw),
s AS (SELECT finding_ord AS finding_id, segment_id, budget, round(1.2::DOUBLE * CAST(anchor = 'a' || (finding_ord % 211) AS INT) + CASE WHEN len(fwords) > 0 AND len(p.words) > 0 THEN len(list_intersect(fwords, p.words)) / len(fwords) ELSE 0 END + greatest(0.0, confidence - 0.9::DOUBLE), 6) AS score FROM fd JOIN parts p USING (source_id) WHERE anchor = 'a' || (finding_ord % 211) OR list_has_any(fwords, p.words))
SELECT finding_id, segment_id, score, CAST(row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, segment_id) AS INT) AS place, FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, segment_id) <= budget""",
    "graph_expand": f"WITH RECURSIVE {_EDGES_SQL}, r(node, depth) AS (SELECT unnest([0, 70, 140])::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN edge e ON r.node = e.src WHERE depth < 5 AND mode <> 'none') SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "graph_best_paths": f"""WITH RECURSIVE {_EDGES_SQL}, arc AS (SELECT src, dst, max((confidence * CASE relation {' '.join(f"WHEN '{k}' THEN {v}" for k, v in G.STRENGTH.items())} ELSE {G.OTHER} END)::DOUBLE) AS s FROM edge GROUP BY ALL),
r(seed, node, score, hops) AS (SELECT x, x, 1.0::DOUBLE, 0 FROM (SELECT unnest([0, 70, 140])::BIGINT AS x) UNION ALL SELECT seed, dst, score * s, hops + 1 FROM r JOIN arc ON r.node = arc.src WHERE hops < 4)
SELECT seed, node, round(score, 9) AS score, hops FROM r QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY round(score, 12) DESC, hops) = 1""",
    "graph_closure": f"WITH RECURSIVE {_EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edge), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r",
    "graph_edge_merge": f"WITH {_EDGES_SQL} SELECT src, dst, max(confidence) AS strength, bool_or(write_relevant) AS write_relevant, ['none', 'truth_only', 'delta_only', 'both'][bit_or(CASE mode WHEN 'truth_only' THEN 1 WHEN 'delta_only' THEN 2 WHEN 'both' THEN 3 ELSE 0 END) + 1] AS mode FROM edge GROUP BY ALL",
    "scope_groups": f"WITH RECURSIVE {A.CLAIMS_SQL}, m AS (SELECT DISTINCT subject_key || ':' || normalized_value || ':' || title || ':' || line AS k, source_id FROM claims), r(key) AS (SELECT 's7' UNION SELECT b.source_id FROM r JOIN m a ON a.source_id = r.key JOIN m b USING (k)) SELECT key FROM r",
}
