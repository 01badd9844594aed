"""State, graphs of claims, catalogs and summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import semantics
from klarspan.operators import semantic_graph as G
from klarspan.operators.graph import kept
from klarspan.operators import state as Z
from klarspan.queries import sql as S


def inherited_truths(spark, d):
    return Z.inherited_truths(A.event_truths(spark, d), "run2")


def derived_truths(spark, d):
    return Z.with_derived_truth(A.truths(spark).where("truth_ord <> 4"), A.claims(spark, d))


def replaced_claims(spark, d):
    changes = A.claims(spark, d).where("source_authority = 'confirmed_decision'").select("fingerprint", F.concat(F.lit("new "), "claim_id").alias("normalized_value"), F.col("record_ord").alias("ord"))
    return Z.replaced(A.claims(spark, d), changes).select("record_ord", "normalized_value")


def rehydrated_claims(spark, d):
    cached = A.claims(spark, d).withColumn("line", F.when(F.col("assertion_status") != "excluded", F.col("line"))).withColumn("source_id", F.concat_ws(":", "source_id", "subject_key"))
    docs = cached.where("source_type = 'github_file'").select("source_id")
    return Z.rehydrated(cached, docs).select("record_ord", "source_id")


def impacted_packages(spark, d):
    members = A.claims(spark, d).select(semantics.scope_key(F.col("subject_key")).alias("package"), F.concat_ws(":", "source_id", "normalized_value", "line").alias("key"))
    return Z.impacted_packages(members, F.col("package") == "BSM.process")


def approval_states(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 400).alias("request_id"), F.col("event_id").alias("ord"), A.pick(("requested", "approved", "requested", "executed", "rejected", "cancelled", "requested"), F.col("event_id") / 3).alias("action"))
    return Z.current_state(e, "request_id")


def next_run(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), A.pick(("running", "completed", "running"), F.col("o_orderkey")).alias("status"), F.col("o_orderdate").alias("created"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_until"))
    return Z.next_in_queue(o, "1998-01-01 00:00:00").select("run_id", "status")


def go_live_gate(spark, d):
    """Checks of a run's events, one a type: values must stay under a bound on average; clicks and views only advise."""
    e = A.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.sum((F.col("value") * 100).cast("long")) < F.count("*") * 5000).alias("ok"))
    return Z.gate(e.withColumn("required", ~F.col("name").isin("click", "view")))


def _graph(spark, d):
    """Nodes and relations of claims: subjects in scopes, policies over what is written, sources, and events' truths."""
    c = A.claims(spark, d).select("subject_key", "source_id", "source_type", "confidence")
    subject, scope, source = F.concat(F.lit("subject:"), "subject_key"), F.concat(F.lit("scope:"), semantics.scope_key(F.col("subject_key"))), F.concat(F.lit("source:"), "source_id")
    row = lambda a, b, kind, n: F.struct(a.alias("src"), b.alias("dst"), kind.alias("relation"), n.alias("confidence"))
    one, kind = F.lit(1.0), F.when(F.col("source_type") == "github_file", "implements").otherwise("documents")
    rows = c.select(F.inline(F.array(row(scope, subject, F.lit("contains"), one), row(subject, scope, F.lit("belongs_to"), one), row(source, subject, kind, F.col("confidence")))))
    policy = c.where(F.endswith("subject_key", F.lit(".policy"))).select("subject_key").distinct()
    written = F.regexp_replace("subject_key", "policy$", "write_path")
    governs = policy.select(row(subject, F.concat(F.lit("subject:"), written), F.lit("governs"), F.lit(0.9)).alias("r")).select("r.*")
    truth = A.event_truths(spark, d).where("truth_status = 'active'").select(row(F.concat(F.lit("truth:"), "canonical_key"), subject, F.lit("derived_from_truth"), one).alias("r")).select("r.*")
    keys = c.select("subject_key").distinct()
    node = lambda name, key, s: F.struct(name.alias("node"), key.alias("canonical_key"), s.alias("scope_key"))
    own = semantics.scope_key(F.col("subject_key"))
    nodes = keys.select(F.inline(F.array(node(subject, F.col("subject_key"), own), node(scope, own, own)))).union(c.select(source.alias("node"), F.col("source_id").alias("canonical_key"), F.lit("").alias("scope_key")))
    nodes = nodes.union(A.event_truths(spark, d).where("truth_status = 'active'").select(F.concat(F.lit("truth:"), "canonical_key").alias("node"), "canonical_key", own.alias("scope_key"))).dropDuplicates(["node"])
    nodes = nodes.withColumn("decision_relevant", F.contains("node", F.lit("policy")) | F.startswith("node", F.lit("truth:"))).withColumn("write_relevant", F.contains("node", F.lit("write_path")))
    return rows.union(governs).union(truth).groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence")), nodes


def typed_edges(spark, d):
    """Causal edges of the whole rule table: type, mode, strength, blocking and whether they carry truths."""
    return G.typed_edges(*_graph(spark, d))


def causal_expand(spark, d):
    """Scopes that a change of one nation's and all its parts, or a pending truth, touches within five steps."""
    relations, nodes = (kept(x) for x in _graph(spark, d))
    seeds = nodes.where("node LIKE 'scope:NATION_1%'").select("scope_key")
    bound = A.event_truths(spark, d).where("truth_status = 'active' AND pending_delta_recalculation").select(F.concat(F.lit("subject:"), "subject_key").alias("node"))
    return G.causal_expand(G.typed_edges(relations, nodes), nodes, seeds, bound)


def finding_context(spark, d):
    """What stands around the subject of each finding: parents, parts, siblings, policies, code and documents."""
    relations, nodes = (kept(x) for x in _graph(spark, d))
    o = A.claims(spark, d).select(F.col("record_ord").alias("finding_ord"), F.concat(F.lit("subject:"), "subject_key").alias("node"))
    return G.finding_context(o, relations, nodes)


def comment_statements(spark, d):
    c = A.table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"), "text")
    return Z.comment_statements(c)


def path_baselines(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    step = lambda i, m: F.concat(F.lit("s"), ((k * i) % m).cast("string"))
    rows = p.select(F.concat(F.lit("k"), (k % 40).cast("string")).alias("subject_key"), k.alias("id"), F.array(step(1, 4), step(3, 5), step(7, 6)).alias("path"))
    return Z.baselines(rows.where("id % 3 = 0").withColumnRenamed("id", "variant_id"), rows.where("id % 3 <> 0").select("subject_key", F.col("id").alias("source_id"), "path", (F.col("id") % 2 == 0).alias("is_doc")))


def semantic_relations(spark, d):
    return G.relations(A.claims(spark, d), A.truths(spark))


def causal_edges(spark, d):
    return G.causal_edges(semantic_relations(spark, d))


def truth_frames(spark, d):
    return G.truth_frames(causal_edges(spark, d))


def causal_attribution(spark, d):
    seeds = A.truths(spark).where("truth_ord IN (1, 3, 4)").select(F.concat(F.lit("subject:"), "subject_key").alias("node"))
    return G.attributed(causal_edges(spark, d), seeds).select("seed", "node", F.round("score", 6).alias("score"))


def schema_validation(spark, d):
    """Targets of claims against the catalog: confirmed where both name and kind are known, observed where only the name."""
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    target = p.select((k % 500).alias("claim"), F.upper(F.substring_index("p_type", " ", 1)).alias("name"), A.pick(("Node", "Relationship"), k).alias("kind"))
    catalog = p.where("p_partkey % 3 = 0").select(F.upper(F.substring_index("p_type", " ", 1)).alias("name"), A.pick(("Node", "Relationship"), k / 3).alias("kind")).where("name < 'P'").distinct()
    joined = target.join(catalog.withColumn("full", F.lit(True)), ["name", "kind"], "left").join(catalog.select("name").distinct().withColumn("half", F.lit(True)), "name", "left")
    status = F.when(F.col("full"), "confirmed").when(F.col("half"), "observed_only").otherwise("unconfirmed")
    out = joined.withColumn("status", status).groupBy("claim").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "observed_only", "unconfirmed")))
    n = F.col("confirmed") + F.col("observed_only") + F.col("unconfirmed")
    return out.withColumn("verdict", F.when(F.col("confirmed") == n, "confirmed").when(F.col("unconfirmed") == n, "unconfirmed").when(F.col("observed_only") == n, "observed_only").when(F.col("unconfirmed") > 0, "partly_unconfirmed").otherwise("mixed"))


def model_claims(spark, d):
    """Claims of a model dump: phases (regions) and their questions (nations)."""
    r, n = A.table(spark, d, "region"), A.table(spark, d, "nation")
    count = r.agg(F.count("*").cast("string").alias("value")).select(F.lit("BSM.process").alias("subject_key"), F.lit("phase_count").alias("predicate"), "value")
    slug = lambda c: semantics.slug(F.col(c))
    order = r.select(F.concat(F.lit("BSM.phase."), slug("r_name")).alias("subject_key"), F.lit("phase_order").alias("predicate"), F.col("r_regionkey").cast("string").alias("value"))
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    questions = both.select(F.concat(F.lit("BSM.phase."), slug("r_name"), F.lit(".question."), slug("n_name")).alias("subject_key"), F.lit("question_reference").alias("predicate"), F.col("n_name").alias("value"))
    per = both.groupBy("r_name").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("BSM.phase."), slug("r_name")).alias("subject_key"), F.lit("question_count").alias("predicate"), "value")
    return count.union(order).union(questions).union(per)


def dashboard(spark, d):
    """Totals by status and the three largest groups of each."""
    o = A.table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    from pyspark.sql.window import Window

    return o.withColumn("place", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("n"), "o_orderpriority"))).where("place <= 3")


def cross_references(spark, d):
    """Pages and the claims that name them: by the same source id, or by a title that contains the page's."""
    pages = spark.createDataFrame([("s1", "legacy"), ("s2", "target"), ("s3", "zzz"), ("s99", "notes")], "page string, title string")
    c = A.claims(spark, d).select("claim_id", "source_id", F.lower("title").alias("t"))
    same = c.join(pages, c.source_id == pages.page).select("page", "claim_id")
    named = c.join(F.broadcast(pages), F.contains("t", F.col("title"))).select("page", "claim_id")  # a constant of four pages
    return same.union(named).groupBy("page").agg(F.count_distinct("claim_id").alias("n"))


def completed_facts(spark, d):
    """Facts (line items) of completed runs (orders), newest first: a join on the run and a semi-join of its children."""
    l, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    done = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return l.join(done, l.l_orderkey == done.o_orderkey).groupBy("o_orderdate").agg(F.count("*").alias("facts"), F.count_distinct("l_orderkey").alias("runs"))


def uncached_vectors(spark, d):
    """Texts without a cached vector: an anti-join on the text's hash."""
    docs = A.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return docs.join(docs.where("doc_id % 3 = 0").select("h").distinct(), "h", "left_anti").select("doc_id")


def usage_totals(spark, d):
    e = A.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.groupBy("event_type").agg(F.sum(k).alias("tokens"), F.count("*").alias("calls"), F.count_if(k.isNull()).alias("unknown"))


def coverage_summary(spark, d):
    c = A.claims(spark, d)
    return c.groupBy("source_type").agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("subject_key").alias("subjects"), F.count("*").alias("claims"), F.round(F.avg("confidence"), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (typed_edges, causal_expand, finding_context, inherited_truths, derived_truths, replaced_claims, rehydrated_claims, impacted_packages, approval_states, next_run, go_live_gate, comment_statements, path_baselines, semantic_relations, causal_edges, truth_frames, causal_attribution, schema_validation, model_claims, dashboard, cross_references, completed_facts, uncached_vectors, usage_totals, coverage_summary)}
_W = f"WITH RECURSIVE {A.CLAIMS_SQL}"
_SCOPE = S.scope("subject_key")
_REL = _W + f""", rel0 AS (SELECT 'subject:' || subject_key AS src, 'scope:' || {_SCOPE} AS dst, 'belongs_to' AS relation, 1.0::DOUBLE AS confidence FROM claims
 UNION ALL SELECT 'source:' || source_id, 'subject:' || subject_key, CASE source_type WHEN 'github_file' THEN 'implements' WHEN 'metamodel' THEN 'stated_by' ELSE 'documents' END, confidence FROM claims
 UNION ALL SELECT 'truth:' || canonical_key, 'subject:' || subject_key, 'truth_on', 1.0 FROM truths WHERE truth_status = 'active'), rel AS (SELECT src, dst, relation, max(confidence) AS confidence FROM rel0 GROUP BY ALL)"""
_EDGE = _REL + f""", rule(relation, edge_type, way, points, mode) AS (VALUES {", ".join(str(r) for r in G.EDGE_RULES)}), edge AS (SELECT CASE WHEN way = 1 THEN src ELSE dst END AS src, CASE WHEN way = 1 THEN dst ELSE src END AS dst, edge_type, mode, round(confidence * points / 100, 6) AS strength FROM rel JOIN rule USING (relation))"""
_SLUG = S.slug
_PP = "p AS (SELECT 'k' || (p_partkey % 40) AS subject_key, p_partkey AS id, ['s' || (p_partkey % 4), 's' || (p_partkey * 3 % 5), 's' || (p_partkey * 7 % 6)] AS path FROM part)"
_SCOPE = "CASE WHEN subject_key LIKE 'BSM.phase.%' THEN array_to_string(string_split(subject_key, '.')[1:3], '.') WHEN subject_key LIKE 'BSM.process%' THEN 'BSM.process' ELSE split_part(subject_key, '.', 1) END"
_GRAPH = f"""WITH RECURSIVE {A.CLAIMS_SQL}, {A.EVENT_TRUTHS_SQL},
cs AS (SELECT *, {_SCOPE} AS scope FROM claims), act AS (SELECT *, {_SCOPE} AS scope FROM event_truths WHERE truth_status = 'active'),
rel0 AS (SELECT 'scope:' || scope AS src, 'subject:' || subject_key AS dst, 'contains' AS relation, 1.0::DOUBLE AS confidence FROM cs UNION ALL SELECT 'subject:' || subject_key, 'scope:' || scope, 'belongs_to', 1.0 FROM cs
  UNION ALL SELECT 'source:' || source_id, 'subject:' || subject_key, CASE WHEN source_type = 'github_file' THEN 'implements' ELSE 'documents' END, confidence FROM cs
  UNION ALL SELECT DISTINCT 'subject:' || subject_key, 'subject:' || regexp_replace(subject_key, 'policy$', 'write_path'), 'governs', 0.9 FROM cs WHERE subject_key LIKE '%.policy' UNION ALL SELECT 'truth:' || canonical_key, 'subject:' || subject_key, 'derived_from_truth', 1.0 FROM act),
rel AS (SELECT src, dst, relation, max(confidence) AS confidence FROM rel0 GROUP BY ALL),
node0 AS (SELECT 'subject:' || subject_key AS node, subject_key AS canonical_key, scope AS scope_key FROM cs UNION SELECT 'scope:' || scope, scope, scope FROM cs UNION SELECT 'source:' || source_id, source_id, '' FROM cs UNION SELECT 'truth:' || canonical_key, canonical_key, scope FROM act),
nodes AS (SELECT *, contains(node, 'policy') OR node LIKE 'truth:%' AS dec, contains(node, 'write_path') AS wr FROM node0),
rules(relation, edge_type, way, mode, less, blocking, carries, written) AS (VALUES {', '.join(str(r) for r in G.RELATION_RULES)}),
edges AS (SELECT CASE WHEN way = 1 THEN src ELSE dst END AS src, CASE WHEN way = 1 THEN dst ELSE src END AS dst, edge_type, mode, round(CASE WHEN less > 0 THEN greatest(0.4, confidence - less) ELSE confidence END, 6)::DOUBLE AS strength, blocking, CASE carries WHEN 'always' THEN true WHEN 'source' THEN a.dec WHEN 'target' THEN b.dec ELSE false END AS truth_relevant
  FROM rel JOIN rules USING (relation) JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE NOT written OR b.wr)"""
ORACLES = {
    "typed_edges": _GRAPH + " SELECT * FROM edges",
    "causal_expand": _GRAPH + f""", seeds AS (SELECT DISTINCT scope_key FROM nodes WHERE node LIKE 'scope:NATION_1%'), start AS (SELECT DISTINCT node FROM nodes JOIN seeds s ON nodes.scope_key <> '' AND (nodes.scope_key = s.scope_key OR starts_with(nodes.scope_key, s.scope_key || '.') OR starts_with(s.scope_key, nodes.scope_key || '.')) UNION SELECT node FROM nodes WHERE node IN (SELECT 'subject:' || subject_key FROM act WHERE pending_delta_recalculation)),
arcs AS (SELECT DISTINCT src, dst FROM edges WHERE mode <> 'none' AND (mode <> 'truth_only' OR truth_relevant)),
walk AS (SELECT node, 0 AS depth FROM start UNION SELECT dst, depth + 1 FROM walk JOIN arcs ON src = node WHERE depth < 5), seen AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1),
hit AS (SELECT scope_key, depth FROM seen JOIN nodes USING (node) UNION ALL SELECT {_SCOPE.replace('subject_key', 'canonical_key')}, depth FROM seen JOIN nodes USING (node) UNION ALL SELECT scope_key, 0 FROM seeds) SELECT scope_key, CAST(min(depth) AS INT) AS depth FROM hit WHERE scope_key <> '' GROUP BY 1""",
    "finding_context": _GRAPH + """, near AS (SELECT src AS node, dst AS far, CASE relation WHEN 'belongs_to' THEN 'parent' ELSE 'part' END AS kind FROM rel WHERE relation IN ('belongs_to', 'contains') UNION SELECT dst, src, CASE relation WHEN 'governs' THEN 'governed_by' WHEN 'implements' THEN 'implemented_by' ELSE 'documented_by' END FROM rel WHERE relation IN ('governs', 'implements', 'documents')),
alln AS (SELECT * FROM near UNION SELECT p.node, q.far, CASE q.kind WHEN 'part' THEN 'sibling' ELSE 'parent_governed_by' END FROM near p JOIN near q ON p.kind = 'parent' AND q.kind IN ('part', 'governed_by') AND q.node = p.far AND p.node <> q.far),
lab AS (SELECT DISTINCT alln.node, kind, canonical_key FROM alln JOIN nodes ON nodes.node = far WHERE alln.node IN (SELECT 'subject:' || subject_key FROM cs)), agg AS (SELECT node, kind, count(*) AS n, array_to_string(list(canonical_key ORDER BY canonical_key)[1:5], '|') AS examples FROM lab GROUP BY ALL)
SELECT record_ord AS finding_ord, kind, n, examples FROM cs JOIN agg ON agg.node = 'subject:' || subject_key""",
    "inherited_truths": f"WITH {A.EVENT_TRUTHS_SQL} SELECT left(sha256('run2|' || canonical_key), 16) AS truth_id, canonical_key, subject_key, predicate, normalized_value, pending_delta_recalculation AS retrigger, false AS pending FROM event_truths WHERE truth_status = 'active'",
    "derived_truths": _W + ", a AS (SELECT subject_key, predicate, normalized_value, source_kind FROM truths WHERE truth_status = 'active' AND truth_ord <> 4) SELECT * FROM a UNION ALL SELECT subject_key, predicate, arg_min(normalized_value, record_ord), 'system_inference' FROM claims WHERE subject_key = 'BSM.process' AND predicate = 'phase_count' AND NOT EXISTS (SELECT 1 FROM a WHERE a.subject_key = 'BSM.process' AND a.predicate = 'phase_count') GROUP BY 1, 2",
    "replaced_claims": _W + ", ch AS (SELECT fingerprint, arg_max('new ' || claim_id, record_ord) AS nv FROM claims WHERE source_authority = 'confirmed_decision' GROUP BY 1) SELECT record_ord, coalesce(nv, normalized_value) AS normalized_value FROM claims LEFT JOIN ch USING (fingerprint)",
    "rehydrated_claims": _W + ", c AS (SELECT record_ord, source_type, source_id || ':' || subject_key AS source_id, assertion_status <> 'excluded' AS good FROM claims) SELECT record_ord, source_id FROM c WHERE source_id IN (SELECT source_id FROM c WHERE source_type = 'github_file') AND source_id NOT IN (SELECT source_id FROM c WHERE NOT good)",
    "impacted_packages": _W + f", m AS (SELECT {_SCOPE} AS package, source_id || ':' || normalized_value || ':' || line AS key FROM claims) SELECT DISTINCT package FROM m WHERE package <> 'BSM.process' AND key IN (SELECT key FROM m WHERE package = 'BSM.process')",
    "approval_states": f"""WITH e AS (SELECT user_id % 400 AS request_id, event_id AS ord, {A._pick_sql(("requested", "approved", "requested", "executed", "rejected", "cancelled", "requested"), "event_id // 3")} AS action FROM events),
g AS (SELECT request_id, {", ".join(f"min(ord) FILTER (WHERE action = '{a}') AS {a}" for a in ("requested", "approved", "rejected", "cancelled", "executed"))} FROM e GROUP BY 1), s AS (SELECT *, least(approved, rejected, cancelled) AS decided FROM g WHERE requested IS NOT NULL)
SELECT request_id, CASE WHEN decided IS NULL THEN 'pending' WHEN decided = rejected THEN 'rejected' WHEN decided = cancelled THEN 'cancelled' WHEN executed > approved THEN 'executed' ELSE 'approved' END AS state FROM s""",
    "next_run": f"WITH r AS (SELECT o_orderkey AS run_id, {A._pick_sql(('running', 'completed', 'running'), 'o_orderkey')} AS status, o_orderdate FROM orders) SELECT run_id, status FROM r WHERE status = 'running' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-01-01' ORDER BY o_orderdate, run_id LIMIT 1",
    "go_live_gate": "WITH c AS (SELECT event_type AS name, event_type NOT IN ('click', 'view') AS required, sum(CAST(trunc(value * 100) AS BIGINT)) < count(*) * 5000 AS ok FROM events GROUP BY 1) SELECT count(*) FILTER (WHERE required AND NOT ok) = 0 AS ready, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE required AND NOT ok), '') AS blocking FROM c",
    "comment_statements": "WITH p AS (SELECT conv_id || ':' || turn AS comment_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;\\n]'), lambda x: trim(x)), lambda x: x <> '')[1:4] AS s FROM conversations) SELECT comment_id, CAST(unnest(range(0, len(s))) AS INT) AS ordinal, unnest(s) AS statement FROM p",
    "path_baselines": f"""WITH {_PP}, j AS (SELECT v.id AS variant_id, q.id AS primary_id, len(list_intersect(v.path, q.path)) AS o, CASE WHEN v.path[1] <> q.path[1] THEN 0 WHEN v.path[2] <> q.path[2] THEN 1 WHEN v.path[3] <> q.path[3] THEN 2 ELSE 3 END AS pre, q.id % 2 = 0 AS is_doc FROM p v JOIN p q USING (subject_key) WHERE v.id % 3 = 0 AND q.id % 3 <> 0)
SELECT variant_id, primary_id FROM j QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY o DESC, pre DESC, is_doc DESC, primary_id) = 1""",
    "semantic_relations": _REL + " SELECT * FROM rel",
    "causal_edges": _EDGE + " SELECT * FROM edge",
    "truth_frames": _EDGE + ", r(truth, node, depth) AS (SELECT src, dst, 1 FROM edge WHERE mode IN ('truth_only', 'both') AND src LIKE 'truth:%' UNION SELECT truth, e.dst, depth + 1 FROM r JOIN edge e ON r.node = e.src WHERE depth < 5 AND mode IN ('truth_only', 'both')) SELECT truth, node, min(depth) AS depth FROM r GROUP BY ALL",
    "causal_attribution": _EDGE + ", arc AS (SELECT src, dst, max(s) AS s FROM (SELECT src, dst, greatest(0.35::DOUBLE, strength) AS s FROM edge UNION ALL SELECT dst, src, greatest(0.35::DOUBLE, strength) * 0.88::DOUBLE FROM edge) GROUP BY ALL), r0 AS (SELECT 'subject:' || subject_key AS seed, 'subject:' || subject_key AS node, 1.0::DOUBLE AS score FROM truths WHERE truth_ord IN (1, 3, 4)), " + ", ".join(f"r{i + 1} AS (SELECT seed, node, max(score) AS score FROM (SELECT * FROM r{i} UNION ALL SELECT seed, arc.dst, score * s FROM r{i} JOIN arc ON r{i}.node = arc.src) GROUP BY ALL)" for i in range(5)) + " SELECT seed, node, round(score, 6) AS score FROM r5 WHERE node <> seed",
    "schema_validation": f"""WITH t AS (SELECT p_partkey % 500 AS claim, upper(split_part(p_type, ' ', 1)) AS name, {A._pick_sql(('Node', 'Relationship'), 'p_partkey')} AS kind FROM part), c AS (SELECT DISTINCT upper(split_part(p_type, ' ', 1)) AS name, {A._pick_sql(('Node', 'Relationship'), 'p_partkey // 3')} AS kind FROM part WHERE p_partkey % 3 = 0 AND upper(split_part(p_type, ' ', 1)) < 'P'),
s AS (SELECT claim, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.name = t.name AND c.kind = t.kind) THEN 'confirmed' WHEN t.name IN (SELECT name FROM c) THEN 'observed_only' ELSE 'unconfirmed' END AS status FROM t), g AS (SELECT claim, {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("confirmed", "observed_only", "unconfirmed"))}, count(*) AS n FROM s GROUP BY 1)
SELECT claim, confirmed, observed_only, unconfirmed, CASE WHEN confirmed = n THEN 'confirmed' WHEN unconfirmed = n THEN 'unconfirmed' WHEN observed_only = n THEN 'observed_only' WHEN unconfirmed > 0 THEN 'partly_unconfirmed' ELSE 'mixed' END AS verdict FROM g""",
    "model_claims": f"SELECT 'BSM.process' AS subject_key, 'phase_count' AS predicate, CAST(count(*) AS VARCHAR) AS value FROM region UNION ALL SELECT 'BSM.phase.' || {_SLUG('r_name')}, 'phase_order', CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'BSM.phase.' || {_SLUG('r_name')} || '.question.' || {_SLUG('n_name')}, 'question_reference', n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'BSM.phase.' || {_SLUG('r_name')}, 'question_count', CAST(count(*) AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "dashboard": "WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS INT) AS place FROM g QUALIFY place <= 3",
    "cross_references": _W + ", page(page, title) AS (VALUES ('s1', 'legacy'), ('s2', 'target'), ('s3', 'zzz'), ('s99', 'notes')) SELECT page, count(DISTINCT claim_id) AS n FROM page JOIN claims c ON c.source_id = page.page OR contains(lower(c.title), page.title) GROUP BY 1",
    "completed_facts": "SELECT o_orderdate, count(*) AS facts, count(DISTINCT l_orderkey) AS runs FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1",
    "uncached_vectors": "WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) SELECT doc_id FROM h WHERE h NOT IN (SELECT h FROM h WHERE doc_id % 3 = 0)",
    "usage_totals": "SELECT event_type, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls, count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS unknown FROM events GROUP BY 1",
    "coverage_summary": _W + " SELECT source_type, count(DISTINCT source_id) AS sources, count(DISTINCT subject_key) AS subjects, count(*) AS claims, round(avg(confidence), 6) AS confidence FROM claims GROUP BY 1",
}
