"""Domain claims, query paths and path variants over texts and records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.operators import domain as D
from klarspan.operators import fragments as G
from klarspan.operators import metadata as N
from klarspan.operators import variants as V
from klarspan.plans import runs

_PLAIN = D.Vocabulary(("Order", "Lineitem", "Customer", "Source"), ("OPEN", "SHIPPED", "CLOSED"), "Source", "Order")
VOCABULARY = D.Vocabulary(
    _PLAIN.entities, _PLAIN.states, _PLAIN.origin, _PLAIN.centre,
    D.families(_PLAIN, decision=r"(?i)manual review", hierarchy=((r"(?i)three tier", "layered"), (r"(?i)single run", "flat")), scope=((r"(?i)kept apart", "separated"), (r"(?i)mixed", "mixed")), chain=((r"Source\s*->", "from_source"),)),
)

#: Lines of the documents of each kind, with the condition on the customer's key under which the first text stands.
_TEXTS = {
    "prose": (
        ("", "# Segment {seg}", ""), ("", "## Rules", ""), ("", "Order must be checked by {seg} staff.", ""), ("k % 3 = 0", "Customer starts as OPEN", "Customer waits"), ("", "Order and Lineitem may be OPEN or SHIPPED", ""),
        ("k % 8 < 4", "no manual review for Order", "manual review for Order"), ("", "| Order | open | shipped |", ""), ("", "| entity | initial | status |", ""), ("", "| Order | open | shipped |", ""), ("", "", ""), ("", "| Lineitem | shipped |", ""),
        ("", "Source -> Customer -> Order -> Lineitem", ""), ("k % 5 = 0", "three tier run model", "single run id"), ("k % 7 = 0", "the phases are mixed", "the phases are kept apart"),
    ),
    "diagram": (
        ("", "@startuml", ""), ("", 'partition "Order flow {seg}" {', ""), ("", "note right of Order", ""), ("k % 3 = 0", "  Order may be OPEN", "  nothing here"), ("", "end note", ""), ("", "Order --> Lineitem : SUPPORTS", ""), ("", "legend: Customer starts as OPEN", ""),
        ("", "' comment OPEN Order", ""), ("", "legend", ""), ("k % 8 < 4", "all CLOSED", "none"), ("", "end legend", ""), ("", "}", ""), ("", "@enduml", ""),
    ),
    "config": (("", "writes:", ""), ("", "  - Order:SHIPPED", ""), ("k % 3 = 0", "  - Lineitem", "  - other"), ("", "# Order OPEN", ""), ("", "states:", ""), ("", "  Order: OPEN", "")),
    "code": (("", "# Order OPEN", ""), ("k % 3 = 0", "state = {'Order': 'OPEN'}", "state = {}")),
}
_KINDS = (("confluence_page", "Rules", "wiki/page", "prose"), ("github_file", "legacy", "flow.puml", "diagram"), ("github_file", "allowlist", "conf/allowlist.yaml", "config"), ("github_file", "state", "src/state.py", "code"))


def _documents(spark, d):
    """A document a customer, prose, a diagram, configuration or code in turn."""
    c = A.table(spark, d, "customer").withColumn("k", F.col("c_custkey"))

    def text(kind):
        lines = [F.when(F.expr(when), F.lit(one)).otherwise(F.lit(other)) if when else F.lit(one) for when, one, other in _TEXTS[kind]]
        return F.replace(F.array_join(F.array(*lines), "\n"), F.lit("{seg}"), F.col("c_mktsegment"))

    pick = lambda make: F.when(F.col("k") % 4 == 0, make(0)).when(F.col("k") % 4 == 1, make(1)).when(F.col("k") % 4 == 2, make(2)).otherwise(make(3))
    return c.select(F.col("k").alias("doc_id"), pick(lambda i: F.lit(_KINDS[i][0])).alias("source_type"), pick(lambda i: F.lit(_KINDS[i][1])).alias("title"), pick(lambda i: F.lit(_KINDS[i][2])).alias("path"), pick(lambda i: text(_KINDS[i][3])).alias("text"))


def domain_records(spark, d):
    """All domain claims as records, counted by what their lines and documents make of them."""
    return D.domain_claims(_documents(spark, d), VOCABULARY).groupBy("predicate", "assertion_status", "source_authority", "operator", "temporal_status").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("n_fingerprints"))


def _family(name):
    def query(spark, d):
        found = D.domain_claims(_documents(spark, d), VOCABULARY).where(F.col("family") == name)
        return found.select("doc_id", "line_no", "subject_key", "predicate", "value", "section_path")

    query.__name__ = f"domain_{name}"
    query.__doc__ = f"Claims of the family {name} over documents of all kinds."
    return query


def diagram_context(spark, d):
    """Lines of diagrams with the context of their partition, note or legend, and the hops these make."""
    docs = _documents(spark, d).where("doc_id % 4 = 1")
    lines = D.diagram_lines(docs)
    hops = D.hop_claims(lines, "SUPPORTS", "Order", "Lineitem").select("doc_id", "line_no", F.col("value").alias("hop"))
    return lines.join(hops, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "line", "section_path", "partition", "block", "hop")


def table_headers(spark, d):
    """Cells of table rows under the header carried down to them."""
    from klarspan.operators.extraction import sectioned_lines

    rows = D.table_lines(sectioned_lines(_documents(spark, d).where("doc_id % 4 = 0")))
    return rows.select("doc_id", "line_no", F.array_join("headers", "/").alias("headers"), F.array_join("cells", "/").alias("cells"))


def _query_files(spark, d):
    """Two graph queries in the code of a part, or one in its configuration."""
    k = F.col("p_partkey").cast("string")
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    third = (F.col("p_partkey") % 3).cast("string")
    code = t('"""No query, but MATCH."""\ndef load', k, '(tx):\n    q = """\n    MATCH (a:Order)-[:DERIVED_FROM]->(s:Source', third, ")\n    MERGE (a)-[r:SUPPORTS {x: 1}]->(e:Element)\n    \"\"\"\n    tx.run('MATCH (x:Part)-[:PART_OF]->(y:Brand)<-[:MADE_BY]-(z:Maker) RETURN x')\n    note = 'nothing here'\n")
    config = t("name: x", k, "\nquery_template: |\n  MATCH (a:Order)-[:HAS]->(:Line)-[:OF]->(p:Part)\n  RETURN a\nother: 1\n")
    yaml = F.col("p_partkey") % 4 == 0
    return A.table(spark, d, "part").select(t("q", k).alias("source_id"), F.when(yaml, "a.yaml").otherwise("a.py").alias("path"), F.when(yaml, config).otherwise(code).alias("text"))


def query_fragments(spark, d):
    return G.query_fragments(_query_files(spark, d)).select("source_id", "line", "end_line", F.length(F.trim("text")).alias("length"))


def query_steps(spark, d):
    """Relations, chain steps and directions that queries in code and configuration name."""
    return G.query_steps(G.query_edges(G.query_fragments(_query_files(spark, d))), ("Order", "Element"), ("DERIVED_FROM",))


def query_paths(spark, d):
    """The paths that the relations of each query make, and the full ones from where everything comes from."""
    paths = G.query_paths(G.query_edges(G.query_fragments(_query_files(spark, d))), ("DERIVED_FROM",))
    return paths.union(G.full_paths(paths, F.lit("Origin"), ("Source0", "Source1", "Source2"))).select("source_id", "line", "path", "hops")


def _path_records(spark, d):
    """A record an order: roles by key, chains of services by its customer, values by priority."""
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    subject = F.concat(F.lit("Flow"), (F.col("o_custkey") % 211).cast("string"))
    own = F.array(F.concat(F.lit("app.entry"), (k % 2).cast("string")), F.concat(F.lit("svc.S"), (F.col("o_custkey") % 3).cast("string")), F.concat(F.when(k % 5 == 0, "legacy.").otherwise("db."), F.lit("R"), (k % 3).cast("string")))
    chains = F.when(k % 3 == 0, F.array(own, F.array(F.lit("app.entry0"), F.lit("db.R1")))).otherwise(F.array(own))
    value = F.concat(F.when(k % 7 == 0, "direct write ").otherwise("approval "), (k % 2).cast("string"))
    rows = o.select(k.alias("record_id"), subject.alias("subject_key"), F.when(F.col("o_custkey") % 2 == 0, A.pick(("github_file", "github_file", "confluence_page"), k)).otherwise("github_file").alias("source_type"), F.concat(F.lit("s"), (k % 97).cast("string")).alias("source_id"), F.when(F.col("o_custkey") % 5 == 0, F.when(k % 11 == 0, "legacy").when(k % 13 == 0, "primary")).alias("role"), value.alias("value"), chains.alias("chains"))
    return rows.withColumn("strength", N.path_strength(F.col("value"), F.flatten("chains").cast("string")))


def path_roles(spark, d):
    """Which records are primary and which variants, marked or inferred."""
    return V.roles(_path_records(spark, d)).select("record_id", "family", "path_role", "inferred")


def path_comparisons(spark, d):
    """The primary record nearest to each variant, and what their chains share."""
    return V.compared(V.roles(_path_records(spark, d)))


def legacy_path_gaps(spark, d):
    return V.legacy_path_gaps(_path_records(spark, d))


def document_run(spark, d):
    """Documents to findings: claims of all documents, compared, and their findings counted."""
    found = runs.document_run(_documents(spark, d), A.event_truths(spark, d), VOCABULARY).findings
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"), F.count_distinct("object_key").alias("n_objects"))


FAMILIES = ("role", "status", "decision", "initial", "hierarchy", "scope", "chain", "path", "allowlist")
QUERIES = {f.__name__: f for f in (*map(_family, FAMILIES), domain_records, diagram_context, table_headers, query_fragments, query_steps, query_paths, path_roles, path_comparisons, legacy_path_gaps, document_run)}

# The same in SQL

_ROWS = (
    # kind, line, condition, family, subject, predicate, value, line says (for status), block
    (0, 3, "", "role", "Order.role", "entity_role_assertion", "be checked by {seg} staff", "asserted", ""),
    (0, 4, "k % 3 = 0", "status", "Customer.status_canon", "defined_status", "OPEN", "asserted", ""),
    (0, 4, "k % 3 = 0", "initial", "Customer.initial_state", "initial_status", "OPEN", "asserted", ""),
    (0, 5, "", "role", "Lineitem.role", "entity_role_assertion", "be OPEN or SHIPPED", "asserted", ""),
    *((0, 5, "", "status", f"{e}.status_canon", "defined_status", s, "asserted", "") for e in ("Order", "Lineitem") for s in ("OPEN", "SHIPPED")),
    (0, 6, "k % 8 < 4", "decision", "Order.decision", "decision", "excluded", "excluded", ""),
    (0, 6, "k % 8 >= 4", "decision", "Order.decision", "decision", "included", "asserted", ""),
    *((0, n, "", "status", "Order.status_canon", "defined_status", s, "asserted", "") for n in (7, 9) for s in ("OPEN", "SHIPPED")),
    (0, 9, "", "initial", "Order.initial_state", "initial_status", "OPEN", "asserted", ""),
    (0, 11, "", "status", "Lineitem.status_canon", "defined_status", "SHIPPED", "asserted", ""),
    (0, 12, "", "chain", "EvidenceChain.direction", "evidence_chain_type", "from_source", "asserted", ""),
    (0, 12, "", "path", "EvidenceChain.active_path", "documented_evidence_chain_path", "Customer -> Order -> Lineitem", "asserted", ""),
    (0, 12, "", "path", "EvidenceChain.full_path", "documented_evidence_chain_full_path", "Source -> Customer -> Order -> Lineitem", "asserted", ""),
    (0, 13, "k % 5 = 0", "hierarchy", "Run.model", "run_hierarchy", "layered", "asserted", ""),
    (0, 13, "k % 5 <> 0", "hierarchy", "Run.model", "run_hierarchy", "flat", "asserted", ""),
    (0, 14, "k % 7 = 0", "scope", "Phase.scope_distinction", "phase_scope_type", "mixed", "asserted", ""),
    (0, 14, "k % 7 <> 0", "scope", "Phase.scope_distinction", "phase_scope_type", "separated", "asserted", ""),
    (1, 4, "k % 3 = 0", "role", "Order.role", "puml_entity_role_assertion", "be OPEN", "asserted", "note"),
    (1, 4, "k % 3 = 0", "status", "Order.status_canon", "puml_defined_status", "OPEN", "asserted", "note"),
    (1, 6, "", "path", "EvidenceChain.active_path", "puml_evidence_chain_path", "Order -> Lineitem", "asserted", ""),
    *((1, 7, "", "status", f"{e}.status_canon", "puml_defined_status", "OPEN", "asserted", "") for e in ("Order", "Customer")),
    (1, 7, "", "initial", "Order.initial_state", "puml_initial_status", "OPEN", "asserted", ""),
    (1, 10, "k % 8 < 4", "status", "Order.status_canon", "puml_defined_status", "CLOSED", "asserted", "legend"),
    (2, 2, "", "status", "Order.status_canon", "yaml_defined_status", "SHIPPED", "asserted", ""),
    (2, 2, "", "allowlist", "Order.write_contract", "yaml_write_allowlist_entry", "Order in writes: Order:SHIPPED", "asserted", ""),
    (2, 3, "k % 3 = 0", "allowlist", "Lineitem.write_contract", "yaml_write_allowlist_entry", "Lineitem in writes: Lineitem", "asserted", ""),
    (2, 6, "", "status", "Order.status_canon", "yaml_defined_status", "OPEN", "asserted", ""),
    (3, 2, "k % 3 = 0", "status", "Order.status_canon", "code_defined_status", "OPEN", "asserted", ""),
)
_q = lambda s: "'" + s.replace("'", "''") + "'"


def _claims_sql() -> str:
    parts = [f"SELECT k, seg, CAST({n} AS INT) AS line_no, {_q(f)} AS family, {_q(s)} AS subject_key, {_q(p)} AS predicate, replace({_q(v)}, '{{seg}}', seg) AS value, {_q(a)} AS said, {_q(b)} AS block FROM c WHERE k % 4 = {kind}{f' AND {when}' if when else ''}" for kind, n, when, f, s, p, v, a, b in _ROWS]
    place = "CASE k % 4 WHEN 0 THEN 'Rules > Segment ' || seg || ' > Rules' WHEN 1 THEN 'legacy:' || line_no || CASE WHEN block <> '' THEN ':' || block ELSE '' END WHEN 2 THEN 'allowlist > ' || CASE WHEN line_no < 5 THEN 'writes' ELSE 'states' END ELSE 'state:' || line_no END"
    return f"WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer), r AS ({' UNION ALL '.join(parts)}), x AS (SELECT *, {place} AS section_path FROM r)"


_CTE = _claims_sql()
_PR = f"""WITH b AS (SELECT o_orderkey AS record_id, o_custkey AS c, 'Flow' || (o_custkey % 211) AS subject_key, CASE WHEN o_custkey % 2 = 0 THEN ['github_file', 'github_file', 'confluence_page'][CAST(o_orderkey % 3 AS INT) + 1] ELSE 'github_file' END AS source_type, 's' || (o_orderkey % 97) AS source_id,
  CASE WHEN o_custkey % 5 = 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'legacy' WHEN o_orderkey % 13 = 0 THEN 'primary' END END AS role, CASE WHEN o_orderkey % 7 = 0 THEN 'direct write ' ELSE 'approval ' END || (o_orderkey % 2) AS value,
  ['app.entry' || (o_orderkey % 2), 'svc.S' || (o_custkey % 3), CASE WHEN o_orderkey % 5 = 0 THEN 'legacy.' ELSE 'db.' END || 'R' || (o_orderkey % 3)] AS own FROM orders),
r AS (SELECT *, CASE WHEN record_id % 3 = 0 THEN [own, ['app.entry0', 'db.R1']] ELSE [own] END AS chains, source_type <> 'github_file' AS is_doc, CASE WHEN record_id % 7 = 0 THEN -2 ELSE 2 END + CASE WHEN record_id % 5 = 0 THEN -2 ELSE 0 END AS strength,
  array_to_string(list_sort(list_distinct(CASE WHEN record_id % 3 = 0 THEN own || ['app.entry0', 'db.R1'] ELSE own END)), '|') AS family, CASE WHEN role = 'primary' THEN 'primary' WHEN role = 'legacy' THEN 'variant' END AS marked FROM b),
k AS (SELECT *, coalesce(marked, CASE WHEN is_doc AND NOT coalesce(bool_or(marked = 'primary') OVER (PARTITION BY subject_key), false) THEN 'primary' END) AS known FROM r),
lead AS (SELECT subject_key, max(strength) AS lead FROM k WHERE known = 'primary' GROUP BY 1),
g AS (SELECT subject_key, family, greatest(0, max(strength)) AS gs FROM k WHERE known IS NULL AND NOT is_doc GROUP BY ALL),
e AS (SELECT subject_key, count(*) AS families, max(gs) AS top, min(gs) AS least, any_value(lead.lead) AS lead FROM g LEFT JOIN lead USING (subject_key) GROUP BY 1),
j AS (SELECT g.*, coalesce(lead, top) AS base, e.lead, CASE WHEN lead IS NOT NULL THEN gs >= lead ELSE gs = top END AS leads FROM g JOIN e USING (subject_key) WHERE families > 1 AND (lead IS NOT NULL OR top > least)),
n AS (SELECT k.record_id, k.subject_key, k.family, k.value, j.leads, j.gs, j.base, j.lead FROM k LEFT JOIN j ON j.subject_key = k.subject_key AND j.family = k.family WHERE known IS NULL AND NOT is_doc),
bl AS (SELECT DISTINCT subject_key, value FROM n WHERE leads AND lead IS NULL UNION SELECT subject_key, value FROM k WHERE known = 'primary'),
u AS (SELECT DISTINCT subject_key, family FROM n WHERE NOT leads AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.subject_key = n.subject_key AND bl.value = n.value)),
t AS (SELECT n.record_id, CASE WHEN leads AND lead IS NULL THEN 'primary' WHEN NOT leads AND u.family IS NOT NULL AND (gs < base OR regexp_matches(lower(n.family), 'legacy|compat|fallback|degraded|secondary|bypass|direct|manual|v1')) THEN 'variant' END AS guess FROM n LEFT JOIN u ON u.subject_key = n.subject_key AND u.family = n.family),
told AS (SELECT k.*, coalesce(known, guess) AS path_role, known IS NULL AND guess IS NOT NULL AS inferred FROM k LEFT JOIN t USING (record_id))"""
_ALIGN = """,
v AS (SELECT DISTINCT subject_key, family AS variant_family, chains FROM told WHERE path_role = 'variant'),
pr AS (SELECT subject_key, family AS primary_family, chains AS pc, min({'later': NOT is_doc, 's': source_id, 'r': record_id}) AS first FROM told WHERE path_role = 'primary' GROUP BY ALL),
xy AS (SELECT v.subject_key, variant_family, v.chains, primary_family, pc, first, x, y FROM v JOIN pr USING (subject_key), unnest(v.chains) a(x), unnest(pc) b(y)),
al AS (SELECT *, len(list_intersect(x, y)) AS q, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) AS p, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[len(x) + 1 - i] = y[len(y) + 1 - i]), false) - 1, least(len(x), len(y))) AS s,
  len(list_intersect(list_distinct(list_transform(x, lambda e: split_part(e, '.', 2))), list_distinct(list_transform(y, lambda e: split_part(e, '.', 2))))) AS l FROM xy),
bs AS (SELECT subject_key, variant_family, chains, primary_family, pc, first, max({'q': q, 'p': p, 's': s, 'l': l}) AS sc FROM al GROUP BY ALL),
met AS (SELECT subject_key, variant_family, chains, primary_family, first.r AS primary_id, sc FROM bs QUALIFY row_number() OVER (PARTITION BY subject_key, variant_family, chains ORDER BY sc.q DESC, sc.p DESC, sc.s DESC, sc.l DESC, len(list_distinct(flatten(pc))) DESC, first.later, first.s, first.r, primary_family) = 1),
pairs AS (SELECT told.subject_key, record_id AS variant_id, family AS variant_family, primary_id, primary_family, CAST(sc.q AS INT) AS qualified, CAST(sc.p AS INT) AS prefix, CAST(sc.s AS INT) AS suffix, CAST(sc.l AS INT) AS simple, CASE WHEN sc.q > 0 THEN 'qualified' WHEN sc.l > 0 THEN 'simple' ELSE 'none' END AS alignment FROM told JOIN met ON met.subject_key = told.subject_key AND met.variant_family = told.family AND met.chains = told.chains WHERE path_role = 'variant')"""
ORACLES = {
    **{f"domain_{f}": f"{_CTE} SELECT DISTINCT k AS doc_id, line_no, subject_key, predicate, value, section_path FROM x WHERE family = '{f}'" for f in FAMILIES},
    "domain_records": f"""{_CTE}, y AS (SELECT *, CASE k % 4 WHEN 0 THEN 'working_doc' WHEN 1 THEN 'historical' ELSE 'implementation' END AS source_authority FROM x),
z AS (SELECT *, CASE WHEN said = 'excluded' THEN 'forbids' WHEN contains(predicate, 'status') THEN 'defines' WHEN regexp_matches(predicate, 'hierarchy|chain|role') THEN 'describes' ELSE 'states' END AS operator FROM y)
SELECT predicate, said AS assertion_status, source_authority, operator, CASE WHEN source_authority = 'historical' THEN 'historical' ELSE 'current' END AS temporal_status, count(*) AS n, count(DISTINCT k || '|' || subject_key || '|' || line_no) AS n_fingerprints FROM z GROUP BY ALL""",
    "diagram_context": """WITH c AS (SELECT c_custkey AS k, 'Order flow ' || c_mktsegment AS part FROM customer WHERE c_custkey % 4 = 1),
l(n, block, pre, said, alt, hop) AS (VALUES (4, 'note', 'note right of Order', 'Order may be OPEN', 'k3', NULL), (6, '', '', 'Order --> Lineitem : SUPPORTS', '', 'Order -[:SUPPORTS]-> Lineitem'), (7, '', 'legend', 'Customer starts as OPEN', '', NULL), (10, 'legend', 'legend', 'all CLOSED', 'k8', NULL), (12, '', '', '}', '', NULL))
SELECT k AS doc_id, CAST(n AS INT) AS line_no, CASE WHEN pre <> '' THEN part || ' ' || pre || ' ' ELSE '' END || CASE WHEN alt = 'k3' AND k % 3 <> 0 THEN 'nothing here' WHEN alt = 'k8' AND k % 8 >= 4 THEN 'none' ELSE said END AS line, 'legacy:' || n || CASE WHEN block <> '' THEN ':' || block ELSE '' END AS section_path, part AS partition, block, hop FROM c, l""",
    "table_headers": "SELECT c_custkey AS doc_id, CAST(n AS INT) AS line_no, headers, cells FROM customer, (VALUES (7, NULL, 'Order/open/shipped'), (9, 'entity/initial/status', 'Order/open/shipped'), (11, NULL, 'Lineitem/shipped')) t(n, headers, cells) WHERE c_custkey % 4 = 0",
    "query_fragments": "SELECT 'q' || p_partkey AS source_id, CAST(n AS INT) AS line, CAST(e AS INT) AS end_line, CAST(l AS INT) AS length FROM part, (VALUES (1, 1, 1, 20), (1, 3, 6, 97), (1, 7, 7, 67), (0, 3, 4, 59)) f(py, n, e, l) WHERE (p_partkey % 4 <> 0) = (py = 1)",
    "query_steps": """WITH e AS (SELECT 'q' || p_partkey AS source_id, CAST(n AS INT) AS line, src, type, CASE WHEN dst = 'Source' THEN dst || (p_partkey % 3) ELSE dst END AS dst FROM part, (VALUES (1, 3, 'Order', 'DERIVED_FROM', 'Source'), (1, 3, 'Order', 'SUPPORTS', 'Element'), (1, 7, 'Part', 'PART_OF', 'Brand'), (1, 7, 'Maker', 'MADE_BY', 'Brand'), (0, 3, 'Order', 'HAS', 'Line'), (0, 3, 'Line', 'OF', 'Part')) f(py, n, src, type, dst) WHERE (p_partkey % 4 <> 0) = (py = 1)),
a AS (SELECT *, src || ' -[:' || type || ']-> ' || dst AS arrow, src IN ('Order', 'Element') OR dst IN ('Order', 'Element') AS on_chain FROM e)
SELECT source_id, line, 'GraphWrite.' || type AS subject_key, 'code_graph_relation' AS predicate, arrow AS value FROM a UNION SELECT source_id, line, 'EvidenceChain.step.' || src || '.' || type || '.' || dst, 'code_evidence_chain_step', arrow FROM a WHERE on_chain UNION SELECT source_id, line, 'EvidenceChain.direction', 'code_evidence_chain_direction', CASE WHEN type = 'DERIVED_FROM' THEN 'against' ELSE 'along' END FROM a WHERE on_chain""",
    "query_paths": "SELECT 'q' || p_partkey AS source_id, CAST(n AS INT) AS line, replace(path, 'Source', 'Source' || (p_partkey % 3)) AS path, CAST(h AS INT) AS hops FROM part, (VALUES (1, 3, 'Source -> Order -> Element', 2), (1, 3, 'Origin -> Source -> Order -> Element', 3), (1, 7, 'Part -> Brand', 1), (1, 7, 'Maker -> Brand', 1), (0, 3, 'Order -> Line -> Part', 2)) f(py, n, path, h) WHERE (p_partkey % 4 <> 0) = (py = 1)",
    "path_roles": f"{_PR} SELECT record_id, family, path_role, inferred FROM told",
    "path_comparisons": f"{_PR}{_ALIGN} SELECT * FROM pairs",
    "legacy_path_gaps": f"""{_PR}{_ALIGN}, s AS (SELECT subject_key, count(*) FILTER (WHERE path_role = 'primary') AS n_primary, count(*) FILTER (WHERE path_role = 'variant') AS n_variants, bool_or(inferred) AS inferred, count(DISTINCT family) FILTER (WHERE path_role = 'primary') AS pf FROM told WHERE path_role IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT subject_key FROM told v WHERE path_role = 'variant' AND NOT EXISTS (SELECT 1 FROM told p WHERE p.subject_key = v.subject_key AND p.path_role = 'primary' AND p.value = v.value)),
m AS (SELECT subject_key, count(DISTINCT variant_family) AS variant_families, count(DISTINCT primary_family) AS met_families, max(qualified) AS most_shared, min(alignment) AS alignment FROM pairs GROUP BY 1)
SELECT subject_key, 'legacy_path_gap' AS category, 'high' AS severity, n_primary, n_variants, inferred, variant_families, met_families, pf - met_families AS unmet_families, most_shared, alignment FROM s JOIN c USING (subject_key) JOIN m USING (subject_key) WHERE n_primary > 0 AND n_variants > 0""",
}
