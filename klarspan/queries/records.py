"""Metadata, chains, decisions, lists, sections and matches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import scoring
from klarspan.operators import chains as H
from klarspan.operators import decisions as D
from klarspan.operators import extraction as X
from klarspan.operators import listings as L
from klarspan.operators import matching as M
from klarspan.operators import metadata as N
from klarspan.operators import sections as E
from klarspan.queries import sql as S
from klarspan.queries.relations import FINDINGS_SQL, _findings


def _k():
    return F.col("record_ord")


def claim_metadata(spark, d):
    value = F.when(_k() % 5 == 0, F.concat(F.lit("[x]: "), "normalized_value")).when(_k() % 5 == 1, F.concat(F.lit("Value: "), "normalized_value")).otherwise(F.col("normalized_value"))
    return N.claim_metadata(A.claims(spark, d).withColumn("normalized_value", value)).select("record_ord", "focus_value", "governance_level", "temporal_status", "subject_root", "property", "operator", "value_constraint", "value_kind", "scope_key", "derived_authority", "derived_status", "path_role")


def domain_claim_metadata(spark, d):
    return N.domain_metadata(A.claims(spark, d)).select("record_ord", "domain_status", "domain_authority", "domain_operator")


def _paths(spark, d):
    c = A.claims(spark, d).withColumn("family", F.regexp_extract("path_hint", "([a-z_]+)[.]?[a-z]*$", 1))
    return c.withColumn("strength", N.path_strength(F.col("normalized_value"), F.col("subject_key"), F.col("predicate"), F.col("path_hint")))


def path_groups(spark, d):
    return N.path_groups(_paths(spark, d))


def inferred_variants(spark, d):
    return N.inferred_variants(_paths(spark, d))


CHAINS = (("unit", "approval"), ("summary", "write"), ("tenant", "tenant"))


def chain_variant_conflicts(spark, d):
    return H.chain_variant_conflicts(A.claims(spark, d), CHAINS)


def chain_breaks(spark, d):
    c = A.claims(spark, d).withColumn("chain", F.concat_ws("/", "source_id", F.substring_index("subject_key", ".", 1)))
    return H.chain_breaks(c, ("write_contract",), ("approval_policy", "lifecycle_state"), "chain")


def architecture_observations(spark, d):
    return H.architecture_observations(A.claims(spark, d), ("write_contract", "read_contract"))


def supported_risks(spark, d):
    c = A.claims(spark, d).withColumn("subject_key", F.substring_index("subject_key", ".", 1))
    support = c.where("predicate <> 'lifecycle_state'").withColumn("function_name", F.concat(F.lit("fn"), (_k() % 9).cast("string")))
    return H.supported_risks(c.where("predicate = 'lifecycle_state'").withColumn("risk_id", _k()), support)


#: Kinds of places in a shop's code: its stock, its invoices, its mails.
GAP_RULES = (("stock", ("inventory",), ("reserve", "restock")), ("billing", ("invoice", "ledger"), ("charge",)), ("mail", ("mailer",), ("notify",)), ("import", ("feeds",), ()))
GAP_GROUPED = ("stock", "import")
GAP_PATHS = ("shop/inventory.py", "shop/invoice/api.py", "shop/mailer.py", "shop/main.py", "feeds/csv.py")
GAP_FUNCTIONS = ("run", "reserve_item", "charge_card", "notify_all", "", "restock", "close")


def _gaps(spark, d):
    e, k = A.table(spark, d, "events"), F.col("event_id")
    return H.gap_kinds(e.select(k.alias("record_id"), F.concat(F.lit("risk"), (k % 3).cast("string")).alias("predicate"), F.concat(F.lit("s"), (F.col("user_id") % 30).cast("string")).alias("source_id"), F.concat(F.lit("k"), (k % 8).cast("string")).alias("subject_key"), A.pick(GAP_PATHS, k).alias("path"), A.pick(GAP_FUNCTIONS, k).alias("function_name")), GAP_RULES)


def gap_kinds(spark, d):
    return _gaps(spark, d).select("record_id", "kind")


def risk_findings(spark, d):
    return H.risk_findings(_gaps(spark, d), GAP_GROUPED)


ACTIONS = ("accept", "reject", "specify", "other", "accept")


def _decisions(spark, d):
    e, k = A.table(spark, d, "events"), F.col("event_id")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 200).cast("string")).alias("package"), k.alias("ord"), A.pick(ACTIONS, k).alias("action"), F.when(k % 3 == 0, "").otherwise("why").alias("comment"))


def _members(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select(F.concat(F.lit("p"), (k % 230).cast("string")).alias("package"), F.concat(F.lit("f"), (k % 500).cast("string")).alias("fact_key"))


def _facts(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").where("p_partkey <= 600").select(F.concat(F.lit("f"), k.cast("string")).alias("fact_key"), A.pick(("open", "confirmed", "open"), k).alias("status"))


def package_states(spark, d):
    return D.package_states(_members(spark, d), _decisions(spark, d))


def synced_facts(spark, d):
    return D.synced_facts(_facts(spark, d), _members(spark, d), _decisions(spark, d))


def synced_packages(spark, d):
    return D.synced_packages(_members(spark, d), _facts(spark, d))


def truth_confirm_conflicts(spark, d):
    """Truths of events against what the first event of each user would have confirmed."""
    first = A.table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("k"))
    return D.truth_conflicts(A.event_truths(spark, d), first.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("canonical_key"), A.pick(A.VALUES[0], F.col("k")).alias("new_value")))


KINDS = ("open", "answer", "capture", "answer", "confirm", "capture", "dismiss", "answer", "supersede", "capture", "answer")


def clarifications(spark, d):
    k = F.col("event_id")
    return D.clarifications(A.table(spark, d, "events").where("user_id % 4 <> 0 OR event_id % 11 IN (0, 1, 2, 3)").select((F.col("user_id") % 300).alias("thread_id"), k.alias("ord"), A.pick(KINDS, k).alias("kind")))


def ticket_payloads(spark, d):
    return D.ticket_payloads(_findings(spark, d).select(F.col("source_id").alias("package"), F.col("finding_ord").alias("place"), "title", "severity", "object_key"))


def page_patches(spark, d):
    k = F.col("page_id")
    p = A.table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")).withColumn("heading", F.regexp_extract("html", r"<h[1-6]>([^<]*)</h", 1)).withColumn("heading", F.when((k % 3 == 0) | (F.col("heading") == ""), "no such heading").otherwise(F.col("heading")))
    return D.patched(p.withColumn("insertion", F.concat(F.lit("<p>note "), k.cast("string"), F.lit("</p>"))).withColumn("marker", F.when(k % 5 == 0, F.left("html", F.lit(10))).otherwise("<!--none-->"))).select("page_id", "mode", F.md5("patched").alias("md5"))


def findings_by_severity(spark, d):
    return L.findings_list(_findings(spark, d))


def findings_by_category(spark, d):
    return L.findings_list(_findings(spark, d), "category", "policy_conflict")


def gold_order(spark, d):
    return L.gold_order(_findings(spark, d).withColumn("action", F.when(F.col("finding_ord") % 3 == 0, "do")))


def load_order(spark, d):
    return L.load_order(_findings(spark, d))


def deduped_cards(spark, d):
    f = _findings(spark, d)
    return L.deduped_cards(f.select(F.col("finding_ord").alias("ord"), F.col("category").alias("deviation_type"), F.when(F.col("finding_ord") % 2 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), F.col("source_id").alias("source_a"), F.concat(F.lit("S"), (F.col("finding_ord") % 3).cast("string")).alias("source_b"))).select("ord", "card_key")


def status_partitions(spark, d):
    return L.status_partitions(A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), ("F", "O", "X"))


def folder_summary(spark, d):
    k = F.col("p_partkey")
    return L.folder_summary(A.table(spark, d, "part").select(F.concat(F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("src/"), F.lower("p_brand"), F.when(k % 2 == 0, "/sub/").otherwise("/"))), F.lit("f"), k.cast("string"), F.lit(".py")).alias("path")))


def _changed(spark, d):
    c = A.claims(spark, d).where("record_ord % 97 = 0")
    return c.select("source_id", F.when(_k() % 2 == 0, F.concat("section_path", F.lit(" > New"))).otherwise(F.col("section_path")).alias("section_path"))


def minimal_section_paths(spark, d):
    return E.minimal_paths(_changed(spark, d))


def section_regeneration(spark, d):
    c = A.claims(spark, d).withColumn("section_path", F.when(_k() % 19 == 0, "").otherwise(F.col("section_path")))
    return E.regeneration(c, _changed(spark, d), A.claims(spark, d).where("record_ord % 211 = 0 AND section_path = 'Top > Rules'"))


SIGNALS = ("password", "license", "@")


def _typed(spark, d):
    k = F.col("doc_id")
    return A.table(spark, d, "documents").select("doc_id", "text", A.pick((*A.SOURCES, "jira_ticket"), k).alias("source_type"), A.pick(A.TITLES, k).alias("title"), A.pick(A.PATHS, k).alias("path_hint"), (k % 50 == 0).alias("chosen"))


def fast_selection(spark, d):
    return E.fast_selection(_typed(spark, d), SIGNALS).select("doc_id")


def review_parts(spark, d):
    t = _typed(spark, d)
    lead = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## 1. Intro "), "title", F.lit("\n"))).when(F.col("source_type") == "github_file", "def read_it(x):\n").otherwise("")
    return E.review_parts(t.withColumn("text", F.concat(lead, F.coalesce("text", F.lit("")))))


def style_profile(spark, d):
    return E.style_profile(A.table(spark, d, "documents").select("doc_id", F.concat(F.lit("# 1. Part "), (F.col("doc_id") % 4).cast("string"), F.lit("\n"), F.lit("## Text\n"), F.coalesce("text", F.lit(""))).alias("text")))


def changed_pages(spark, d):
    k = F.col("page_id")
    p = A.table(spark, d, "pages").select("page_id", (k % 7).alias("revision"))
    return E.changed_pages(p, p.where("page_id % 5 <> 0").withColumn("revision", F.when(k % 11 == 0, -1).otherwise(F.col("revision"))), p.where("page_id % 3 <> 0"))


CLASSES, PROP_KEYS, PROP_VALUES, LABELS = ("", "Confidential", "Public", ""), ("page-access", "owner", "data-class", "visibility", "security"), ("Private", "open", "GDPR relevant", "someone", "standard"), ("", "restricted-area", "public", "notes", "pii")


def access_state(spark, d):
    k = F.col("page_id")
    return E.access_state(A.table(spark, d, "pages").select("page_id", F.when(k % 8 == 0, k % 3).alias("restrictions"), A.pick(CLASSES, k / 2).alias("classification"), A.pick(PROP_KEYS, k).alias("prop_key"), A.pick(PROP_VALUES, k / 5).alias("prop_value"), A.pick(LABELS, k / 25).alias("label")))


def _locations(spark, d):
    f, k = _findings(spark, d), F.col("finding_ord")
    one = lambda i: f.select(k.alias("finding_id"), F.lit(i).alias("at"), A.pick(A.SOURCES, k / (2 * i + 1)).alias("source_type"), F.concat(F.lit("s"), ((k + 13 * i) % 60).cast("string")).alias("source_id"), F.concat(F.lit("a"), (k % 331).cast("string")).alias("anchor"), F.when(k % 4 == 0, F.concat(F.lit("Top > "), (k % 37).cast("string"))).alias("section_path"), F.when(k % 6 == 0, F.concat(F.lit("p"), (k % 41).cast("string"))).alias("path_hint"))
    return one(0).union(one(1))


def _segments(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select(k.alias("segment_id"), A.pick(A.SOURCES, k / 3).alias("source_type"), F.concat(F.lit("s"), (k % 50).cast("string")).alias("source_id"), F.concat(F.lit("a"), (k % 97).cast("string")).alias("anchor"), F.concat(F.lit("Top > "), (k % 37).cast("string")).alias("section_path"), F.concat(F.lit("p"), (k % 41).cast("string")).alias("path_hint"), k.alias("ord"), A.pick(("unchanged", "changed", "added", "unchanged"), k / 2).alias("delta_status"))


def matched_segments(spark, d):
    return M.matched_segments(_locations(spark, d), _segments(spark, d))


def delta_insights(spark, d):
    s = _segments(spark, d)
    return M.delta_insights(M.matched_segments(_locations(spark, d), s), s)


def finding_seeds(spark, d):
    f = _findings(spark, d).select(F.col("finding_ord").alias("finding_id"), F.when(F.col("finding_ord") % 2 == 0, F.substring_index("object_key", ".", 1)).otherwise(F.col("object_key")).alias("object_key"), F.when(F.col("finding_ord") % 7 == 0, F.concat(F.lit("n"), "source_id")).alias("node"))
    return M.finding_seeds(f, A.claims(spark, d).where("record_ord % 3 = 0").select("subject_key", F.concat(F.lit("n"), "source_id").alias("node")))


LABEL_SETS = (("metaclass",), ("package",), ("bsmFunction", "x"), ("bsmQuestion",), ("bsmPhase", "package"), ("metaclass", "helperFunction"))


def _model(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    labels = F.split(A.pick([",".join(x) for x in LABEL_SETS], k), ",")
    nodes = p.select(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.when(k % 10 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 4 == 0, F.concat(F.lit("pub"), k.cast("string"))).alias("public_id"), labels.alias("labels"))
    edges = p.select(F.concat(F.lit("n"), (k * 7 % 211 + 1).cast("string")).alias("src"), F.concat(F.lit("n"), k.cast("string")).alias("dst"), A.pick(("CONTAINS", "USES", "CONTAINS", "REFERS"), k / 3).alias("kind"))
    return nodes, edges


def metaclasses(spark, d):
    return M.metaclasses(*_model(spark, d))


def model_functions(spark, d):
    return M.model_functions(*_model(spark, d))


def _corpus(spark, d):
    """A document for each 512 order keys: its claims as lines, a heading where the key is a hundred's multiple."""
    c = A.claims(spark, d).withColumn("doc_id", F.floor(_k() / 512))
    line = F.when(_k() % 100 == 0, F.concat(F.lit("## "), "title")).otherwise(F.concat(F.lit("`"), F.substring_index("subject_key", ".", 1), F.lit("` "), "matched_text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("record_ord", line.alias("line")))), lambda x: x["line"])  # at most 512
    return c.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text")).select("doc_id", A.pick((*A.SOURCES, "jira_ticket"), F.col("doc_id")).alias("source_type"), F.lit("Doc").alias("title"), "text")


ENTITIES = ("FRANCE_1", "CHINA_2", "BSM", "NOWHERE")


def extract_claims(spark, d):
    return X.extract_claims(_corpus(spark, d), ENTITIES)


QUERIES = {f.__name__: f for f in (claim_metadata, domain_claim_metadata, path_groups, inferred_variants, chain_variant_conflicts, chain_breaks, architecture_observations, supported_risks, gap_kinds, risk_findings, package_states, synced_facts, synced_packages, truth_confirm_conflicts, clarifications, ticket_payloads, page_patches, findings_by_severity, findings_by_category, gold_order, load_order, deduped_cards, status_partitions, folder_summary, minimal_section_paths, section_regeneration, fast_selection, review_parts, style_profile, changed_pages, access_state, matched_segments, delta_insights, finding_seeds, metaclasses, model_functions, extract_claims)}

# The same in SQL

_W = f"WITH RECURSIVE {A.CLAIMS_SQL}"
_any = S.contains_any


def _cases(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in pairs) + f" ELSE {otherwise} END"


_NAMED = "lower(title || ' ' || path_hint)"
_FOCUS = "CASE WHEN contains(v, ']: ') AND contains(v, '[') THEN substr(v, instr(v, ']: ') + 3) WHEN contains(v, ': ') AND length(substr(v, instr(v, ': ') + 2)) >= 8 THEN substr(v, instr(v, ': ') + 2) ELSE v END"
_STRENGTH = "(" + " + ".join(f"CASE WHEN contains(lower(translate(normalized_value || ' ' || subject_key || ' ' || predicate || ' ' || path_hint, '_-', '  ')), '{w}') THEN {n} ELSE 0 END" for words, n in ((N.STRONGER, 2), (N.WEAKER, -2), (("primary",), 1), (("secondary",), -1)) for w in words) + ")"
_PATHS_SQL = _W + f", r AS (SELECT subject_key, normalized_value, source_id, regexp_extract(path_hint, '([a-z_]+)[.]?[a-z]*$', 1) AS family, {_STRENGTH} AS strength FROM claims), g AS (SELECT subject_key, family, greatest(0, max(strength)) AS strength, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM r GROUP BY ALL)"
_GAPS_SQL = f"""WITH e AS (SELECT event_id AS record_id, 'risk' || (event_id % 3) AS predicate, 's' || (user_id % 30) AS source_id, 'k' || (event_id % 8) AS subject_key, {A._pick_sql(GAP_PATHS, 'event_id')} AS path, {A._pick_sql(GAP_FUNCTIONS, 'event_id')} AS fn FROM events),
k AS (SELECT *, {_cases([(n, " OR ".join([*(f"contains(path, '{w}')" for w in p), *(f"contains(fn, '{w}')" for w in f)])) for n, p, f in GAP_RULES], "'generic'")} AS kind FROM e)"""
_DECISIONS_SQL = f"""WITH dec0 AS (SELECT 'p' || (user_id % 200) AS package, event_id AS ord, {A._pick_sql(ACTIONS, 'event_id')} AS action, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'why' END AS comment FROM events),
dec AS (SELECT * FROM dec0 WHERE action <> 'other' AND (action <> 'specify' OR comment <> '')), mem AS (SELECT DISTINCT 'p' || (p_partkey % 230) AS package, 'f' || (p_partkey % 500) AS fact_key FROM part),
fact AS (SELECT 'f' || p_partkey AS fact_key, {A._pick_sql(('open', 'confirmed', 'open'), 'p_partkey')} AS status FROM part WHERE p_partkey <= 600)"""
_CHANGED_SQL = _W + """, ch AS (SELECT DISTINCT source_id, lower(CASE WHEN record_ord % 2 = 0 THEN section_path || ' > New' ELSE section_path END) AS path FROM claims WHERE record_ord % 97 = 0),
minimal AS (SELECT source_id, path FROM ch a WHERE NOT EXISTS (SELECT 1 FROM ch b WHERE b.source_id = a.source_id AND b.path <> a.path AND contains(' > ' || a.path || ' > ', ' > ' || b.path || ' > ')))"""
_LOC = "SELECT finding_ord AS finding_id, {0} AS pos, " + "{1} AS source_type, 's' || ((finding_ord + {2}) % 60) AS source_id, 'a' || (finding_ord % 331) AS anchor, CASE WHEN finding_ord % 4 = 0 THEN 'Top > ' || (finding_ord % 37) END AS section_path, CASE WHEN finding_ord % 6 = 0 THEN 'p' || (finding_ord % 41) END AS path_hint FROM findings"
_MATCH_SQL = FINDINGS_SQL + f""", loc AS ({_LOC.format(0, A._pick_sql(A.SOURCES, 'finding_ord'), 0)} UNION ALL {_LOC.format(1, A._pick_sql(A.SOURCES, 'finding_ord // 3'), 13)}),
seg AS (SELECT p_partkey AS segment_id, {A._pick_sql(A.SOURCES, 'p_partkey // 3')} AS source_type, 's' || (p_partkey % 50) AS source_id, 'a' || (p_partkey % 97) AS anchor, 'Top > ' || (p_partkey % 37) AS section_path, 'p' || (p_partkey % 41) AS path_hint, {A._pick_sql(('unchanged', 'changed', 'added', 'unchanged'), 'p_partkey // 2')} AS delta_status FROM part),
j AS (SELECT finding_id, segment_id, pos, coalesce(l.anchor = s.anchor, false) OR coalesce(l.section_path = s.section_path, false) OR coalesce(l.path_hint = s.path_hint, false) AS exact FROM loc l JOIN seg s USING (source_type, source_id)),
best AS (SELECT *, max(exact) OVER (PARTITION BY finding_id) AS top FROM j), g AS (SELECT finding_id, segment_id, exact, min((pos, segment_id)) AS f FROM best WHERE exact = top GROUP BY ALL),
m AS (SELECT finding_id, segment_id, exact, CAST(row_number() OVER (PARTITION BY finding_id ORDER BY f) AS INT) AS place FROM g QUALIFY place <= CASE WHEN exact THEN 6 ELSE 4 END)"""
_MODEL_SQL = f"""WITH node AS (SELECT 'n' || p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'pub' || p_partkey END AS public_id, string_split({A._pick_sql([",".join(x) for x in LABEL_SETS], 'p_partkey')}, ',') AS labels FROM part),
edge AS (SELECT 'n' || (p_partkey * 7 % 211 + 1) AS src, 'n' || p_partkey AS dst, {A._pick_sql(('CONTAINS', 'USES', 'CONTAINS', 'REFERS'), 'p_partkey // 3')} AS kind FROM part)"""
_HINT = "CASE " + " ".join(f"WHEN contains(lower(line), '{w}') THEN '{n}'" for w, n in X.HINTS) + " END"
_RX = lambda p: S.quoted(p.replace("(?i)", ""))
_SEV = S.lookup("severity", scoring.SEVERITY, 9)
_CAT = S.lookup("category", {c: i for i, c in enumerate(L.CATEGORY_ORDER)}, len(L.CATEGORY_ORDER))
ORACLES = {
    "claim_metadata": _W + f""", c AS (SELECT *, trim(CASE record_ord % 5 WHEN 0 THEN '[x]: ' || normalized_value WHEN 1 THEN 'Value: ' || normalized_value ELSE normalized_value END) AS v, lower(predicate) AS p, lower(matched_text) AS t, {_NAMED} AS named FROM claims),
f AS (SELECT *, {_FOCUS} AS focus_value, CASE WHEN source_type = 'github_file' THEN 'implementation' WHEN {_any("named || ' ' || p", N.SSOT)} THEN 'ssot' WHEN {_any("named || ' ' || p", N.GOVERNED)} THEN 'governed' WHEN {_any("named || ' ' || p", N.HISTORICAL)} THEN 'historical' ELSE 'working_doc' END AS governance_level,
  CASE WHEN {_any("named", N.HISTORICAL)} THEN 'historical' WHEN {_any("named", ('target', 'ssot', 'reference'))} THEN 'target' ELSE 'current' END AS temporal_status FROM c)
SELECT record_ord, focus_value, governance_level, temporal_status, split_part(subject_key, '.', 1) AS subject_root, CASE WHEN contains(subject_key, '.') THEN substr(subject_key, instr(subject_key, '.') + 1) ELSE predicate END AS property,
  CASE WHEN {_any("p", ('phase_count', 'question_count', 'label_count'))} THEN 'count_equals' WHEN contains(p, 'phase_order') THEN 'order_equals' WHEN contains(p, 'reference') THEN 'references' WHEN {_any("p", ('policy', 'approval'))} THEN CASE WHEN {_any("lower(focus_value)", N.FORBIDDING)} THEN 'forbids' ELSE 'requires' END WHEN {_any("p", ('implemented', 'documented', 'metamodel'))} THEN 'describes' ELSE 'states' END AS operator,
  CASE WHEN {_any("p", ('policy', 'approval', 'lifecycle', 'review_status', 'write', 'read'))} THEN focus_value ELSE '' END AS value_constraint, CASE WHEN {_any("p", ('count', 'order'))} THEN 'numeric' WHEN {_any("p", ('reference', 'label_count'))} THEN 'reference' WHEN {_any("p", ('policy', 'lifecycle', 'write', 'read'))} THEN 'constraint' ELSE 'text' END AS value_kind, {S.scope('subject_key')} AS scope_key,
  CASE WHEN governance_level IN ('ssot', 'governed', 'implementation') THEN governance_level WHEN governance_level = 'historical' OR temporal_status = 'historical' THEN 'historical' ELSE 'working_doc' END AS derived_authority,
  CASE WHEN {_any("named || ' ' || t", N.DEPRECATED)} THEN 'deprecated' WHEN {_any("t", N.NOT_SSOT)} THEN 'not_ssot' WHEN {_any("named || ' ' || t", N.SECONDARY)} THEN 'secondary_only' WHEN {_any("t", N.EXCLUDED)} AND NOT contains(t, 'not null') THEN 'excluded' ELSE 'asserted' END AS derived_status,
  {_cases([(n, _any("named || ' ' || lower(section_path) || ' ' || t", w)) for n, w in N.ROLES], "''")} AS path_role FROM f""",
    "domain_claim_metadata": _W + f""", s AS (SELECT *, lower(predicate) AS p, {_NAMED} || ' ' || source_id AS named, CASE WHEN regexp_matches(matched_text, {S.quoted(N.DOMAIN_DEPRECATED)}) THEN 'deprecated' WHEN regexp_matches(matched_text, {S.quoted(N.DOMAIN_NOT_SSOT)}) THEN 'not_ssot' WHEN regexp_matches(matched_text, {S.quoted(N.DOMAIN_NEGATION)}) THEN 'excluded' ELSE 'asserted' END AS domain_status FROM claims)
SELECT record_ord, domain_status, CASE WHEN source_type = 'metamodel' OR {_any("named", N.SSOT)} THEN 'ssot' WHEN {_any("named", N.GOVERNED)} THEN 'governed' WHEN {_any("named", N.HISTORICAL)} THEN 'historical' WHEN source_type = 'github_file' THEN 'implementation' ELSE 'working_doc' END AS domain_authority,
  CASE WHEN domain_status IN ('excluded', 'not_ssot') THEN 'forbids' WHEN {_any("p", ('status', 'lifecycle'))} THEN 'defines' WHEN {_any("p", ('hierarchy', 'chain', 'role'))} THEN 'describes' ELSE 'states' END AS domain_operator FROM s""",
    "path_groups": _PATHS_SQL + " SELECT * FROM g",
    "inferred_variants": _PATHS_SQL + f""", t AS (SELECT *, count(*) OVER w AS families, max(strength) OVER w AS top, min(strength) OVER w AS least FROM g WINDOW w AS (PARTITION BY subject_key)), p AS (SELECT * FROM t WHERE families > 1 AND top > least),
u AS (SELECT r.subject_key, r.family, count(DISTINCT r.normalized_value) AS n_unlike FROM r JOIN p USING (subject_key, family) WHERE p.strength < top AND NOT EXISTS (SELECT 1 FROM r q JOIN p o USING (subject_key, family) WHERE o.strength = o.top AND q.subject_key = r.subject_key AND q.normalized_value = r.normalized_value) GROUP BY ALL)
SELECT subject_key, family, strength, top AS primary_strength, n_unlike, {_any("lower(family)", N.NONCANONICAL)} AS noncanonical FROM p JOIN u USING (subject_key, family) WHERE strength < top""",
    "chain_variant_conflicts": _W + f", f AS (SELECT *, {_cases([(n, f'''contains(lower(normalized_value), '{w}')''') for n, w in CHAINS], 'NULL')} AS family FROM claims), g AS (SELECT family, count(*) AS n, count(DISTINCT normalized_value) AS n_variants, count(DISTINCT source_id) AS n_sources FROM f WHERE family IS NOT NULL GROUP BY 1) SELECT * FROM g WHERE (SELECT count(*) FROM g) > 1",
    "chain_breaks": _W + ", g AS (SELECT source_id || '/' || split_part(subject_key, '.', 1) AS chain, count(*) FILTER (WHERE predicate = 'write_contract') AS n_first, count(*) FILTER (WHERE predicate <> 'write_contract') AS n_second FROM claims WHERE predicate IN ('write_contract', 'approval_policy', 'lifecycle_state') GROUP BY 1) SELECT *, CASE WHEN n_first = 0 THEN 'first' ELSE 'second' END AS missing FROM g WHERE n_first = 0 OR n_second = 0",
    "architecture_observations": _W + " SELECT subject_key, count(DISTINCT source_id) AS n_sources, arg_min(predicate, record_ord) AS predicate, count(*) AS n FROM claims WHERE predicate IN ('write_contract', 'read_contract') GROUP BY 1 HAVING count(DISTINCT source_id) > 1",
    "supported_risks": _W + ", c AS (SELECT record_ord, source_id, predicate, split_part(subject_key, '.', 1) AS root FROM claims), i AS (SELECT source_id, root, count(*) AS n, count(DISTINCT predicate) AS np, min('fn' || (record_ord % 9)) AS fn FROM c WHERE predicate <> 'lifecycle_state' GROUP BY ALL) SELECT record_ord AS risk_id, coalesce(n, 0) AS n_support, coalesce(np, 0) AS n_predicates, fn AS function_name FROM c LEFT JOIN i USING (source_id, root) WHERE predicate = 'lifecycle_state'",
    "gap_kinds": _GAPS_SQL + " SELECT record_id, kind FROM k",
    "risk_findings": _GAPS_SQL + " SELECT CASE WHEN kind IN ('stock', 'import') THEN predicate || '|' || kind ELSE predicate || '|' || source_id || '|' || subject_key END AS finding_key, count(*) AS n, count(DISTINCT source_id) AS n_sources, count(DISTINCT subject_key) AS n_subjects, min(kind) AS kind FROM k GROUP BY 1",
    "package_states": _DECISIONS_SQL + ", l AS (SELECT package, arg_max(action, ord) AS action, count(*) AS n FROM dec GROUP BY 1) SELECT package, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'specify' THEN 'specified' ELSE 'open' END AS state, coalesce(n, 0) AS n_decisions FROM (SELECT DISTINCT package FROM mem) LEFT JOIN l USING (package)",
    "synced_facts": _DECISIONS_SQL + ", l AS (SELECT fact_key, arg_max(action, ord) AS action FROM dec JOIN mem USING (package) GROUP BY 1) SELECT fact_key, CASE action WHEN 'accept' THEN 'confirmed' WHEN 'specify' THEN 'confirmed' WHEN 'reject' THEN 'superseded' ELSE status END AS status, CASE WHEN action IS NOT NULL THEN 'package_decision' END AS status_source FROM fact LEFT JOIN l USING (fact_key)",
    "synced_packages": _DECISIONS_SQL + " SELECT package, count(*) FILTER (WHERE status = 'open') AS n_open, count(*) AS n_facts, count(*) FILTER (WHERE status = 'open') = 0 AS done FROM mem JOIN fact USING (fact_key) GROUP BY 1",
    "truth_confirm_conflicts": f"WITH {A.EVENT_TRUTHS_SQL}, n AS (SELECT 't' || user_id AS canonical_key, {A._pick_sql(A.VALUES[0], 'min(event_id)')} AS new_value FROM events GROUP BY user_id) SELECT truth_ord, canonical_key, normalized_value, new_value, normalized_value <> new_value AS differs FROM event_truths JOIN n USING (canonical_key) WHERE truth_status = 'active'",
    "clarifications": f"""WITH e AS (SELECT user_id % 300 AS thread_id, event_id AS ord, {A._pick_sql(KINDS, 'event_id')} AS kind FROM events WHERE user_id % 4 <> 0 OR event_id % 11 IN (0, 1, 2, 3)), g AS (SELECT thread_id, arg_min(kind, ord) FILTER (WHERE kind IN ('confirm', 'supersede', 'dismiss')) AS closed, count(*) FILTER (WHERE kind = 'answer') AS answers, count(*) FILTER (WHERE kind = 'capture') AS captured FROM e GROUP BY 1)
SELECT thread_id, CASE WHEN closed IS NOT NULL THEN closed WHEN answers > 0 THEN 'answered' ELSE 'open' END AS state, answers, least(captured, 10) AS messages, CASE WHEN captured > 0 THEN 0.8::DOUBLE END AS confidence FROM g""",
    "ticket_payloads": FINDINGS_SQL + """, f AS (SELECT source_id AS package, finding_ord, title, severity, object_key, row_number() OVER (PARTITION BY source_id ORDER BY finding_ord) AS nr FROM findings QUALIFY nr <= 4), o AS (SELECT package, object_key, min(nr) AS pos FROM f GROUP BY ALL)
SELECT package, '{"title":"' || max(title) FILTER (WHERE nr = 1) || '","severity":"' || max(severity) FILTER (WHERE nr = 1) || '","affected":["' || (SELECT string_agg(object_key, '","' ORDER BY pos) FROM o WHERE o.package = f.package) || '"],"n":' || count(*) || '}' AS payload FROM f GROUP BY package""",
    "page_patches": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '<h[1-6]>([^<]*)</h', 1) AS h FROM pages), q AS (SELECT *, CASE WHEN page_id % 3 = 0 OR h = '' THEN 'no such heading' ELSE h END AS heading, '<p>note ' || page_id || '</p>' AS ins, CASE WHEN page_id % 5 = 0 THEN left(html, 10) ELSE '<!--none-->' END AS marker FROM p), r AS (SELECT *, instr(html, '>' || heading || '</h') AS pos FROM q)
SELECT page_id, CASE WHEN contains(html, marker) THEN 'present' WHEN pos > 0 THEN 'inserted' ELSE 'appended' END AS mode, md5(CASE WHEN contains(html, marker) THEN html WHEN pos > 0 THEN left(html, pos + length(heading) + 5) || ins || substr(html, pos + length(heading) + 6) ELSE html || ins END) AS md5 FROM r""",
    "findings_by_severity": FINDINGS_SQL + f" SELECT finding_ord, {_SEV} AS k0, {_CAT} AS k1 FROM findings",
    "findings_by_category": FINDINGS_SQL + f" SELECT finding_ord, {_CAT} AS k0, {_SEV} AS k1 FROM findings WHERE category = 'policy_conflict'",
    "gold_order": FINDINGS_SQL + f" SELECT finding_ord, {S.lookup('category', L.GOLD_PRIORITY, 2)} AS priority, CASE WHEN finding_ord % 3 = 0 THEN 0 ELSE 1 END AS no_action, object_key AS key FROM findings",
    "load_order": FINDINGS_SQL + " SELECT finding_ord, severity FROM findings",
    "deduped_cards": FINDINGS_SQL + ", c AS (SELECT finding_ord AS ord, category || '|' || lower(title) || '|' || lower(source_id) || '|s' || (finding_ord % 3) AS k FROM findings) SELECT min(ord) AS ord, sha1(k) AS card_key FROM c GROUP BY k",
    "status_partitions": "WITH s(status, place) AS (VALUES ('F', 0), ('O', 1), ('X', 2), ('other', 3)), g AS (SELECT CASE WHEN o_orderstatus IN ('F', 'O', 'X') THEN o_orderstatus ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY 1) SELECT status, place, coalesce(n, 0) AS n FROM s LEFT JOIN g USING (status)",
    "folder_summary": "SELECT 'src/' || lower(p_brand) || CASE WHEN p_partkey % 2 = 0 THEN '/sub' ELSE '' END AS folder, count(*) AS files FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1 ORDER BY 1 LIMIT 30",
    "minimal_section_paths": _CHANGED_SQL + " SELECT * FROM minimal",
    "section_regeneration": _CHANGED_SQL + """, gone AS (SELECT DISTINCT source_id, lower(section_path) AS path FROM claims WHERE record_ord % 211 = 0 AND section_path = 'Top > Rules'), c AS (SELECT record_ord, source_id, CASE WHEN record_ord % 19 = 0 THEN '' ELSE lower(section_path) END AS path FROM claims)
SELECT record_ord, CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.source_id = c.source_id AND g.path = c.path) THEN 'drop' WHEN EXISTS (SELECT 1 FROM minimal m WHERE m.source_id = c.source_id AND (c.path = '' OR contains(' > ' || c.path || ' > ', ' > ' || m.path || ' > ') OR starts_with(m.path || ' > ', c.path || ' > '))) THEN 'regenerate' ELSE 'reuse' END AS action FROM c""",
    "fast_selection": f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS b, {A._pick_sql((*A.SOURCES, 'jira_ticket'), 'doc_id')} AS st, lower(doc_id || ' ' || {A._pick_sql(A.TITLES, 'doc_id')} || ' ' || {A._pick_sql(A.PATHS, 'doc_id')}) AS path FROM documents), u AS (SELECT *, {_any('b', SIGNALS)} AS sig FROM t)
SELECT doc_id FROM u WHERE doc_id % 50 = 0 OR st = 'metamodel' OR (st IN ('confluence_page', 'local_doc') AND sig) OR (st = 'github_file' AND (sig OR {_any('path', ('.puml', 'metamodel_export.json', 'current_dump.json', 'ssot', 'status', 'scope', 'run', 'pipeline'))}))""",
    "changed_pages": "SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 11 <> 0 AND page_id % 3 <> 0 THEN 'reuse' ELSE 'fetch' END AS action FROM pages",
    "access_state": f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 8 = 0 THEN page_id % 3 END AS r, {A._pick_sql(CLASSES, 'page_id // 2')} AS c, {A._pick_sql(PROP_KEYS, 'page_id')} AS k, lower({A._pick_sql(PROP_VALUES, 'page_id // 5')}) AS v, {A._pick_sql(LABELS, 'page_id // 25')} AS l FROM pages)
SELECT page_id, coalesce(CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN 'restricted' ELSE 'none' END END, CASE WHEN {_any('k', ('restriction', 'access', 'visibility', 'permission'))} THEN CASE WHEN {_any('v', ('restricted', 'private', 'internal', 'confidential', 'secret'))} THEN 'restricted' WHEN {_any('v', ('public', 'open', 'unrestricted'))} THEN 'none' END END, CASE WHEN {_any('l', ('restricted', 'private', 'confidential', 'secret'))} THEN 'restricted' END, 'unknown') AS restriction,
  coalesce(CASE WHEN c <> '' THEN CASE WHEN lower(c) IN ('restricted', 'confidential', 'secret', 'internal-sensitive') THEN 'restricted' ELSE 'standard' END END, CASE WHEN {_any('k', ('classification', 'sensitivity', 'data-class', 'security'))} THEN CASE WHEN {_any('v', ('restricted', 'confidential', 'secret', 'internal', 'sensitive', 'pii', 'gdpr'))} THEN 'restricted' WHEN {_any('v', ('standard', 'public', 'open'))} THEN 'standard' END END, CASE WHEN {_any('l', ('confidential', 'restricted', 'secret', 'sensitive', 'pii', 'gdpr'))} THEN 'restricted' WHEN {_any('l', ('public', 'standard', 'open'))} THEN 'standard' END, 'unknown') AS sensitivity FROM p""",
    "matched_segments": _MATCH_SQL + " SELECT * FROM m",
    "delta_insights": _MATCH_SQL + ", g2 AS (SELECT finding_id, count(*) AS n_segments, list_sort(list_distinct(list(delta_status) FILTER (WHERE delta_status <> 'unchanged'))) AS k, count(*) FILTER (WHERE delta_status = 'changed') AS n_changed, count(*) FILTER (WHERE delta_status = 'added') AS n_added FROM m JOIN seg USING (segment_id) GROUP BY 1) SELECT finding_id, n_segments, coalesce(array_to_string(k, '|'), '') AS statuses, n_changed, n_added, CASE coalesce(len(k), 0) WHEN 0 THEN 'stable' WHEN 1 THEN k[1] ELSE 'mixed' END AS signal FROM g2",
    "finding_seeds": FINDINGS_SQL + ", f AS (SELECT finding_ord AS finding_id, CASE WHEN finding_ord % 2 = 0 THEN split_part(object_key, '.', 1) ELSE object_key END AS k, CASE WHEN finding_ord % 7 = 0 THEN 'n' || source_id END AS node FROM findings), c AS (SELECT DISTINCT subject_key, 'n' || source_id AS node FROM claims WHERE record_ord % 3 = 0) SELECT finding_id, node FROM f WHERE node IS NOT NULL UNION SELECT finding_id, c.node FROM f JOIN c ON subject_key = k OR starts_with(subject_key, k || '.') WHERE f.node IS NULL",
    "metaclasses": _MODEL_SQL + " SELECT id, coalesce(nullif(name, ''), nullif(public_id, ''), id) AS name, coalesce((SELECT string_agg(DISTINCT coalesce(nullif(p.name, ''), p.public_id), '|' ORDER BY coalesce(nullif(p.name, ''), p.public_id)) FROM edge JOIN node p ON p.id = src WHERE dst = n.id AND kind = 'CONTAINS' AND list_contains(p.labels, 'package')), '') AS packages, coalesce((SELECT string_agg(DISTINCT kind, '|' ORDER BY kind) FROM edge WHERE src = n.id), '') AS kinds FROM node n WHERE list_contains(labels, 'metaclass') ORDER BY 2, 1 LIMIT 250",
    "model_functions": _MODEL_SQL + ", r AS (SELECT dst, kind, coalesce(nullif(public_id, ''), nullif(name, ''), id) AS ref FROM edge JOIN node ON id = src WHERE list_has_any(labels, ['bsmQuestion', 'bsmPhase'])), g AS (SELECT dst, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, string_agg(DISTINCT ref, '|' ORDER BY ref) AS refs FROM r GROUP BY 1) SELECT id, coalesce(nullif(name, ''), nullif(public_id, ''), id) AS name, coalesce(kinds, '') AS kinds, coalesce(refs, '') AS refs FROM node LEFT JOIN g ON dst = id WHERE len(list_filter(labels, lambda x: ends_with(x, 'Function'))) > 0 ORDER BY 2, 1 LIMIT 250",
    "style_profile": r"WITH t AS (SELECT doc_id, '# 1. Part ' || (doc_id % 4) || chr(10) || '## Text' || chr(10) || coalesce(text, '') AS text FROM documents), f AS (SELECT text FROM t WHERE length(text) > 100 ORDER BY doc_id LIMIT 20), h AS (SELECT trim(regexp_replace(unnest(regexp_extract_all(text, '(?m)^#{1,3}\s+(.+)$', 1)), '[0-9.]+\s*', '', 'g')) AS heading FROM f) SELECT heading, count(*) AS n FROM h WHERE heading <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "extract_claims": _W + f""", l AS (SELECT record_ord // 512 AS doc_id, record_ord, title, record_ord % 100 = 0 AS head, row_number() OVER (PARTITION BY record_ord // 512 ORDER BY record_ord) AS line_no, CASE WHEN record_ord % 100 = 0 THEN '## ' || title ELSE '`' || split_part(subject_key, '.', 1) || '` ' || matched_text END AS line FROM claims),
s AS (SELECT *, {A._pick_sql((*A.SOURCES, 'jira_ticket'), 'doc_id')} AS source_type, CASE count(*) FILTER (WHERE head) OVER w WHEN 0 THEN NULL WHEN 1 THEN last_value(CASE WHEN head THEN title END IGNORE NULLS) OVER w ELSE first_value(CASE WHEN head THEN title END IGNORE NULLS) OVER w || ' > ' || last_value(CASE WHEN head THEN title END IGNORE NULLS) OVER w END AS section FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
x AS (SELECT *, CASE WHEN source_type = 'github_file' THEN 'implemented' ELSE 'documented' END AS prefix, coalesce(nullif(regexp_extract(line, '`([A-Za-z][A-Za-z0-9_.-]{{2,}})`', 1), ''), {_HINT}, nullif(regexp_extract(line, '\\b([A-Z][A-Za-z0-9_]{{2,}})\\b', 1), ''), 'Doc') AS subject, CASE WHEN source_type = 'github_file' OR section IS NULL THEN 'Doc' ELSE 'Doc > ' || section END AS section_path FROM s WHERE source_type IN ('github_file', 'confluence_page', 'local_doc') AND (source_type = 'github_file' OR NOT head)),
e AS ({" UNION ALL ".join(f"SELECT doc_id, line_no, subject || '.{a}' AS subject_key, prefix || '_{n}' AS predicate, left(trim(regexp_replace(line, '\\s+', ' ', 'g')), 180) AS value, section_path FROM x WHERE regexp_matches(line, {_RX(p)}, 'i')" for a, n, p in X.ASPECTS)}
 UNION ALL SELECT doc_id, min(line_no), entity || '.role', 'metamodel_entity_exists', entity || ' is defined as a metaclass', 'metamodel_export:' || min(line_no) FROM s, (VALUES {", ".join(f"('{e}')" for e in ENTITIES)}) en(entity) WHERE source_type = 'metamodel' AND contains(line, entity) GROUP BY doc_id, entity)
SELECT doc_id, subject_key, predicate, value, CAST(min(line_no) AS INT) AS line_no, arg_min(section_path, line_no) AS section_path FROM e GROUP BY doc_id, subject_key, predicate, value""",
}
