"""Consensus, deltas, truths and rules over the claims of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import scoring, semantics, text
from klarspan.operators import claims as C
from klarspan.operators import rules as R
from klarspan.queries import sql as S

_WITH = f"WITH RECURSIVE {A.CLAIMS_SQL},\n"
#: Claims with normal form n, tags t, bucket b and weight w.
_TAGGED = _WITH + f"""first AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY record_ord) = 1),
formed AS (SELECT *, {S.norm('normalized_value')} AS n FROM first),
tagged AS (SELECT *, {S.signature('subject_key', 'predicate', 'n')} AS t FROM formed),
votes AS (SELECT *, {S.bucket('t', 'n')} AS b, {S.weight(S.DESCRIPTOR)} AS w FROM tagged WHERE assertion_status <> 'secondary_only' AND trim(normalized_value) <> ''),
"""
_CONSENSUS = _TAGGED + f"""buckets AS (SELECT subject_key, predicate, b, sum(w) AS w, count(*) AS v, arg_min(normalized_value, record_ord) AS shown,
    bool_or(source_type <> 'github_file' AND source_authority <> 'historical') AS has_doc, bool_or(source_type = 'github_file') AS has_code FROM votes GROUP BY ALL),
best AS (SELECT subject_key, predicate, b, w, shown FROM buckets QUALIFY row_number() OVER (PARTITION BY subject_key, predicate ORDER BY w DESC, v DESC, b DESC) = 1),
aspect AS (SELECT subject_key, predicate, sum(w) AS total, sum(v) AS v, count(*) AS nb, bool_or(has_doc) AS has_doc, bool_or(has_code) AS has_code FROM buckets GROUP BY ALL HAVING sum(v) >= 2),
up AS (SELECT DISTINCT subject_key, predicate, unnest({S.ancestors('subject_key')}) AS ts FROM aspect),
target AS (SELECT up.subject_key, up.predicate, x.normalized_value AS truth_value FROM up JOIN truths x ON ts = x.subject_key AND up.predicate = x.predicate WHERE {S.EXPLICIT}
  QUALIFY row_number() OVER (PARTITION BY up.subject_key, up.predicate ORDER BY ts <> up.subject_key, truth_ord) = 1),
fixed AS (SELECT *, {S.norm('truth_value')} AS tn FROM target),
fixed2 AS (SELECT *, {S.signature('subject_key', 'predicate', 'tn')} AS tt FROM fixed),
fixed3 AS (SELECT subject_key, predicate, truth_value, {S.bucket('tt', 'tn')} AS tb FROM fixed2),
consensus AS (SELECT subject_key, predicate, coalesce(tb, best.b) AS target, coalesce(truth_value, shown) AS shown, CAST(CASE WHEN truth_value IS NOT NULL THEN 100 ELSE (100 * best.w) // total END AS BIGINT) AS percent, truth_value IS NOT NULL AS truth_fixed,
  CASE WHEN truth_value IS NOT NULL OR 2 * best.w > total THEN 'clear' WHEN nb > 1 THEN 'ambiguous' ELSE 'open' END AS kind,
  CASE WHEN has_code AND NOT has_doc THEN 'code_only' WHEN has_doc AND NOT has_code AND NOT ((subject_key = 'BSM.process' OR starts_with(subject_key, 'BSM.phase.')) AND predicate IN ('phase_count', 'phase_reference', 'phase_order', 'question_count', 'question_reference')) THEN 'doc_only' END AS gap, CAST(v AS BIGINT) AS votes
  FROM aspect JOIN best USING (subject_key, predicate) LEFT JOIN fixed3 USING (subject_key, predicate))
"""


def _first(spark, d):
    return C.deduplicated(A.claims(spark, d))


def consensus(spark, d):
    return C.consensus(_first(spark, d), A.truths(spark))


def consensus_deviation(spark, d):
    return C.deviations(_first(spark, d), A.truths(spark))


def consensus_top_buckets(spark, d):
    return C.top_buckets(_first(spark, d))


def consensus_confidence(spark, d):
    return consensus(spark, d).agg(F.count("*").alias("aspects"), F.count_if(F.col("kind") == "clear").alias("clear"), F.round(100.0 * F.count_if(F.col("kind") == "clear") / F.count("*"), 1).alias("percent"))


def claim_dedup(spark, d):
    return _first(spark, d).select("record_ord", "fingerprint", "subject_key")


def claim_scalars(spark, d):
    c = _first(spark, d)
    tags = semantics.signature(F.col("subject_key"), F.col("predicate"), F.col("normalized_value"))
    return c.select("record_ord", semantics.normalize_value(F.col("normalized_value")).alias("normal"), semantics.scope_key(F.col("subject_key")).alias("scope"), F.array_join(tags, "|").alias("tags"), semantics.bucket_of(tags, F.col("normalized_value")).alias("bucket"), scoring.entry_weight(F.col("source_type"), C.descriptor(), F.col("source_authority"), F.col("assertion_status")).alias("weight"))


def claim_filters(spark, d):
    c = A.claims(spark, d)
    return c.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(C.is_primary()).alias("n_primary"), F.count_if(C.counts_as_target()).alias("n_target"), F.count_if(F.col("assertion_status") != "secondary_only").alias("n_comparable"), F.count_if(F.length(F.trim("matched_text")) > 10).alias("n_embeddable"))


def claim_groups(spark, d):
    c = _first(spark, d).select("subject_key", "record_ord", "normalized_value")
    first = c.withColumn("place", F.row_number().over(Window.partitionBy("subject_key").orderBy("record_ord"))).where("place <= 3")
    shown = first.groupBy("subject_key").agg(F.array_sort(F.collect_list(F.struct("place", "normalized_value"))).alias("all"))  # three at most
    return c.groupBy("subject_key").agg(F.count("*").alias("n")).join(shown, "subject_key").select("subject_key", "n", F.array_join(F.transform("all", lambda x: x["normalized_value"]), "|").alias("evidence"))


def claim_delta(spark, d):
    return C.claim_delta(A.claims(spark, d), A.previous_claims(spark, d)).select("record_ord", "delta_status", "delta_change_type")


def impacted_scopes(spark, d):
    return C.impacted_scopes(C.claim_delta(A.claims(spark, d), A.previous_claims(spark, d)), A.truths(spark))


def incremental_claims(spark, d):
    """Claims to examine again: those of the model and of impacted scopes."""
    delta = C.claim_delta(A.claims(spark, d), A.previous_claims(spark, d))
    return C.in_scopes(A.claims(spark, d), C.impacted_scopes(delta, A.truths(spark))).select("record_ord", "source_type")


def snapshot_delta(spark, d):
    keys = ["source_type", "source_id", "subject_key"]
    hashed = lambda c: c.groupBy(*keys).agg(F.md5(F.array_join(F.array_sort(F.collect_list("fingerprint")), ",")).alias("content_hash"))
    return C.source_delta(hashed(A.claims(spark, d)), hashed(A.previous_claims(spark, d)), keys, "content_hash").select(*keys, "delta_status")


def truth_conflict(spark, d):
    return C.truth_conflicts(A.claims(spark, d), A.truths(spark))


def truth_scope_overlap(spark, d):
    """Active truths and the subjects whose scope overlaps theirs."""
    subjects = A.claims(spark, d).select("subject_key").distinct()
    down = subjects.select("subject_key", F.explode(text.ancestors(F.col("subject_key"))).alias("truth_subject"))
    up = A.truths(spark).where("truth_status = 'active'").select("canonical_key", F.col("subject_key").alias("truth_subject"))
    wide = up.select("canonical_key", F.explode(text.ancestors(F.col("truth_subject"))).alias("subject_key")).join(subjects, "subject_key")
    return down.join(up, "truth_subject").select("canonical_key", "subject_key").union(wide.select("canonical_key", "subject_key")).distinct()


def finding_rules(spark, d):
    return R.findings(A.claims(spark, d))


def value_conflicts(spark, d):
    """Whether documents and code conflict, for each subject that both speak of."""
    g = R.value_classes(A.claims(spark, d)).where("n_doc > 0 AND n_code > 0")
    return g.select("subject_key", R.sides_conflict(F.col("doc"), F.col("code")).alias("conflict"), F.size("doc").alias("doc_values"), F.size("code").alias("code_values"))


def truth_supersede(spark, d):
    """Slowly changing truths: each specification of a canonical key ends the one before it."""
    from pyspark.sql.window import Window

    spec = A.claims(spark, d).where("source_authority = 'confirmed_decision'").select(F.concat_ws(":", "subject_key", "predicate").alias("canonical_key"), "normalized_value", "record_ord")
    later = F.lead("record_ord").over(Window.partitionBy("canonical_key").orderBy("record_ord"))
    before = F.lag("record_ord").over(Window.partitionBy("canonical_key").orderBy("record_ord"))
    return spec.select("canonical_key", "record_ord", "normalized_value", F.when(later.isNull(), "active").otherwise("superseded").alias("truth_status"), before.alias("supersedes"))


_RULE_SIDE = "list(struct_pack(ord := ord, v := v, p := p, t := t) ORDER BY ord) FILTER (WHERE {})"
_SIDES = {"wiki": "source_type = 'confluence_page'", "localdoc": "source_type = 'local_doc'", "doc": "source_type IN ('confluence_page', 'local_doc')", "model": "source_type = 'metamodel'", "code": "source_type = 'github_file'"}


def _sides(a: str, b: str) -> str:
    """Pairs of values of two classes, seen with the first predicate of both, folded to a conflict a subject."""
    return f"""{a}_{b} AS (SELECT l.subject_key, bool_or({S.direct('l.t2', 'r.t2')}) OR (NOT bool_or({S.overlap('l.t2', 'r.t2')}) AND ((bool_or(len({S.meaningful('l.t2')}) > 0) AND bool_or(len({S.meaningful('r.t2')}) > 0)) OR NOT bool_or(l.v = r.v))) AS x
  FROM (SELECT c.*, {S.signature('c.subject_key', 'fp', 'c.n')} AS t2 FROM cls c JOIN firstp_{a}_{b} USING (subject_key) WHERE {_SIDES[a]}) l
  JOIN (SELECT c.*, {S.signature('c.subject_key', 'fp', 'c.n')} AS t2 FROM cls c JOIN firstp_{a}_{b} USING (subject_key) WHERE {_SIDES[b]}) r USING (subject_key) GROUP BY 1),"""


def _first_predicate(a: str, b: str) -> str:
    return f"""firstp_{a}_{b} AS (SELECT subject_key, coalesce(arg_min(p, ord) FILTER (WHERE {_SIDES[a]}), arg_min(p, ord) FILTER (WHERE {_SIDES[b]})) AS fp FROM cls GROUP BY 1),"""


def _inner(a: str) -> str:
    return f"""{a}_inner AS (SELECT l.subject_key, bool_or({S.direct('l.t', 'r.t')} OR (NOT {S.overlap('l.t', 'r.t')} AND ((len({S.meaningful('l.t')}) > 0 AND len({S.meaningful('r.t')}) > 0) OR l.v <> r.v))) AS x
  FROM (SELECT * FROM cls WHERE {_SIDES[a]}) l JOIN (SELECT a.*, b.p AS lp, {S.signature('a.subject_key', 'b.p', 'a.n')} AS t3, b.ord AS lord FROM cls a JOIN cls b USING (subject_key) WHERE a.ord > b.ord AND a.v <> b.v AND {_SIDES[a].replace('source_type', 'a.source_type')} AND {_SIDES[a].replace('source_type', 'b.source_type')}) r0 ON l.subject_key = r0.subject_key AND l.ord = r0.lord
  , LATERAL (SELECT r0.t3 AS t, r0.v AS v) r GROUP BY 1),"""


_CLASSES = _WITH + f"""part AS (SELECT subject_key, source_type, normalized_value AS v, predicate AS p, min(record_ord) AS ord, count(*) AS cn FROM claims WHERE {S.PRIMARY} GROUP BY ALL),
form AS (SELECT *, {S.norm('v')} AS n FROM part),
cls AS (SELECT *, {S.signature('subject_key', 'p', 'n')} AS t FROM form),
"""
_COUNTS = "counts AS (SELECT subject_key, " + ", ".join(f"coalesce(sum(cn) FILTER (WHERE {w}), 0) AS n_{k}" for k, w in _SIDES.items()) + " FROM cls GROUP BY 1)"
_PROC = "(subject_key = 'BSM.process' OR starts_with(subject_key, 'BSM.phase.') OR starts_with(subject_key, 'BSM.process.'))"
_POLICY = S.ends_any("subject_key", R.POLICY)
_RULES = {
    "B1": "n_wiki > 1 AND wiki_x", "B2": "wiki_local", "B3": "n_localdoc > 1 AND local_x", "B4": "model_doc", "B5": f"doc_code AND {_POLICY}", "B6": f"doc_code AND NOT {_POLICY}", "B7": f"{S.ends_any('subject_key', ('write_path', 'read_path'))} AND n_doc > 0 AND n_code = 0",
    "B8": f"{S.ends_any('subject_key', R.LIFECYCLE)} AND n_doc > 1 AND doc_x", "B9": f"{_POLICY} AND n_doc > 1 AND doc_x", "B12": f"{_PROC} AND n_doc > 1 AND doc_x",
    "B13": f"{_PROC} AND n_model > 0 AND n_doc = 0 AND n_code = 0 AND (NOT contains(subject_key, '.question.') OR ctx IN (SELECT ctx FROM runtime) OR 'BSM.process' IN (SELECT ctx FROM runtime))",
}
_DELTA = _WITH + f"""ident AS (SELECT DISTINCT source_type, source_id, subject_key, predicate, normalized_value AS pv, {S.norm('normalized_value')} AS pn FROM previous),
identt AS (SELECT *, {S.signature('subject_key', 'predicate', 'pn')} AS pt FROM ident),
form AS (SELECT *, {S.norm('normalized_value')} AS n FROM claims),
cur AS (SELECT *, {S.signature('subject_key', 'predicate', 'n')} AS t FROM form),
pair AS (SELECT record_ord, bool_or(NOT {S.direct('t', 'pt')} AND ({S.overlap('t', 'pt')} OR n = pn)) AS aligned FROM cur JOIN identt USING (source_type, source_id, subject_key, predicate) GROUP BY 1),
delta AS (SELECT c.*, CASE WHEN e.fingerprint IS NOT NULL THEN 'unchanged' WHEN aligned IS NULL THEN 'added' ELSE 'changed' END AS delta_status,
  CASE WHEN e.fingerprint IS NOT NULL THEN 'exact' WHEN aligned IS NULL THEN 'new_identity' WHEN aligned THEN 'textual_only' ELSE 'semantic' END AS delta_change_type
  FROM claims c LEFT JOIN (SELECT DISTINCT fingerprint FROM previous) e USING (fingerprint) LEFT JOIN pair USING (record_ord))"""
_SCOPE = S.scope("subject_key")

QUERIES = {f.__name__: f for f in (consensus, consensus_deviation, consensus_top_buckets, consensus_confidence, claim_dedup, claim_scalars, claim_filters, claim_groups, claim_delta, impacted_scopes, incremental_claims, snapshot_delta, truth_conflict, truth_scope_overlap, finding_rules, value_conflicts, truth_supersede)}
ORACLES = {
    "consensus": _CONSENSUS + "SELECT * FROM consensus",
    "consensus_deviation": _CONSENSUS + "SELECT v.subject_key, v.predicate, source_type, source_id, any_value(shown) AS target_value, string_agg(DISTINCT normalized_value, '|' ORDER BY normalized_value) AS deviating, CASE WHEN any_value(truth_fixed) THEN 'critical' ELSE 'high' END AS severity, count(*) AS n_claims FROM votes v JOIN consensus c USING (subject_key, predicate) WHERE kind = 'clear' AND b <> target GROUP BY ALL",
    "consensus_top_buckets": _TAGGED + "g AS (SELECT subject_key, predicate, b AS bucket, CAST(sum(w) AS BIGINT) AS weight, count(*) AS votes FROM votes GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY subject_key, predicate ORDER BY weight DESC, votes DESC, bucket) AS INT) AS place FROM g QUALIFY place <= 2",
    "consensus_confidence": _CONSENSUS + "SELECT count(*) AS aspects, count(*) FILTER (WHERE kind = 'clear') AS clear, round(100.0::DOUBLE * count(*) FILTER (WHERE kind = 'clear') / count(*), 1) AS percent FROM consensus",
    "claim_dedup": _WITH + "x AS (SELECT min(record_ord) AS record_ord, fingerprint, any_value(subject_key) AS subject_key FROM claims GROUP BY fingerprint) SELECT * FROM x",
    "claim_scalars": _TAGGED + f"x AS (SELECT record_ord, n AS normal, {_SCOPE} AS scope, array_to_string(t, '|') AS tags, {S.bucket('t', 'n')} AS bucket, CAST({S.weight(S.DESCRIPTOR)} AS INT) AS weight FROM tagged) SELECT * FROM x",
    "claim_filters": _WITH + f"x AS (SELECT source_type, count(*) AS n, count(*) FILTER (WHERE {S.PRIMARY}) AS n_primary, count(*) FILTER (WHERE source_authority <> 'historical' AND assertion_status <> 'secondary_only') AS n_target, count(*) FILTER (WHERE assertion_status <> 'secondary_only') AS n_comparable, count(*) FILTER (WHERE length(trim(matched_text)) > 10) AS n_embeddable FROM claims GROUP BY 1) SELECT * FROM x",
    "claim_groups": _TAGGED + "x AS (SELECT subject_key, count(*) AS n, array_to_string(list(normalized_value ORDER BY record_ord)[1:3], '|') AS evidence FROM first GROUP BY 1) SELECT * FROM x",
    "claim_delta": _DELTA + " SELECT record_ord, delta_status, delta_change_type FROM delta",
    "impacted_scopes": _DELTA + f" SELECT DISTINCT {_SCOPE} AS scope_key FROM delta WHERE delta_status = 'added' OR delta_change_type = 'semantic' UNION SELECT {_SCOPE} FROM truths WHERE {S.EXPLICIT} AND pending_delta_recalculation",
    "incremental_claims": _DELTA + f", scopes AS (SELECT {_SCOPE} AS k FROM delta WHERE delta_status = 'added' OR delta_change_type = 'semantic' UNION SELECT " + _SCOPE + f" FROM truths WHERE {S.EXPLICIT} AND pending_delta_recalculation) SELECT record_ord, source_type FROM claims WHERE source_type = 'metamodel' OR {_SCOPE} IN (SELECT k FROM scopes) OR subject_key IN (SELECT k FROM scopes)",
    "snapshot_delta": _WITH + "h AS (SELECT 1 AS now, * FROM claims UNION ALL SELECT 0, * FROM previous), g AS (SELECT source_type, source_id, subject_key, md5(string_agg(fingerprint, ',' ORDER BY fingerprint) FILTER (WHERE now = 1)) AS c, md5(string_agg(fingerprint, ',' ORDER BY fingerprint) FILTER (WHERE now = 0)) AS b FROM h GROUP BY ALL) SELECT source_type, source_id, subject_key, CASE WHEN b IS NULL THEN 'added' WHEN b = c THEN 'unchanged' ELSE 'changed' END AS delta_status FROM g WHERE c IS NOT NULL",
    "truth_conflict": _WITH + f"""near AS (SELECT c.*, x.canonical_key, x.normalized_value AS tv, {S.norm('c.normalized_value')} AS n, {S.norm('x.normalized_value')} AS tn FROM (SELECT *, unnest({S.ancestors('subject_key')}) AS ts FROM claims WHERE {S.PRIMARY}) c JOIN (SELECT * FROM truths WHERE {S.EXPLICIT}) x ON c.ts = x.subject_key),
tag AS (SELECT *, {S.signature('subject_key', 'predicate', 'n')} AS t, {S.signature('subject_key', 'predicate', 'tn')} AS tt FROM near)
SELECT canonical_key, source_type, source_id, count(*) AS n_claims, min(record_ord) AS first_ord, arg_min(normalized_value, record_ord) AS first_value FROM tag
WHERE {S.direct('t', 'tt')} OR (NOT {S.overlap('t', 'tt')} AND ((len({S.meaningful('t')}) > 0 AND len({S.meaningful('tt')}) > 0) OR normalized_value <> tv)) GROUP BY ALL""",
    "truth_scope_overlap": _WITH + "k AS (SELECT DISTINCT subject_key FROM claims) SELECT DISTINCT canonical_key, k.subject_key FROM k JOIN truths x ON k.subject_key = x.subject_key OR starts_with(k.subject_key, x.subject_key || '.') OR starts_with(x.subject_key, k.subject_key || '.') WHERE truth_status = 'active'",
    "finding_rules": _CLASSES + "\n".join([_first_predicate(a, b) + "\n" + _sides(a, b) for a, b in (("wiki", "localdoc"), ("model", "doc"), ("doc", "code"))] + [_inner(a) for a in ("wiki", "localdoc", "doc")]) + _COUNTS + f""",
flag AS (SELECT c.*, {_SCOPE} AS ctx, coalesce(a.x, false) AS wiki_local, coalesce(b.x, false) AS model_doc, coalesce(d.x, false) AS doc_code, coalesce(e.x, false) AS wiki_x, coalesce(f.x, false) AS local_x, coalesce(g.x, false) AS doc_x
  FROM counts c LEFT JOIN wiki_localdoc a USING (subject_key) LEFT JOIN model_doc b USING (subject_key) LEFT JOIN doc_code d USING (subject_key) LEFT JOIN wiki_inner e USING (subject_key) LEFT JOIN localdoc_inner f USING (subject_key) LEFT JOIN doc_inner g USING (subject_key)),
runtime AS (SELECT DISTINCT ctx FROM flag WHERE {_PROC} AND n_doc + n_code > 0)
{" UNION ALL ".join(f"SELECT subject_key, '{r}' AS rule, '{R.RULES[r][0]}' AS category, '{R.RULES[r][1]}' AS severity FROM flag WHERE {w}" for r, w in _RULES.items())}""",
    "value_conflicts": _CLASSES + _first_predicate("doc", "code") + _sides("doc", "code") + f"sizes AS (SELECT subject_key, count(*) FILTER (WHERE {_SIDES['doc']}) AS doc_values, count(*) FILTER (WHERE {_SIDES['code']}) AS code_values FROM cls GROUP BY 1) SELECT subject_key, x AS conflict, CAST(doc_values AS INT) AS doc_values, CAST(code_values AS INT) AS code_values FROM doc_code JOIN sizes USING (subject_key)",
    "truth_supersede": _WITH + "x AS (SELECT subject_key || ':' || predicate AS canonical_key, normalized_value, record_ord FROM claims WHERE source_authority = 'confirmed_decision') SELECT canonical_key, record_ord, normalized_value, CASE WHEN lead(record_ord) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS truth_status, lag(record_ord) OVER w AS supersedes FROM x WINDOW w AS (PARTITION BY canonical_key ORDER BY record_ord)",
}
