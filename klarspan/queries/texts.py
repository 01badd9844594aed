"""Extraction, scans and runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import text
from klarspan.operators import claims as C
from klarspan.operators import extraction as X
from klarspan.operators import index as I
from klarspan.operators import retrieval as T
from klarspan.operators.graph import kept
from klarspan.plans import runs
from klarspan.queries import sql as S
from klarspan.sources import readers
from klarspan.streaming import deltas


def _line_docs(spark, d):
    """A document a source: its claims as lines, or as a heading where the key is a hundred's multiple."""
    c = A.claims(spark, d)
    line = F.when(F.col("record_ord") % 100 == 0, F.concat(F.lit("# "), "title")).otherwise(F.concat(F.lit("`"), F.substring_index("subject_key", ".", 1), F.lit("` "), "matched_text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("record_ord", line.alias("line")))), lambda x: x["line"])
    return c.groupBy("source_id").agg(F.array_join(lines, "\n").alias("text")).select(F.col("source_id").alias("doc_id"), F.lit("Doc").alias("title"), "text")


def document_claims(spark, d):
    return X.line_claims(X.sectioned_lines(_line_docs(spark, d)), "documented", F.col("title"))


def domain_value_conflicts(spark, d):
    return X.value_conflicts(A.claims(spark, d))


def role_conflicts(spark, d):
    return X.role_conflicts(A.claims(spark, d))


def documentation_gaps(spark, d):
    return X.documentation_gaps(A.claims(spark, d).withColumn("subject_key", F.concat_ws(".", "source_id", "predicate", "normalized_value")))


def _events(spark, d):
    e = A.table(spark, d, "events")
    return e.select(F.concat(F.lit("f"), (F.col("user_id") % 60).cast("string")).alias("source_id"), F.concat(F.lit("fn"), (F.col("event_id") % 9).cast("string")).alias("func"), (F.col("event_id") % 900).cast("int").alias("line"), A.pick(("entity", "write", "persist", "enqueue", "call"), F.col("event_id") / 7).alias("kind"))


def near_lines(spark, d):
    return X.near_lines(_events(spark, d).select("source_id", "kind", "line").distinct()).distinct()


def sequence_risks(spark, d):
    return X.sequence_risks(_events(spark, d))


def page_text(spark, d):
    t = readers.markup_text(F.col("html"))
    return A.table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("md5"))


def page_blocks(spark, d):
    return readers.page_blocks(A.table(spark, d, "pages")).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def page_section_delta(spark, d):
    blocks = readers.page_blocks(A.table(spark, d, "pages"))
    before = blocks.where("ordinal % 17 <> 5")
    return readers.section_delta(readers.section_digests(blocks), readers.section_digests(before))


def text_segments(spark, d):
    s = T.segments(A.table(spark, d, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("longest"))


def label_summary(spark, d):
    p = A.table(spark, d, "part").select(F.concat_ws(",", "p_brand", F.substring_index("p_type", " ", 1)).alias("label"))
    return readers.label_summary(p)


def phases_with_questions(spark, d):
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    phases = r.select(F.lit("phase").alias("entity_kind"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"), F.lit("").alias("phase_id"), F.lit("").alias("question"))
    questions = n.where("n_regionkey <> 2").select(F.lit("question").alias("entity_kind"), F.lit("").alias("id"), F.lit("").alias("name"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").cast("string").alias("phase_id"), F.col("n_name").alias("question"))
    return readers.phases_with_questions(phases.union(questions))


def deep_run(spark, d):
    r = runs.deep_run(A.claims(spark, d), A.truths(spark))
    return r.packages.select("cluster", "assigned", "severity_rank", "n_findings")


def delta_run(spark, d):
    before = runs.deep_run(A.previous_claims(spark, d), A.truths(spark)).findings
    now = A.claims(spark, d)
    r = runs.delta_run(now, C.deduplicated(A.previous_claims(spark, d)), before, A.truths(spark))
    return r.findings.groupBy("category", "severity").agg(F.count("*").alias("n"))


def event_windows(spark, d):
    return deltas.event_windows(A.table(spark, d, "events"))


def conversation_keywords(spark, d):
    t = A.table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.array_join(text.keywords(F.col("text"), 6), "|").alias("words"))


INDEX_FIELDS = {"title": "role", "content": "text"}


def _turns(spark, d, before=False):
    """Turns as segments of their conversations; before, some had another text, some were missing, some were there."""
    t, conv = A.table(spark, d, "conversations"), F.col("conv_id")
    if before:
        more = t.where(conv % 13 == 0).withColumn("turn", F.col("turn") + 1000)
        t = t.where(conv % 11 != 0).withColumn("text", F.when(conv % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" formerly"))).otherwise(F.col("text"))).unionByName(more)
    return t.select(F.concat_ws(":", conv.cast("string"), F.col("turn").cast("string")).alias("segment_id"), conv.cast("string").alias("source_id"), F.md5(F.coalesce("text", F.lit(""))).alias("segment_hash"), "role", "text")


def _index(spark, d):
    before, now = _turns(spark, d, True), kept(_turns(spark, d))
    delta = kept(I.segment_delta(now, before))
    return now, delta, I.update(I.build(before, INDEX_FIELDS), delta, now, INDEX_FIELDS)


def index_delta(spark, d):
    """What changed among segments, and the maintained index's postings of each kind."""
    _, delta, index = _index(spark, d)
    sums = index.groupBy("segment_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tf"))
    return delta.join(sums, "segment_id", "left").groupBy("status").agg(F.count("*").alias("n_segments"), F.coalesce(F.sum("terms"), F.lit(0)).alias("n_terms"), F.coalesce(F.sum("tf"), F.lit(0.0)).alias("weight"))


def index_search(spark, d):
    """The best turns for each benchmark text, from the maintained index."""
    now, _, index = _index(spark, d)
    return I.search(index, A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), now.count()).select("query_id", "segment_id", "bm25")


QUERIES = {f.__name__: f for f in (document_claims, domain_value_conflicts, role_conflicts, documentation_gaps, near_lines, sequence_risks, page_text, page_blocks, page_section_delta, text_segments, label_summary, phases_with_questions, deep_run, delta_run, event_windows, conversation_keywords, index_delta, index_search)}
_WITH = f"WITH {A.CLAIMS_SQL}"
_RX = lambda p: S.quoted(p.replace("(?i)", ""))
_CONCEPT = "predicate"
for _p in X.CONCEPT_PREFIXES:
    _CONCEPT = f"regexp_replace({_CONCEPT}, '^{_p}', '')"
_HINT = "CASE " + " ".join(f"WHEN contains(lower(line), '{w}') THEN '{n}'" for w, n in X.HINTS) + " END"
_EVENTS = f"e AS (SELECT 'f' || (user_id % 60) AS source_id, 'fn' || (event_id % 9) AS func, CAST(event_id % 900 AS INT) AS line, {A._pick_sql(('entity', 'write', 'persist', 'enqueue', 'call'), 'event_id // 7')} AS kind FROM events)"
_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{3,}'), lambda w: w NOT IN (" + ", ".join(map(S.quoted, text.STOPWORDS)) + "))"
_INDEX = f"""WITH seg AS (SELECT conv_id || ':' || turn AS segment_id, * FROM conversations), was AS (SELECT conv_id || ':' || turn AS segment_id, conv_id FROM conversations WHERE conv_id % 11 <> 0 UNION ALL SELECT conv_id || ':' || (turn + 1000), conv_id FROM conversations WHERE conv_id % 13 = 0),
term AS (SELECT segment_id, unnest(regexp_extract_all(lower(role), '[a-z0-9_]{{2,}}')) AS term, 4.0::DOUBLE AS w FROM seg UNION ALL SELECT segment_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}')), 1.0::DOUBLE FROM seg),
posted AS (SELECT segment_id, term, sum(w) AS tf, count(*) AS n FROM term GROUP BY ALL)"""
ORACLES = {
    "index_delta": _INDEX + """, d AS (SELECT coalesce(s.segment_id, w.segment_id) AS segment_id, CASE WHEN w.conv_id IS NULL THEN 'added' WHEN s.conv_id IS NULL THEN 'removed' WHEN s.conv_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM seg s FULL JOIN was w ON s.segment_id = w.segment_id),
p AS (SELECT segment_id, count(*) AS terms, sum(tf) AS tf FROM posted GROUP BY 1) SELECT status, count(*) AS n_segments, CAST(coalesce(sum(terms), 0) AS BIGINT) AS n_terms, coalesce(sum(tf), 0.0) AS weight FROM d LEFT JOIN p USING (segment_id) GROUP BY 1""",
    "index_search": _INDEX + f""", q0 AS (SELECT item_id AS query_id, {_WORDS} AS ws FROM benchmark), q AS (SELECT query_id, unnest(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:8]) AS term FROM q0),
len AS (SELECT segment_id, sum(n) AS len FROM posted GROUP BY 1), tot AS (SELECT sum(len) AS al, (SELECT count(*) FROM seg) AS ns FROM len), df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
s AS (SELECT query_id, segment_id, round(sum(greatest(1e-6, ln((ns - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len * ns / al))), 6) AS b FROM q JOIN posted USING (term) JOIN df USING (term) JOIN len USING (segment_id), tot GROUP BY query_id, segment_id)
SELECT query_id, segment_id, b AS bm25 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b DESC, segment_id) <= 8""",
    "document_claims": _WITH + f""", l AS (SELECT source_id AS doc_id, record_ord, title, record_ord % 100 = 0 AS head, row_number() OVER (PARTITION BY source_id ORDER BY record_ord) AS line_no, '`' || split_part(subject_key, '.', 1) || '` ' || matched_text AS line FROM claims),
s AS (SELECT *, last_value(CASE WHEN head THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l),
x AS (SELECT *, coalesce(nullif(regexp_extract(line, '`([A-Za-z][A-Za-z0-9_.-]{{2,}})`', 1), ''), {_HINT}, nullif(regexp_extract(line, '\\b([A-Z][A-Za-z0-9_]{{2,}})\\b', 1), ''), 'Doc') AS subject FROM s WHERE NOT head)
{" UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS INT) AS line_no, subject || '.{a}' AS subject_key, 'documented_{n}' AS predicate, left(trim(regexp_replace(line, '\\s+', ' ', 'g')), 180) AS value, CASE WHEN section IS NULL THEN 'Doc' ELSE 'Doc > ' || section END AS section_path FROM x WHERE regexp_matches(line, {_RX(p)}, 'i')" for a, n, p in X.ASPECTS)}""",
    "domain_value_conflicts": _WITH + f""", c AS (SELECT *, replace({_CONCEPT}, 'allowlist_', '') AS concept, upper(trim(normalized_value)) AS value, {S.lookup('source_authority', X.RECORD_WEIGHT, 10)} * CASE WHEN assertion_status IN ('deprecated', 'secondary_only', 'not_ssot') THEN 7 ELSE 10 END AS w FROM claims WHERE subject_key IN (SELECT subject_key FROM claims GROUP BY 1 HAVING count(DISTINCT source_id) >= 2)),
v AS (SELECT subject_key, concept, value, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n FROM c GROUP BY ALL)
SELECT subject_key, concept, arg_max(value, (weight, n, value)) AS majority, max(weight) AS weight, count(*) AS n_values FROM v GROUP BY subject_key, concept HAVING count(*) > 1""",
    "role_conflicts": _WITH + f""", c AS (SELECT *, source_type = 'metamodel' AS ex, {S.contains_any('lower(normalized_value)', X.NEGATIVE)} AS ng, {S.contains_any('lower(normalized_value)', X.POSITIVE)} AS ps FROM claims),
g AS (SELECT subject_key, count(DISTINCT source_id) AS n_sources, count(*) FILTER (WHERE NOT ex AND ng) AS negative, count(*) FILTER (WHERE ex OR (NOT ng AND ps)) AS positive FROM c GROUP BY 1) SELECT * FROM g WHERE n_sources >= 2 AND negative > 0 AND positive > 0""",
    "documentation_gaps": _WITH + """, k AS (SELECT * REPLACE (source_id || '.' || predicate || '.' || normalized_value AS subject_key) FROM claims), u AS (SELECT *, split_part(subject_key, '.', 1) AS root FROM k WHERE source_authority <> 'historical' AND assertion_status <> 'secondary_only'), docs AS (SELECT * FROM u WHERE source_type <> 'github_file'),
code AS (SELECT *, root IN (SELECT root FROM docs) AS known FROM u WHERE source_type = 'github_file' AND subject_key NOT IN (SELECT subject_key FROM docs)),
g AS (SELECT CASE WHEN known AND subject_key <> root THEN subject_key ELSE root END AS scope, count(*) AS n_claims, CASE WHEN bool_or(regexp_matches(predicate, 'policy|approval')) THEN 'policy' WHEN bool_or(regexp_matches(predicate, 'lifecycle|review_status')) THEN 'lifecycle' WHEN bool_or(starts_with(subject_key, 'BSM.phase') OR starts_with(subject_key, 'BSM.process')) THEN 'process' ELSE 'entity' END AS gap_type, bool_or(known) AS root_documented FROM code GROUP BY 1)
SELECT * FROM g WHERE n_claims >= CASE WHEN contains(scope, '.') AND root_documented THEN 1 ELSE 2 END""",
    "near_lines": f"WITH {_EVENTS} SELECT DISTINCT a.source_id, a.line AS entity_line, b.line AS write_line FROM e a JOIN e b USING (source_id) WHERE a.kind = 'entity' AND b.kind = 'write' AND b.line - a.line BETWEEN -1 AND 24",
    "sequence_risks": f"WITH {_EVENTS}, g AS (SELECT source_id, func, min(line) FILTER (WHERE kind = 'persist') AS persist, max(line) FILTER (WHERE kind = 'enqueue') AS enqueue FROM e GROUP BY ALL) SELECT * FROM g WHERE persist < enqueue",
    "label_summary": "WITH l AS (SELECT unnest([p_brand, split_part(p_type, ' ', 1)]) AS label FROM part) SELECT label, count(*) AS n FROM l WHERE label <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT 40",
    "phases_with_questions": "SELECT CAST(r_regionkey AS VARCHAR) AS phase_id, r_name AS name, r_regionkey AS ord, coalesce(string_agg(n_name, '|' ORDER BY n_nationkey), '') AS questions, count(n_name) AS n_questions FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_regionkey <> 2 GROUP BY r_regionkey, r_name",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "conversation_keywords": "WITH w AS (SELECT conv_id, turn, " + _WORDS + " AS ws FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:6], '|') AS words FROM w",
}
