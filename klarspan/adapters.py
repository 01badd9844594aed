"""The driver's tables as claims, segments, vectors, graphs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("github_file", "confluence_page", "local_doc", "metamodel")
AUTHORITIES = ("implementation", "working_doc", "ssot", "governed", "heuristic", "historical", "runtime_observation", "working_doc", "confirmed_decision")
STATUSES = ("asserted", "asserted", "asserted", "asserted", "asserted", "deprecated", "asserted", "secondary_only", "not_ssot", "asserted", "excluded")
TITLES = ("Target process", "Architecture notes", "legacy export", "Run contract", "notes", "Generated dump", "guardrail policy")
PATHS = ("src/app/service.py", "docs/process.md", "src/tests/mock_app.py", "wiki/space/page", "docs/archive/old.md")
FACETS = ("write_path", "policy", "lifecycle", "read_path")
PREDICATES = ("write_contract", "approval_policy", "lifecycle_state", "read_contract")
PROCESS_PREDICATES = ("phase_count", "phase_order", "question_count", "phase_reference")
VALUES = (
    ("approval required before write", "direct write without approval", "Read-Only", "save_update after review", "no direct persist", "global write", "tenant write gated"),
    ("approval required", "ungated", "review by tenant owner", "global policy", "no approval", "allowlist", "write allowed"),
    ("draft", "In Review", "approved", "archived", "released by service", "draft", "state unknown"),
    ("read only", "query via router", "fetch from wiki", "global read", "tenant read", "load", "none"),
)
PROCESS_VALUES = ("7 phases", "9 phases", "order: 3", "question count 12", "Phase: risk review", "phase count = 7", "unknown")
LITERAL_TRUTHS = (
    # truth_ord, canonical_key, subject_key, predicate, normalized_value, truth_status, source_kind, pending
    (1, "t1", "NATION_1_0", "write_contract", "approval required before write", "active", "user_specification", True),
    (2, "t2", "NATION_1_0.write_path", "write_contract", "read only", "superseded", "user_specification", False),
    (3, "t3", "NATION_7_1.policy", "approval_policy", "approval required", "active", "user_acceptance", False),
    (4, "t4", "BSM.process", "phase_count", "7 phases", "active", "user_specification", True),
    (5, "t5", "NATION_12_2.lifecycle", "lifecycle_state", "approved", "active", "system_inference", False),
    (6, "t6", "NATION_3_1", "write_contract", "approval required", "active", "user_specification", True),
    (7, "t7", "NATION_4_0.policy", "approval_policy", "ungated", "active", "user_acceptance", False),
)
TRUTH_COLUMNS = "truth_ord int, canonical_key string, subject_key string, predicate string, normalized_value string, truth_status string, source_kind string, pending_delta_recalculation boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, key):
    """values[key % len(values)]"""
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim an order: its customer's nation and priority make the subject, its key source and value."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    facet = level - 1
    process = level == 5
    named = F.upper(F.regexp_replace("n_name", " ", "_"))
    place = F.concat(named, F.lit("_"), (cust % 3).cast("string"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)  # 25 nations
    joined = joined.withColumn("subject_key", F.when(process, F.when(cust % 4 == 0, F.lit("BSM.process")).otherwise(F.concat(F.lit("BSM.phase."), F.lower(named), F.when(cust % 4 == 1, F.concat(F.lit(".question.q"), (cust % 5).cast("string"))).otherwise(F.lit(""))))).otherwise(F.concat(place, F.lit("."), pick(FACETS, facet))))
    seed = cust % 11 + F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    value = pick(PROCESS_VALUES, seed)
    for i, own in enumerate(VALUES):
        value = F.when(facet == i, pick(own, seed)).otherwise(value)
    predicate = F.when(process, pick(PROCESS_PREDICATES, cust)).otherwise(pick(PREDICATES, facet))
    out = joined.select(
        key.alias("record_ord"), F.concat(F.lit("c"), key.cast("string")).alias("claim_id"), "subject_key", predicate.alias("predicate"), value.alias("normalized_value"),
        pick(SOURCES, key).alias("source_type"), F.concat(F.lit("s"), (cust % 50).cast("string")).alias("source_id"), pick(AUTHORITIES, key).alias("source_authority"), pick(STATUSES, key).alias("assertion_status"),
        pick(TITLES, cust).alias("title"), pick(PATHS, key).alias("path_hint"), pick(("governed", "", "ssot"), cust).alias("governance"), pick(("current", "historic", "", "current"), cust).alias("temporal"),
        (1 + key % 40).cast("int").alias("line"), F.concat(F.lit("Top > "), pick(("Flow", "Rules", "Flow > Detail"), cust)).alias("section_path"),
        F.concat_ws(" ", "o_orderpriority", value, "o_orderstatus").alias("matched_text"), F.round(0.5 + (key % 50) / 100.0, 2).alias("confidence"),
    )
    return out.withColumn("fingerprint", F.md5(F.concat_ws("|", "subject_key", "predicate", "normalized_value", "source_id")))


def previous_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run before: some claims were not there yet, some had another value."""
    now = claims(spark, sf_dir).where("record_ord % 7 <> 0")
    value = F.when(F.col("record_ord") % 5 == 0, F.lit("draft")).when(F.col("record_ord") % 13 == 0, F.lit("no approval")).otherwise(F.col("normalized_value"))
    return now.withColumn("normalized_value", value).withColumn("fingerprint", F.md5(F.concat_ws("|", "subject_key", "predicate", "normalized_value", "source_id")))


def truths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LITERAL_TRUTHS), TRUTH_COLUMNS)


def event_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths stated by events: the last event of a user states one on a subject of that user's nation."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("k"), F.count("*").alias("n"))
    k = F.col("k")
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("nk"), F.upper(F.regexp_replace("n_name", " ", "_")).alias("named"))
    rows = last.join(F.broadcast(nation), u % 25 == F.col("nk"))  # 25 nations
    subject = F.concat("named", F.lit("_"), (k % 3).cast("string"), F.lit("."), pick(FACETS, k))
    return rows.select(k.cast("int").alias("truth_ord"), F.concat(F.lit("t"), u.cast("string")).alias("canonical_key"), subject.alias("subject_key"), pick(PREDICATES, k).alias("predicate"), pick(VALUES[0], k).alias("normalized_value"), pick(("active", "active", "superseded", "active", "rejected"), k).alias("truth_status"), pick(("user_specification", "user_acceptance", "system_inference"), u).alias("source_kind"), (F.col("n") % 7 == 0).alias("pending_delta_recalculation"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick_sql(values, key: str) -> str:
    return f"{_list(values)}[CAST(({key}) % {len(values)} AS INT) + 1]"


_SEED = "(o_custkey % 11 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)"
_LEVEL = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
#: DuckDB CTEs (without WITH) of the same views.
CLAIMS_SQL = f"""
claims0 AS (SELECT o_orderkey AS record_ord, 'c' || o_orderkey AS claim_id,
  CASE WHEN {_LEVEL} = 5 THEN CASE WHEN o_custkey % 4 = 0 THEN 'BSM.process' ELSE 'BSM.phase.' || lower(upper(replace(n_name, ' ', '_'))) || CASE WHEN o_custkey % 4 = 1 THEN '.question.q' || (o_custkey % 5) ELSE '' END END
    ELSE upper(replace(n_name, ' ', '_')) || '_' || (o_custkey % 3) || '.' || {_pick_sql(FACETS, f"{_LEVEL} - 1")} END AS subject_key,
  CASE WHEN {_LEVEL} = 5 THEN {_pick_sql(PROCESS_PREDICATES, "o_custkey")} ELSE {_pick_sql(PREDICATES, f"{_LEVEL} - 1")} END AS predicate,
  CASE {" ".join(f"WHEN {_LEVEL} = {i + 1} THEN {_pick_sql(v, _SEED)}" for i, v in enumerate(VALUES))} ELSE {_pick_sql(PROCESS_VALUES, _SEED)} END AS normalized_value,
  {_pick_sql(SOURCES, "o_orderkey")} AS source_type, 's' || (o_custkey % 50) AS source_id, {_pick_sql(AUTHORITIES, "o_orderkey")} AS source_authority, {_pick_sql(STATUSES, "o_orderkey")} AS assertion_status,
  {_pick_sql(TITLES, "o_custkey")} AS title, {_pick_sql(PATHS, "o_orderkey")} AS path_hint, {_pick_sql(("governed", "", "ssot"), "o_custkey")} AS governance, {_pick_sql(("current", "historic", "", "current"), "o_custkey")} AS temporal,
  CAST(1 + o_orderkey % 40 AS INT) AS line, 'Top > ' || {_pick_sql(("Flow", "Rules", "Flow > Detail"), "o_custkey")} AS section_path, o_orderpriority, o_orderstatus, round(0.5 + (o_orderkey % 50) / 100.0, 2)::DOUBLE AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
claims AS (SELECT * EXCLUDE (o_orderpriority, o_orderstatus), o_orderpriority || ' ' || normalized_value || ' ' || o_orderstatus AS matched_text, md5(subject_key || '|' || predicate || '|' || normalized_value || '|' || source_id) AS fingerprint FROM claims0),
previous0 AS (SELECT * REPLACE (CASE WHEN record_ord % 5 = 0 THEN 'draft' WHEN record_ord % 13 = 0 THEN 'no approval' ELSE normalized_value END AS normalized_value) FROM claims WHERE record_ord % 7 <> 0),
previous AS (SELECT * REPLACE (md5(subject_key || '|' || predicate || '|' || normalized_value || '|' || source_id) AS fingerprint) FROM previous0),
truths(truth_ord, canonical_key, subject_key, predicate, normalized_value, truth_status, source_kind, pending_delta_recalculation) AS (VALUES {", ".join(str(t) for t in LITERAL_TRUTHS)})"""

EVENT_TRUTHS_SQL = f"""event_last AS (SELECT user_id, max(event_id) AS k, count(*) AS n FROM events GROUP BY 1),
event_truths AS (SELECT CAST(k AS INT) AS truth_ord, 't' || user_id AS canonical_key, upper(replace(n_name, ' ', '_')) || '_' || (k % 3) || '.' || {_pick_sql(FACETS, "k")} AS subject_key, {_pick_sql(PREDICATES, "k")} AS predicate, {_pick_sql(VALUES[0], "k")} AS normalized_value,
  {_pick_sql(("active", "active", "superseded", "active", "rejected"), "k")} AS truth_status, {_pick_sql(("user_specification", "user_acceptance", "system_inference"), "user_id")} AS source_kind, n % 7 = 0 AS pending_delta_recalculation FROM event_last JOIN nation ON user_id % 25 = n_nationkey)"""
