"""Risks in code and broken paths: files and paths made from the driver's parts, scanned, graded and matched."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.operators import breaks as B
from klarspan.operators import code_risks as R
from klarspan.operators import fragments as G
from klarspan.operators import scan as N
from klarspan.operators.graph import kept

#: Lines of a part's file; those with a condition stand only where the part's key fits it.
_LINES = (
    ("", "def {fn}_item(x):"), ("k % 2 = 0", "    save_item(x)"), ("k % 3 = 0", "    enqueue_job(x)"), ("", "def swap(x):"), ("k % 5 = 0", "    supersede_old(x)"), ("", "    rebuild_all(x)"), ("", "def take_answer(x):"), ("", "    manual = x"),
    ("k % 4 = 0", "    trace_id = x"), ("", "    store_row(lineitem)"), ("", "    upsert_all()"), ("", "def answer_schema():"), ("", "    output_schema = 1"), ("", "    x = ['price', 'size']"), ("k % 7 = 0", "    y = 'brand'"),
)
RULES = (("stock", ("inventory",), ("reserve",)), ("billing", ("ledger",), ("charge",)), ("import", ("feeds",), ()))
GROUPED = ("stock", "import")
ENTRIES = ("Lineitem.field_propagation",)


def _claims(spark, d):
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    lines = [F.when(F.expr(when), F.lit(line)).otherwise(F.lit("    pass")) if when else F.lit(line) for when, line in _LINES]
    name = F.when(F.col("k") % 7 == 0, "reserve").when(F.col("k") % 7 == 1, "charge").otherwise("load")
    folder = F.when(F.col("k") % 5 == 0, "inventory").when(F.col("k") % 5 == 1, "feeds").otherwise("other")
    files = p.select(F.concat(F.lit("src/"), folder, F.lit("/f"), F.col("k").cast("string")).alias("source_id"), F.replace(F.array_join(F.array(*lines), "\n"), F.lit("{fn}"), name).alias("text"))
    events = kept(N.code_events(files, {"lineitem": "Lineitem"}, r"\b(trace_id|run_id)\b\s*=", {"write": r"store_row", "output": r"'(price|size|brand)'"}))
    return kept(R.risk_claims(events, "trace_id", ("brand", "price", "size")))


def code_risk_findings(spark, d):
    """Findings over all files: async gaps by the user's families, early replacements, entry points, incomplete outputs."""
    claims = _claims(spark, d)
    return R.code_risks(R.risk_records(claims, RULES, ENTRIES), claims, GROUPED)


def code_risk_members(spark, d):
    claims = _claims(spark, d)
    return R.risk_members(R.risk_records(claims, RULES, ENTRIES), claims, GROUPED)


def _two_paths(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    step = lambda i, m: F.concat(F.lit("s"), ((k + i) % m).cast("string"))
    ends = F.when(k % 2 == 0, F.array(F.lit("start"), step(0, 3), F.lit("end"))).when(k % 3 == 0, F.array(F.lit("start"), step(0, 3))).otherwise(F.array(step(1, 3), F.lit("end")))
    other = F.when(k % 5 == 0, F.array(F.lit("start"), F.lit("end"))).when(k % 5 == 1, F.array(F.lit("start"), step(0, 3), step(1, 4), F.lit("end"))).when(k % 5 == 2, F.array(F.lit("end"))).when(k % 5 == 3, F.array(F.lit("start"))).otherwise(F.array(F.lit("begin"), step(0, 3), F.lit("stop")))
    return p.select("p_partkey", ends.alias("a"), other.alias("b"))


def divergence_modes(spark, d):
    """Documented against implemented paths: which side lacks what, and where."""
    x = _two_paths(spark, d).select("p_partkey", B.divergence(F.col("a"), F.col("b")).alias("x"))
    return x.select("p_partkey", "x.prefix", "x.suffix", "x.documented_at", "x.implemented_at", F.array_join("x.documented_gap", ">").alias("documented_gap"), F.array_join("x.implemented_gap", ">").alias("implemented_gap"), "x.rejoin_at", "x.mode")


def path_breaks(spark, d):
    """What observed paths lack of the expected ones; paths that lack nothing have no row."""
    return _two_paths(spark, d).select("p_partkey", B.path_break(F.col("b"), F.col("a")).alias("x")).where("x IS NOT NULL").select("p_partkey", "x.*")


def broken_chains(spark, d):
    """Chains of the graph queries in the code of each size of parts: every third size derives, supports, or does both."""
    p, k, size = A.table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    unit = (k % 7).cast("string")
    derives = F.concat(F.lit("    MATCH (s:Statement)-[:DERIVED_FROM]->(u:Unit"), unit, F.lit(")\n"))
    supports = F.lit("    MERGE (s:Statement)-[:SUPPORTS]->(e:Element)\n")
    body = F.concat(F.when(size % 3 != 1, derives).otherwise(""), F.when((size % 3 == 1) | ((size % 3 == 2) & (k % 2 == 0)), supports).otherwise(""))
    files = p.select(F.concat_ws("/", size.cast("string"), k.cast("string")).alias("source_id"), F.lit("a.py").alias("path"), F.concat(F.lit('def load(tx):\n    q = """\n'), body, F.lit('    """\n')).alias("text"))
    edges = kept(G.query_edges(G.query_fragments(files)))
    area = F.substring_index("source_id", "/", 1).cast("int").alias("area")
    walks = G.query_paths(edges.where(area % 2 == 0), ("DERIVED_FROM",))
    written = G.full_paths(walks, F.lit("Origin"), ("Unit0", "Unit1", "Unit2"))
    return B.broken_chains(edges.select(area, "source_id", "src", "type", "dst"), written.select(area, "path"), ["area"], "Statement", "DERIVED_FROM", "SUPPORTS", "Element", "Origin")


QUERIES = {f.__name__: f for f in (code_risk_findings, code_risk_members, divergence_modes, path_breaks, broken_chains)}
_PARTS = """p AS (SELECT p_partkey AS k, 'src/' || CASE p_partkey % 5 WHEN 0 THEN 'inventory' WHEN 1 THEN 'feeds' ELSE 'other' END || '/f' || p_partkey AS source_id,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'stock' WHEN p_partkey % 7 = 1 THEN 'billing' WHEN p_partkey % 5 = 1 THEN 'import' ELSE 'generic' END AS gap,
  CASE p_partkey % 7 WHEN 0 THEN 'reserve' WHEN 1 THEN 'charge' ELSE 'load' END || '_item' AS fn FROM part),
r AS (SELECT source_id, 'code_eventual_consistency_risk' AS predicate, 'TemporalConsistency.persist_then_enqueue' AS subject_key, gap AS kind, gap IN ('stock', 'import') AS grouped, fn, 'read_write_gap' AS category, 'high' AS severity, 1 AS n_support, CAST(NULL AS VARCHAR) AS missing_field, 'async_gap' AS break_mode, 'persist -> enqueue' AS observed, 'persist -> protected_reaggregation -> enqueue' AS expected, 'protected_reaggregation' AS missing, 'L2-L3' AS lines, CAST(2 AS INT) AS first_line, CAST(3 AS INT) AS last_line FROM p WHERE k % 6 = 0
  UNION ALL SELECT source_id, 'code_chain_interruption_risk', 'TemporalConsistency.supersede_then_rebuild', 'rebuild', true, 'swap', 'read_write_gap', 'high', 1, NULL, 'replacement_gap', 'supersede -> rebuild', 'supersede -> replacement_chain_available -> rebuild', 'replacement_chain_available', 'L5-L6', 5, 6 FROM p WHERE k % 5 = 0
  UNION ALL SELECT source_id, 'code_field_propagation_gap', 'Lineitem.field_propagation', 'entry_point', true, 'take_answer', 'legacy_path_gap', 'medium', 2, 'trace_id', NULL, NULL, NULL, NULL, NULL, 7, 7 FROM p WHERE k % 4 <> 0
  UNION ALL SELECT source_id, 'code_schema_missing_fields', 'Output.fields', NULL, false, NULL, 'implementation_drift', 'high', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k % 7 <> 0),
f AS (SELECT *, predicate || '|' || CASE WHEN grouped THEN subject_key || '|' || kind ELSE source_id || '|' || subject_key END AS finding_key FROM r)"""
_TWO = """p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['start', 's' || (p_partkey % 3), 'end'] WHEN p_partkey % 3 = 0 THEN ['start', 's' || (p_partkey % 3)] ELSE ['s' || ((p_partkey + 1) % 3), 'end'] END AS a,
  CASE p_partkey % 5 WHEN 0 THEN ['start', 'end'] WHEN 1 THEN ['start', 's' || (p_partkey % 3), 's' || ((p_partkey + 1) % 4), 'end'] WHEN 2 THEN ['end'] WHEN 3 THEN ['start'] ELSE ['begin', 's' || (p_partkey % 3), 'stop'] END AS b FROM part),
m AS (SELECT *, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS INT) AS pre, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: list_reverse(a)[1:i] = list_reverse(b)[1:i])) AS INT) AS suf FROM p),
g AS (SELECT *, CASE WHEN pre + suf < len(a) THEN a[pre + 1:len(a) - suf] ELSE [] END AS ga, CASE WHEN pre + suf < len(b) THEN b[pre + 1:len(b) - suf] ELSE [] END AS gb, CASE WHEN pre > 0 AND suf > 0 THEN 'internal' WHEN pre > 0 THEN 'tail' WHEN suf > 0 THEN 'prefix' ELSE 'full' END AS place FROM m)"""
ORACLES = {
    "code_risk_findings": f"""WITH {_PARTS} SELECT finding_key, any_value(predicate) AS predicate, any_value(subject_key) AS subject_key, any_value(kind) AS kind, any_value(category) AS category, any_value(severity) AS severity, count(*) AS n_records, count(DISTINCT source_id) AS n_sources, count(DISTINCT fn) AS n_functions, min(fn) AS function_name,
  CASE WHEN any_value(predicate) = 'code_eventual_consistency_risk' THEN greatest(count(*), count(DISTINCT fn)) ELSE count(*) END AS path_count, CAST(any_value(n_support) AS BIGINT) AS n_support, any_value(missing_field) AS missing_field, any_value(break_mode) AS break_mode, any_value(observed) AS observed, any_value(expected) AS expected, any_value(missing) AS missing, any_value(lines) AS lines, coalesce(any_value(kind) = 'entry_point', false) AS legacy_path_gap FROM f GROUP BY 1""",
    "code_risk_members": f"WITH {_PARTS} SELECT finding_key, source_id, fn AS function_name, first_line, last_line FROM f WHERE fn IS NOT NULL",
    "divergence_modes": f"""WITH {_TWO} SELECT p_partkey, pre AS prefix, suf AS suffix, a[pre + 1] AS documented_at, b[pre + 1] AS implemented_at, array_to_string(ga, '>') AS documented_gap, array_to_string(gb, '>') AS implemented_gap, CASE WHEN suf > 0 THEN a[len(a) - suf + 1] END AS rejoin_at,
  CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN place || '_substitution' WHEN len(ga) > 0 THEN 'implemented_' || place || '_gap' WHEN len(gb) > 0 THEN 'documented_' || place || '_gap' ELSE 'aligned' END AS mode FROM g""",
    "path_breaks": f"""WITH {_TWO}, e AS (SELECT *, len(a) - suf AS fin FROM g WHERE len(ga) > 0), x AS (SELECT *, CASE WHEN pre = 0 AND suf > 0 THEN fin ELSE pre END AS brk, CASE WHEN pre > 0 THEN pre ELSE fin END AS edge FROM e)
SELECT p_partkey, place || '_gap' AS mode, CAST(brk AS INT) AS "index", CASE WHEN edge > 0 THEN a[edge] END AS before, a[edge + 1] AS after, a[fin + 1] AS rejoin_at, array_to_string(ga, ' -> ') AS missing, array_to_string(a[brk + 1:len(a)], ' -> ') AS remaining, pre AS prefix, suf AS suffix, CAST(len(ga) AS INT) AS n_missing FROM x""",
    "broken_chains": """WITH s AS (SELECT p_size AS area, p_partkey AS k, p_partkey % 7 AS unit FROM part),
d AS (SELECT area, count(*) AS n_sources, count(DISTINCT unit) AS units, count(DISTINCT unit) FILTER (WHERE area % 2 = 0 AND unit < 3) AS seen, min(unit) AS least FROM s WHERE area % 3 <> 1 GROUP BY 1 HAVING area % 3 = 0 OR count(*) FILTER (WHERE k % 2 = 0) = 0),
o AS (SELECT *, CASE WHEN seen > 0 THEN seen ELSE units END AS n, 'Origin -> Unit' || least || ' -> Statement' AS observed FROM d)
SELECT area, 'implementation_drift' AS category, 'high' AS severity, 'Statement.SUPPORTS' AS break_at, 'Statement -[:SUPPORTS]-> Element' AS missing_step, n_sources, n AS n_observed, units AS n_expected, n AS n_pairs, CAST(0 AS BIGINT) AS unmatched_observed, units - n AS unmatched_expected, observed, observed || ' -> Element' AS expected, 'tail_gap' AS mode, CAST(3 AS INT) AS "index", 'Statement' AS before, 'Element' AS after, CAST(NULL AS VARCHAR) AS rejoin_at, 'Element' AS missing, 'Element' AS remaining FROM o
UNION ALL SELECT area, 'implementation_drift', 'high', 'Statement.DERIVED_FROM', 'Statement -[:DERIVED_FROM]-> <source>', count(*), 1, 1, 1, 0, 0, 'Statement -> Element', 'Origin -> <source> -> Statement -> Element', 'prefix_gap', 2, '<source>', 'Statement', 'Statement', 'Origin -> <source>', 'Statement -> Element' FROM s WHERE area % 3 = 1 GROUP BY 1""",
}
