"""Parsers over files written from the driver's tables: generated code, graph queries, tables and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.operators import repo as R
from klarspan.operators import scan as N
from klarspan.operators.graph import kept
from klarspan.sources import parsers as P

_FILES = 40


def _files(spark, d, line):
    """Files of parts: one a remainder of the key, its parts as lines in order."""
    p = A.table(spark, d, "part").withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"])
    return p.groupBy((F.col("p_partkey") % _FILES).alias("f")).agg(F.array_join(lines, "\n").alias("text"))


def _code(spark, d):
    k = F.col("p_partkey").cast("string")
    target = ((F.col("p_partkey") * 3 + 40) % 2000).cast("string")
    return _files(spark, d, F.concat(F.lit("def f"), k, F.lit("():\n    return f"), target, F.lit("()"))).select(F.concat(F.lit("m"), F.col("f").cast("string")).alias("source_id"), "text")


def code_calls(spark, d):
    return P.resolved_calls(P.python_symbols(_code(spark, d)))


def code_symbols(spark, d):
    return P.python_symbols(_code(spark, d)).groupBy("source_id", "kind").agg(F.count("*").alias("n"))


def code_reachable(spark, d):
    """Functions reachable over any number of calls."""
    return P.reachable_calls(P.python_symbols(_code(spark, d)))


def graph_query_relations(spark, d):
    """Relations in graph queries composed of brands and types."""
    p = A.table(spark, d, "part")
    label = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    left, right = label(F.col("p_brand")), label(F.substring_index("p_type", " ", 1))
    q = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("MATCH (a:"), left, F.lit(")-[:MADE_OF]->(b:"), right, F.lit(") RETURN a"))).otherwise(F.concat(F.lit("MATCH (a:"), left, F.lit(" {x: 1})<-[r:PART_OF]-(b:"), right, F.lit(")")))
    return p.select("p_partkey", F.inline(P.graph_relations(q)))


def table_cells(spark, d):
    t = _files(spark, d, F.concat(F.lit("| "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |")))
    t = t.select(F.col("f").alias("doc_id"), F.concat(F.lit("| brand | size |\n|---|---|\n"), "text").alias("text"))
    return P.table_rows(t)


def diagram_arrows(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 7 == 0, F.concat(F.lit("note left\n  X -> Y\nend note"))).otherwise(F.concat(F.lit("n"), (k % 9).cast("string"), F.lit(" -> n"), (k % 5).cast("string"), F.lit(" : "), F.col("p_size").cast("string")))
    return P.diagram_arrows(_files(spark, d, line).select(F.col("f").alias("doc_id"), "text")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _repository(spark, d):
    """A Python file a part, each of which descends from, imports and calls others, by its key. The parts are dealt out, as
    a file of few bytes stands for texts that take long to parse."""
    p = A.table(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    k = lambda c: F.greatest(F.lit(1), F.floor(c)).cast("long").cast("string")
    key = F.col("p_partkey") + 1
    me, up, store, maker = k(key), k(key / 2), k(key / 3), k(key / 5)
    root = key <= 1
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    text = t(
        F.when(root, "from abc import ABC\n").otherwise(t("from shop.p", up, " import Item", up, " as Parent\n")),
        t("import shop.p", store, " as stock\nfrom .p", maker, " import make", maker, "\n\n"),
        t("class Item", me, F.when(root, "").otherwise("(Parent)"), ":\n    size = ", F.col("p_size").cast("string"), "\n"),
        F.when(root | (key % 2 == 0), t("    def __init__(self, store: 'stock.Item", store, "'):\n        self.store = store\n")).otherwise(""),
        F.when(root | (key % 3 == 0), t("    def save(self, session):\n        session.execute_write(self)\n")).otherwise(""),
        t("    def run", me, "(self):\n        self.store.save(1)\n        other = make", maker, "()\n        other.save(2)\n        helper", me, "()\n\n"),
        t("def make", me, "() -> Item", me, ":\n    return Item", me, "(None)\n\n"),
        t("def helper", me, "():\n    return make", maker, "().store\n"),
    )
    return p.select(t("p", me).alias("source_id"), t("src/shop/p", me, ".py").alias("path"), text.alias("text"))


def repo_calls(spark, d):
    """Calls of methods and functions across files: through imports, aliases, base classes, injected stores and results."""
    return R.repo_calls(P.repo_facts(_repository(spark, d))).where("callee IS NOT NULL").select("src", "chain", "callee")


def repo_write_paths(spark, d):
    """Functions that reach a writing call themselves or through others: fewest calls between, first path."""
    calls = kept(R.repo_calls(P.repo_facts(_repository(spark, d))))
    found = R.inherited_profile(calls, R.function_profile(calls).where("kind = 'write' AND name LIKE '%execute_write'"))
    return found.groupBy("src").agg(F.min("hops").alias("hops"))


#: Files whose functions store and queue, replace and rebuild, or write in a side context, by the part's key; no lines.
_SCANNED = (
    ("", '"""persist(x) in a docstring."""'),
    ("", "class Flow:"),
    ("", "    def run(self):"),
    ("", "        # save(x)"),
    ("k % 2 = 0", "        save_item(1)"),
    ("", "        self.helper()"),
    ("", "    def helper(self):"),
    ("", "        deeper()"),
    ("", "    def replace(self):"),
    ("", "        def inner():"),
    ("k % 7 = 0", "            enqueue_job(2)"),
    ("k % 5 = 0", "        supersede_old(3)"),
    ("", "        rebuild_all(4)"),
    ("", "def deeper():"),
    ("k % 3 = 0", "    dispatch_task(5)"),
    ("", "def refine_order("),
    ("", "    lineitem,"),
    ("", "):"),
    ("k % 4 = 0", "    trace_id = 1"),
    ("k % 11 <> 0", "    store_row(lineitem)"),
    ("", "    upsert_all()"),
    ("", "    output_schema = 1"),
    ("", "    x = ['price', 'size']"),
    ("k % 6 = 0", "    y = 'brand'"),
)


def _scanned(spark, d):
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    lines = [F.when(F.expr(when), F.lit(line)).otherwise(F.lit(line[: len(line) - len(line.lstrip())] + "pass")) if when else F.lit(line) for when, line in _SCANNED]
    return p.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("source_id"), F.array_join(F.array(*lines), "\n").alias("text"))


def _events(spark, d):
    more = {"write": r"store_row", "output": r"'(price|size|brand)'"}
    return kept(N.code_events(_scanned(spark, d), {"lineitem": "Lineitem"}, r"\b(trace_id|run_id)\b\s*=", more))


def code_scan_state(spark, d):
    """What each function of the files shows by kind: docstrings and comments do not count, a nested function is its own."""
    return N.scan_state(_events(spark, d))


def step_gaps(spark, d):
    """State stored before work on it is queued, also by helpers of helpers; chains replaced before they are rebuilt."""
    return N.step_claims(_events(spark, d))


def propagation_gaps(spark, d):
    return N.propagation_gaps(_events(spark, d), "trace_id")


def output_gaps(spark, d):
    return N.output_gaps(_events(spark, d), ("brand", "price", "size"))


QUERIES = {f.__name__: f for f in (code_scan_state, step_gaps, propagation_gaps, output_gaps, repo_calls, repo_write_paths, code_calls, code_symbols, code_reachable, graph_query_relations, table_cells, diagram_arrows)}
_CALL = f"c AS (SELECT DISTINCT 'm' || (a.p_partkey % {_FILES}) || ':f' || a.p_partkey AS src, 'm' || (a.p_partkey % {_FILES}) || ':f' || b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 3 + 40) % 2000 AND a.p_partkey % {_FILES} = b.p_partkey % {_FILES})"
_L = "regexp_replace({}, '[^A-Za-z0-9]', '', 'g')"
_LEFT, _RIGHT = _L.format("p_brand"), _L.format("split_part(p_type, ' ', 1)")
_REPO = """
p AS (SELECT p_partkey + 1 AS k, greatest(1, k // 2) AS up, greatest(1, k // 3) AS store, greatest(1, k // 5) AS maker FROM part),
tree AS (SELECT k, k AS a, 0 AS depth FROM p UNION ALL SELECT tree.k, p.up, depth + 1 FROM tree JOIN p ON p.k = tree.a WHERE tree.a > 1),
saver AS (SELECT k, arg_min(a, depth) AS saver FROM tree WHERE a <= 1 OR a % 3 = 0 GROUP BY k),
makers AS (SELECT k, arg_min(a, depth) AS init FROM tree WHERE a <= 1 OR a % 2 = 0 GROUP BY k),
injected AS (SELECT m.k, p.store AS holds FROM makers m JOIN p ON p.k = m.init),
calls AS (
  SELECT 'shop.p' || i.k || '.Item' || i.k || '.run' || i.k AS src, 'self.store.save' AS chain, 'shop.p' || saver || '.Item' || saver || '.save' AS callee FROM injected i JOIN saver ON saver.k = holds
  UNION ALL SELECT 'shop.p' || p.k || '.Item' || p.k || '.run' || p.k, 'make' || maker, 'shop.p' || maker || '.make' || maker FROM p
  UNION ALL SELECT 'shop.p' || p.k || '.Item' || p.k || '.run' || p.k, 'other.save', 'shop.p' || saver || '.Item' || saver || '.save' FROM p JOIN saver ON saver.k = p.maker
  UNION ALL SELECT 'shop.p' || k || '.Item' || k || '.run' || k, 'helper' || k, 'shop.p' || k || '.helper' || k FROM p
  UNION ALL SELECT 'shop.p' || p.k || '.make' || p.k, 'Item' || p.k, 'shop.p' || init || '.Item' || init || '.__init__' FROM p JOIN makers m ON m.k = p.k
  UNION ALL SELECT 'shop.p' || k || '.helper' || k, 'make' || maker, 'shop.p' || maker || '.make' || maker FROM p)"""
_SHOWN = """s(func, kind, name, line, c) AS (VALUES
  ('Flow.run', 'def', 'run', 3, 1), ('Flow.run', 'persist', '', 5, 2), ('Flow.run', 'call', 'save_item', 5, 2), ('Flow.run', 'call', 'helper', 6, 1),
  ('Flow.helper', 'def', 'helper', 7, 1), ('Flow.helper', 'call', 'deeper', 8, 1), ('Flow.replace', 'def', 'replace', 9, 1),
  ('Flow.inner', 'def', 'inner', 10, 1), ('Flow.inner', 'enqueue', '', 11, 7), ('Flow.inner', 'call', 'enqueue_job', 11, 7),
  ('Flow.replace', 'supersede', '', 12, 5), ('Flow.replace', 'call', 'supersede_old', 12, 5), ('Flow.replace', 'rebuild', '', 13, 1), ('Flow.replace', 'call', 'rebuild_all', 13, 1),
  ('deeper', 'def', 'deeper', 14, 1), ('deeper', 'enqueue', '', 15, 3), ('deeper', 'call', 'dispatch_task', 15, 3),
  ('refine_order', 'def', 'refine_order', 16, 1), ('refine_order', 'entity', 'Lineitem', 17, 1), ('refine_order', 'field', 'trace_id', 19, 4), ('refine_order', 'write', '', 20, -11), ('refine_order', 'entity', 'Lineitem', 20, -11), ('refine_order', 'call', 'store_row', 20, -11),
  ('refine_order', 'persist', '', 21, 1), ('refine_order', 'call', 'upsert_all', 21, 1), ('refine_order', 'schema', '', 22, 1), ('refine_order', 'output', 'price', 23, 1), ('refine_order', 'output', 'size', 23, 1), ('refine_order', 'output', 'brand', 24, 6)),
e AS (SELECT 'f' || p_partkey AS source_id, func, kind, name, CAST(line AS INT) AS line FROM part, s WHERE CASE WHEN c > 0 THEN p_partkey % c = 0 ELSE p_partkey % -c <> 0 END)"""
ORACLES = {
    "code_scan_state": f"WITH {_SHOWN} SELECT source_id, func, kind, count(DISTINCT name) AS names, count(DISTINCT line) AS lines, min(line) AS first, max(line) AS last FROM e GROUP BY ALL",
    "step_gaps": """WITH g AS (SELECT 'f' || p_partkey AS source_id, 'TemporalConsistency.persist_then_enqueue' AS subject_key, 'persist_before_enqueue' AS seq, 'code_eventual_consistency_risk' AS risk, 'Flow.run: persist in line 5, enqueue in line 6' AS text, CAST(5 AS INT) AS line FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT 'f' || p_partkey, 'TemporalConsistency.supersede_then_rebuild', 'supersede_before_rebuild', 'code_chain_interruption_risk', 'Flow.replace: supersede in line 12, rebuild in line 13', 12 FROM part WHERE p_partkey % 5 = 0)
SELECT source_id, subject_key, 'code_temporal_sequence' AS predicate, seq AS value, line FROM g UNION ALL SELECT source_id, subject_key, risk, text, line FROM g""",
    "propagation_gaps": "SELECT 'f' || p_partkey AS source_id, 'refine_order' AS func, 'Lineitem' AS entity, 'name_context' AS contexts, CAST(16 AS INT) AS line FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 11 <> 0",
    "output_gaps": "SELECT 'f' || p_partkey AS source_id, 'refine_order' AS func, 'price,size' AS found, 'brand' AS missing, CAST(22 AS INT) AS line FROM part WHERE p_partkey % 6 <> 0",
    "repo_calls": f"WITH RECURSIVE {_REPO} SELECT * FROM calls",
    "repo_write_paths": f"WITH RECURSIVE {_REPO} SELECT 'shop.p' || k || '.Item' || k || '.save' AS src, CAST(0 AS INT) AS hops FROM p WHERE k <= 1 OR k % 3 = 0 UNION ALL SELECT DISTINCT src, CAST(1 AS INT) FROM calls WHERE callee LIKE '%.save'",
    "code_calls": f"WITH {_CALL} SELECT * FROM c",
    "code_symbols": f"SELECT 'm' || (p_partkey % {_FILES}) AS source_id, kind, count(*) AS n FROM part, (VALUES ('function'), ('call')) k(kind) GROUP BY ALL",
    "code_reachable": f"WITH RECURSIVE {_CALL}, r(src, dst) AS (SELECT src, dst FROM c UNION SELECT r.src, c.dst FROM r JOIN c ON r.dst = c.src) SELECT src, dst FROM r",
    "graph_query_relations": f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {_LEFT} ELSE {_RIGHT} END AS src, CASE WHEN p_size % 2 = 0 THEN 'MADE_OF' ELSE 'PART_OF' END AS type, CASE WHEN p_size % 2 = 0 THEN {_RIGHT} ELSE {_LEFT} END AS dst FROM part",
    "table_cells": f"WITH l AS (SELECT p_partkey % {_FILES} AS doc_id, CAST(2 + row_number() OVER (PARTITION BY p_partkey % {_FILES} ORDER BY p_partkey) AS INT) AS line_no, p_brand, p_size FROM part) SELECT doc_id, line_no, 'brand' AS header, trim(p_brand) AS cell FROM l UNION ALL SELECT doc_id, line_no, 'size', CAST(p_size AS VARCHAR) FROM l",
    "diagram_arrows": "SELECT 'n' || (p_partkey % 9) AS src, 'n' || (p_partkey % 5) AS dst, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL",
}
