"""Claims of functions and scripts, and how functions persist, over files made from the driver's parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.operators import function_claims as C

_CODE = (
    ("", "", "class Store{n}:"), ("k % 4 = 0", "    @router.get('/x')", "    @cached"), ("", "", "    def {verb}_item(self, x):"), ("k % 6 = 0", '        """Its status."""', "        # plain"), ("k % 5 = 0", "        self.repo.upsert(x)", "        self.keeper.put(x)"),
    ("k % 2 = 0", "        tx.run('MERGE (a:Item)-[r:PART_OF]->(b:Box) SET a.x = 1')", "        note('a history')"), ("", "", "        return x"),
)
_SCRIPT = (("", "", "import x"), ("", "", ""), ("", "", "export function loadItem(x) {"), ("k % 2 = 0", "  return api.get('/items');", "  return items;"), ("", "", "}"), ("", "", "const Keep{n} = (x) => {"), ("k % 3 = 0", "  mutate(x);", "  other(x);"), ("k % 5 = 0", "", "  tenant();"), ("", "", "  done(x);"), ("", "", "}"))


def _files(spark, d, lines):
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    body = F.array_join(F.array(*(F.when(F.expr(when), F.lit(one)).otherwise(F.lit(other)) if when else F.lit(other) for when, one, other in lines)), "\n")
    verb = F.when(F.col("k") % 3 == 0, "load").when(F.col("k") % 3 == 1, "save").otherwise("check")
    body = F.replace(F.replace(body, F.lit("{n}"), (F.col("k") % 10).cast("string")), F.lit("{verb}"), verb)
    return p.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("source_id"), F.lit("Title").alias("title"), body.alias("text"))


def function_claims(spark, d):
    """What the functions of all files read, write, keep or guard."""
    return C.function_claims(C.functions_of(_files(spark, d, _CODE)), ()).select("source_id", "subject_key", "predicate", "value", "section_path", "first_line", "last_line")


def persistence_shape(spark, d):
    """Backends, operations and targets of the functions of all files."""
    return C.persistence(C.functions_of(_files(spark, d, _CODE)))


def script_claims(spark, d):
    """Claims of the blocks of all scripts."""
    return C.script_claims(C.script_blocks(_files(spark, d, _SCRIPT)), ())


QUERIES = {f.__name__: f for f in (function_claims, persistence_shape, script_claims)}
_FN = """p AS (SELECT p_partkey AS k, 'f' || p_partkey AS source_id, 'Store' || (p_partkey % 10) AS cls, CASE p_partkey % 3 WHEN 0 THEN 'load' WHEN 1 THEN 'save' ELSE 'check' END AS verb FROM part),
f AS (SELECT *, cls || '.' || verb || '_item' AS func FROM p)"""
_BODY = """'def ' || verb || '_item(self, x): ' || CASE WHEN k % 6 = 0 THEN '\"\"\"Its status.\"\"\"' ELSE '# plain' END || CASE WHEN k % 5 = 0 THEN ' self.repo.upsert(x)' ELSE ' self.keeper.put(x)' END || CASE WHEN k % 2 = 0 THEN ' tx.run(''MERGE (a:Item)-[r:PART_OF]->(b:Box) SET a.x = 1'')' ELSE ' note(''a history'')' END || ' return x'"""
ORACLES = {
    "function_claims": f"""WITH {_FN}, c AS (SELECT *, 'read_path' AS aspect, 'implemented_read' AS predicate FROM f WHERE k % 4 = 0 OR verb = 'load' UNION ALL SELECT *, 'write_path', 'implemented_write' FROM f WHERE verb = 'save' UNION ALL SELECT *, 'lifecycle', 'implemented_lifecycle' FROM f WHERE k % 6 = 0)
SELECT source_id, cls || '.' || aspect AS subject_key, predicate, rtrim(left(func || ' [' || predicate || '] ' || {_BODY}, 180)) AS value, func AS section_path, CAST(3 AS INT) AS first_line, CAST(7 AS INT) AS last_line FROM c""",
    "persistence_shape": f"""WITH {_FN}, r AS (SELECT source_id, func, 'backend' AS kind, CASE WHEN k % 2 = 0 THEN 'neo4j' ELSE 'repository' END AS name FROM f WHERE k % 2 = 0 OR k % 5 = 0
  UNION ALL SELECT source_id, func, 'operation', 'repository_upsert' FROM f WHERE k % 5 = 0
  UNION ALL SELECT source_id, func, o.kind, o.name FROM f, (VALUES ('operation', 'neo4j_query_write'), ('operation', 'neo4j_merge_relationship'), ('operation', 'neo4j_merge_node'), ('operation', 'neo4j_set_properties'), ('target', 'Node:Item'), ('target', 'Node:Box'), ('target', 'Relationship:PART_OF')) o(kind, name) WHERE k % 2 = 0
  UNION ALL SELECT source_id, func, 'operation', 'history_append' FROM f WHERE k % 2 = 1 UNION ALL SELECT source_id, func, 'target', 'History:' || cls FROM f WHERE k % 2 = 1) SELECT * FROM r""",
    "script_claims": """WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey AS source_id, 'Keep' || (p_partkey % 10) AS sym FROM part),
b AS (SELECT k, source_id, 'loadItem' AS symbol, 'Title' AS subject, 3 AS first_line, 5 AS last_line, 'export function loadItem(x) { ' || CASE WHEN k % 2 = 0 THEN 'return api.get(''/items'');' ELSE 'return items;' END || ' }' AS body, ['read_path'] AS aspects FROM p
  UNION ALL SELECT k, source_id, sym, sym, 6, CASE WHEN k % 5 = 0 THEN 7 ELSE 10 END, 'const ' || sym || ' = (x) => {' || CASE WHEN k % 3 = 0 THEN ' mutate(x);' ELSE ' other(x);' END || CASE WHEN k % 5 = 0 THEN '' ELSE ' tenant(); done(x); }' END, list_concat(CASE WHEN k % 3 = 0 THEN ['write_path'] ELSE [] END, CASE WHEN k % 5 = 0 THEN [] ELSE ['policy'] END) FROM p),
c AS (SELECT *, unnest(aspects) AS aspect FROM b)
SELECT source_id, subject || '.' || aspect AS subject_key, 'implemented_' || replace(aspect, '_path', '') AS predicate, symbol || ' [implemented_' || replace(aspect, '_path', '') || '] ' || body AS value, symbol AS section_path, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line FROM c""",
}
