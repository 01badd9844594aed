from pyspark.sql import functions as F

from klarspan.sources import parsers as P

CODE = '''
import os
from a.b import c as d

class Base: pass
class Mid(Base): pass
class Leaf(Mid):
    def run(self):
        self.save()
        os.path.join("x")
    def save(self):
        persist()

def persist():
    enqueue()

def enqueue(): ...
'''


def test_python_symbols_calls_and_bases(spark):
    files = spark.createDataFrame([("m.py", CODE), ("bad.py", "def ("), ("none.py", None)], "source_id string, text string")
    symbols = P.python_symbols(files)
    rows = {(r.source_id, r.kind, r.name, r.target) for r in symbols.collect()}
    assert {("bad.py", "error", "", ""), ("m.py", "function", "Leaf.run", ""), ("m.py", "base", "Leaf", "Mid"), ("m.py", "call", "Leaf.run", "os.path.join"), ("m.py", "import", "d", "a.b.c")} <= rows
    assert {(r.src, r.dst) for r in P.resolved_calls(symbols).collect()} == {("m.py:Leaf.run", "m.py:Leaf.save"), ("m.py:Leaf.save", "m.py:persist"), ("m.py:persist", "m.py:enqueue")}
    assert ("m.py:Leaf.run", "m.py:enqueue") in {(r.src, r.dst) for r in P.reachable_calls(symbols).collect()}
    assert {(r.src, r.dst) for r in P.transitive_bases(symbols).collect()} == {("m.py:Mid", "m.py:Base"), ("m.py:Leaf", "m.py:Mid"), ("m.py:Leaf", "m.py:Base")}


def test_graph_relations(spark):
    query = "MATCH (a:Chunk)-[:SUPPORTS {w: 1}]->(s:Statement)<-[r:ANSWERS]-(q:Question) RETURN a"
    got = spark.range(1).select(F.explode(P.graph_relations(F.lit(query))).alias("r")).select("r.*").collect()
    assert ("Chunk", "SUPPORTS", "Statement") in {tuple(r) for r in got}


def test_tables_diagrams_and_lists(spark):
    text = "intro\n| Name | Status |\n|---|:--|\n| A | draft |\n| B | |\n\n| no | header |"
    rows = P.table_rows(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r.line_no, r.header, r.cell) for r in rows] == [(4, "Name", "A"), (4, "Status", "draft"), (5, "Name", "B"), (5, "Status", "")]
    puml = "A -> B : go\nnote left\n  C -> D\nend note\n[E] --> [F]\nG <- H"
    arrows = P.diagram_arrows(spark.createDataFrame([(1, puml)], "doc_id long, text string")).orderBy("line_no").collect()
    assert [(r.src, r.dst, r.label) for r in arrows] == [("A", "B", "go"), ("E", "F", "")]
    conf = "write:\n  allow_list:\n    - Node: X\n  other: 1"
    assert [r.path for r in P.allow_list(spark.createDataFrame([("c", conf)], "doc_id string, text string")).orderBy("line_no").collect()] == ["write.allow_list", "write.allow_list.Node"]
    assert spark.range(1).select(P.missing_fields(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("m")).first()["m"] == ["b"]


def test_closures_of_long_chains(spark):
    code = "class C0: pass\n" + "".join(f"class C{i}(C{i - 1}): pass\n" for i in range(1, 11)) + "def f0(): ...\n" + "".join(f"def f{i}():\n    f{i - 1}()\n" for i in range(1, 11))
    symbols = P.python_symbols(spark.createDataFrame([("m.py", code)], "source_id string, text string"))
    want = lambda x: {(f"m.py:{x}{a}", f"m.py:{x}{b}") for a in range(11) for b in range(a)}
    assert {(r.src, r.dst) for r in P.transitive_bases(symbols).collect()} == want("C")
    assert {(r.src, r.dst) for r in P.reachable_calls(symbols).collect()} == want("f")


def test_tables_of_many_lines(spark):
    """Linear in the lines, repeated rows of one id and text included; tables end at a line without a pipe."""
    n = 40_000
    text = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(n))
    odd = "|---|\n| 1 | 2 |\nplain\n| no | header |\r\n| h |\n| - |\n|  z  | more |\n|--|\n| w"
    rows = [(1, text), (2, odd), (2, odd), (None, odd), (2, "| q |\n|-|\n| r |"), (3, ""), (4, None)]
    got = P.table_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    large = got.where("doc_id = 1").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.sum(F.when(F.col("header") == "a", F.col("cell").cast("long"))).alias("sum")).first()
    assert tuple(large) == (2 * n, n + 2, n * (n - 1) // 2)
    want = [(2, "", "1"), (2, None, "2"), (7, "h", "z"), (7, None, "more"), (9, "z", "w")]
    own = lambda where: sorted([tuple(r) for r in got.where(where).select("line_no", "header", "cell").collect()], key=str)
    assert own("doc_id = 2") == sorted([*want, *want, (3, "q", "r")], key=str)
    assert own("doc_id IS NULL") == sorted(want, key=str)
