"""Cross-file resolution, scans of functions, query fragments and domain rules against cases told by hand."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from klarspan.operators import domain, fragments, repo, scan, variants
from klarspan.sources import parsers

FILES = {
    "src/app/base.py": """
from abc import ABC, abstractmethod
class Store(ABC):
    @abstractmethod
    def save(self, x): ...
    def load(self): ...
class Base:
    def log(self): self.audit()
    def audit(self): ...
""",
    "src/app/db.py": """
from .base import Store
class SqlStore(Store):
    def save(self, x):
        self.session.execute_write(x)
""",
    "src/app/__init__.py": "from .db import SqlStore as Default\nfrom .factory import build\n",
    "src/app/factory.py": """
import app.db as database
def build() -> 'database.SqlStore':
    return database.SqlStore()
""",
    "src/app/service.py": """
from typing import Optional
from app import Default, build
from app.base import Base, Store
import app.factory
class Deep:
    inner: Default
class Service(Base):
    def __init__(self, store: Store, deep: Optional[Deep] = None):
        self.store = store
        self.deep = deep
        self.again = self.deep.inner
    def run(self):
        self.store.save(1)
        self.deep.inner.save(2)
        self.again.save(3)
        self.log()
        made = build()
        other = made
        other.save(4)
        build().save(5)
        app.factory.build()
        with Default() as opened:
            opened.save(6)
        unknown.save(7)
        helper()
def helper(): Service(None).run()
""",
    "broken.py": "def (:",
}


@pytest.fixture(scope="module")
def calls(spark):
    files = spark.createDataFrame([(p, p, t) for p, t in FILES.items()] + [("null", None, None)], "source_id string, path string, text string")
    facts = parsers.repo_facts(files)
    assert [r.source_id for r in facts.where("kind = 'error'").collect()] == ["broken.py"]
    return repo.repo_calls(facts).cache()


def test_calls_resolve_across_files(calls):
    found = {(r.src, r.chain): (r.callee, r.reached) for r in calls.collect()}
    run, sql = "app.service.Service.run", "app.db.SqlStore.save"
    # an interface's method is that of its only implementation; imports passed on, aliases, attributes of attributes and results are followed
    for chain in ("self.store.save", "self.deep.inner.save", "self.again.save", "other.save", "build().save", "opened.save"):
        assert found[run, chain][0] == sql, chain
    assert found[run, "self.log"][0] == "app.base.Base.log"
    assert found["app.base.Base.log", "self.audit"][0] == "app.base.Base.audit"
    assert found[run, "app.factory.build"][0] == found[run, "build"][0] == "app.factory.build"
    assert found[run, "unknown.save"] == (None, "unknown.save")
    assert found["app.service.helper", "Service"][0] == "app.service.Service.__init__"
    assert found["app.service.helper", "Service().run"][0] == run
    assert found[run, "helper"][0] == "app.service.helper"
    assert found["app.db.SqlStore.save", "self.session.execute_write"] == (None, "app.db.SqlStore.session.execute_write") or found["app.db.SqlStore.save", "self.session.execute_write"][0] is None


def test_profiles_travel_to_callers(calls):
    profile = repo.function_profile(calls)
    found = {(r.src, r.name): (r.hops, r.path) for r in repo.inherited_profile(calls, profile.where("kind = 'write'")).collect()}
    assert found["app.db.SqlStore.save", "session.execute_write"][0] == 0
    assert found["app.service.Service.run", "session.execute_write"] == (1, "app.service.Service.run -> app.db.SqlStore.save")
    assert found["app.service.helper", "session.execute_write"][0] == 2  # a circle of calls ends
    kinds = {r.kind for r in profile.where("src = 'app.service.Service.run'").collect()}
    assert {"write", "repository"} <= kinds
    assert repo.inherited_profile(calls.limit(0), profile.limit(0)).count() == 0


def test_scan_of_awkward_files(spark):
    text = 'class A:\n    """save()"""\n    async def f(\n        self,\n        x=save(1),\n    ):\n        # save()\n        def g():\n            save(2)\n\n        enqueue(3)\n\ndef f(): pass\nif x:\n    save(4)\n'
    files = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "\tdef broken(:\n\t\tsave(1)\n")], "source_id string, text string")
    rows = {(r.source_id, r.func, r.kind, r.line) for r in scan.code_events(files).where("kind <> 'call'").collect()}
    assert rows == {("a", "A.f", "def", 3), ("a", "A.f", "persist", 5), ("a", "A.g", "def", 8), ("a", "A.g", "persist", 9), ("a", "A.f", "enqueue", 11), ("a", "f", "def", 13), ("a", "", "persist", 15), ("d", "broken", "def", 1), ("d", "broken", "persist", 2)}
    assert scan.step_gaps(scan.code_events(files.limit(0)), "persist", "enqueue", True).count() == 0


def test_helpers_in_a_circle(spark):
    text = "def a():\n    save()\n    b()\ndef b():\n    c()\ndef c():\n    b()\n    publish()\ndef d():\n    e()\n    persist()\ndef e():\n    publish()\n"
    gaps = scan.step_gaps(scan.code_events(spark.createDataFrame([("x", text)], "source_id string, text string")), "persist", "enqueue", True)
    assert [tuple(r) for r in gaps.collect()] == [("x", "a", 2, 3)]  # d stores after it queues


def test_fragments_and_paths(spark):
    code = 'q = f"MATCH (a:A)-[:R]->(b:B)-[:S]->(c:C) WHERE {x} RETURN a"\nr = ("MATCH (a)-[:R]->(b:B)-[:T]->(a:A) "\n     "RETURN b")\n'
    yaml = "a_query: >-\n  MATCH (x:X)<-[:R]-(y:Y)\n\n  RETURN x\nname: |\n  MATCH\n"
    files = spark.createDataFrame([("p", "x.py", code), ("y", "x.yml", yaml), ("n", None, None), ("e", "x.py", "def (")], "source_id string, path string, text string")
    found = fragments.query_fragments(files)
    assert {(r.source_id, r.line, r.end_line) for r in found.collect()} == {("p", 1, 1), ("p", 2, 3), ("y", 2, 4)}
    edges = fragments.query_edges(found)
    assert {(r.source_id, r.line, r.src, r.type, r.dst) for r in edges.collect()} == {("p", 1, "A", "R", "B"), ("p", 1, "B", "S", "C"), ("p", 2, "A", "R", "B"), ("p", 2, "B", "T", "A"), ("y", 2, "Y", "R", "X")}
    assert {(r.line, r.path) for r in fragments.query_paths(edges).where("source_id = 'p'").collect()} == {(1, "A -> B -> C"), (2, "A -> B"), (2, "B -> A")}
    assert fragments.query_paths(edges.limit(0)).count() == 0


def test_domain_rules_and_tables(spark):
    v = domain.Vocabulary(("Order.X", "Item"), ("NEW", "OLD"), rules=(domain.Rule("s", "{entity}.state", "state", each="entity_state"), domain.Rule("d", "{entity}.ok", "ok", "ok", "entity", (("not", "no"), ("", "yes")), unless="skip")))
    text = "Item new and NEW\nok\nnot ok Order.X\nok skip\n| status | who |\n|---|---|\n| old | Item |\n\n# H\n| Item | old |\n"
    docs = spark.createDataFrame([(1, "confluence_page", "T", "p", text), (2, "local_doc", None, None, None), (3, "jira_ticket", "T", "p", "Item NEW")], "doc_id long, source_type string, title string, path string, text string")
    rows = {(r.line_no, r.subject_key, r.value) for r in domain.domain_claims(docs, v).collect()}
    assert rows == {(1, "Item.state", "NEW"), (2, "general.ok", "yes"), (3, "Order.X.ok", "no"), (7, "Item.state", "OLD"), (7, "Item.status_canon", "OLD"), (10, "Item.state", "OLD"), (10, "Item.status_canon", "OLD")}
    heads = {r.line_no: r.headers for r in domain.table_lines(domain.sectioned_lines(docs.where("doc_id = 1"))).collect()}
    assert heads[7] == ["status", "who"] and heads[10] is None


def test_variants_by_strength(spark):
    rows = [
        (1, "a", "github_file", "s1", None, "approval", [["x.A", "y.B"]], 4), (2, "a", "github_file", "s2", None, "direct write", [["x.A", "z.C"]], -2), (3, "a", "github_file", "s3", None, "approval", [["q.D"]], 0),
        (4, "b", "confluence_page", "s1", None, "approval", [], 2), (5, "b", "github_file", "s2", "legacy", "none", [], 0), (6, "c", "github_file", "s9", None, "x", [], 1),
    ]
    records = spark.createDataFrame(rows, "record_id long, subject_key string, source_type string, source_id string, role string, value string, chains array<array<string>>, strength int")
    told = {r.record_id: (r.path_role, r.inferred) for r in variants.roles(records).collect()}
    assert told == {1: ("primary", True), 2: ("variant", True), 3: (None, False), 4: ("primary", False), 5: ("variant", False), 6: (None, False)}
    pairs = {r.variant_id: (r.primary_id, r.qualified, r.prefix, r.alignment) for r in variants.compared(variants.roles(records)).collect()}
    assert pairs == {2: (1, 1, 1, "qualified"), 5: (4, 0, 0, "none")}
    assert {r.subject_key for r in variants.legacy_path_gaps(records).collect()} == {"a", "b"}
    assert variants.legacy_path_gaps(records.limit(0)).count() == 0


def test_module_names(spark):
    paths = [("src/a/b.py", "a.b"), ("./a-b/__init__.py", "a_b"), ("", "module"), ("x\\y.py", "x.y")]
    got = spark.createDataFrame(paths, "path string, want string").select(parsers.module_of(F.col("path")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_inherited_members_are_looked_up_on_demand(spark, monkeypatch):
    """No table has all members of all classes, which for a chain of classes would be its square."""
    n = 40
    text = "class C0:\n    def run0(self): pass\n" + "".join(f"class C{i}(C{i - 1}):\n    def run{i}(self):\n        self.run{i - 1}()\n" for i in range(1, n))
    facts = parsers.repo_facts(spark.createDataFrame([("a", "a.py", text)], "source_id string, path string, text string"))
    sizes, kept = [], repo.kept

    def counted(df):
        out = kept(df)
        sizes.append(sum(pq.read_metadata(f.removeprefix("file://")).num_rows for f in out.inputFiles()))
        return out

    monkeypatch.setattr(repo, "kept", counted)
    found = {(r.src, r.callee) for r in repo.repo_calls(facts).collect()}
    assert found == {(f"a.C{i}.run{i}", f"a.C{i - 1}.run{i - 1}") for i in range(1, n)}
    assert max(sizes) == sizes[0] < n * 6
