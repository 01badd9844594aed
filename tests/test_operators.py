import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import semantics, text
from klarspan.operators import claims as C
from klarspan.operators import extraction as X
from klarspan.operators import graph as G
from klarspan.operators import relations as R
from klarspan.operators import retrieval as T
from klarspan.sources import readers, stores
from klarspan.streaming import deltas


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "subject,predicate,value,tags",
    [
        ("A.write_path", "x", "Approval required, no direct write", ["approval_required", "write_enabled"]),
        ("A.policy", "x", "ungated", ["approval_bypass", "approval_required"]),
        ("A.read_path", "x", "Read-Only query", ["read_only", "read_operation"]),
        ("A.lifecycle", "x", "In_Review", ["review_status"]),
        ("BSM.process", "phase_count", "12 phases", ["phase_count:12", "process_reference"]),
        ("BSM.phase.scope.question.q7", "x", "order: 03", ["phase_order:3", "phase_reference", "phase_reference:scope", "process_reference", "question_reference", "question_reference:q7"]),
        ("BSM.process", "x", "Phase: risk review is first", ["phase_reference", "phase_reference:risk_review", "process_reference"]),
        ("A", "x", "global wiki service", ["documentation_reference", "global_scoped", "implementation_reference"]),
        ("A", "x", "", []),
    ],
)
def test_signatures(spark, subject, predicate, value, tags):
    assert one(spark, semantics.signature(F.lit(subject), F.lit(predicate), F.lit(value))) == tags


@pytest.mark.parametrize(
    "left,right,conflict",
    [(["approval required"], ["direct persist"], True), (["read only"], ["write"], True), (["read only"], ["write after approval"], False), (["write"], ["save"], False), (["abc"], ["abc"], False), (["abc"], ["xyz"], True), (["ungated"], ["ungated"], True)],
)
def test_conflicts(spark, left, right, conflict):
    tags = lambda vs: F.array(*(semantics.signature(F.lit("A.write_path"), F.lit("p"), F.lit(v)) for v in vs))
    values = lambda vs: F.array(*map(F.lit, vs))
    assert one(spark, semantics.signatures_conflict(tags(left), tags(right), values(left), values(right))) is conflict


def test_scopes_and_sections(spark):
    keys = {"": "General", "EvidenceChain.x": "EvidenceChain", "BSM.phase.a.question.b": "BSM.phase.a", "BSM.process.x": "BSM.process", "T.write_path.x": "T", "T.other": "T.other"}
    for key, scope in keys.items():
        assert one(spark, semantics.scope_key(F.lit(key))) == scope
    path = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.sections_overlap(path("b", "c"), path("a", "b", "c")))
    assert one(spark, text.sections_overlap(path("a", "b", "c"), path("a", "b")))
    assert not one(spark, text.sections_overlap(path("b"), path("a", "c")))
    assert one(spark, text.excerpt(F.lit("One. Two! Three?"))) == "One. Two!"


def test_dedup_keeps_the_first(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", "z")]
    got = C.deduplicated(spark.createDataFrame(rows, "record_ord int, fingerprint string, v string")).collect()
    assert sorted((r.fingerprint, r.v) for r in got) == [("a", "y"), ("b", "z")]


def test_heading_stack_skips_levels(spark):
    docs = spark.createDataFrame([("d", "Doc", "# A\nx\n### C\ny\n## B\n\nz"), ("e", "Doc", None)], "doc_id string, title string, text string")
    got = [(r.line_no, r.line, r.section_path) for r in X.sectioned_lines(docs).orderBy("line_no").collect()]
    assert got == [(2, "x", "Doc > A"), (4, "y", "Doc > A > C"), (7, "z", "Doc > A > B")]


def test_config_and_paths(spark):
    docs = spark.createDataFrame([("d", "a:\n  b: 1\n  c:\n    d = x\ne: 2")], "doc_id string, text string")
    assert [(r.path, r.value) for r in X.config_claims(docs).orderBy("line_no").collect()] == [("a", ""), ("a.b", "1"), ("a.c", ""), ("a.c.d", "x"), ("e", "2")]
    assert one(spark, X.chain_paths(F.lit("Input -> (Chunk) → Statement!"))) == ["Input", "Chunk", "Statement"]


def test_segments(spark):
    body = "# Head\n" + "long line of words\n" * 50 + "\nafter the blank line there is more\n# Next\nshort"
    got = T.segments(spark.createDataFrame([(1, body), (2, None), (3, "tiny")], "doc_id long, text string")).orderBy("doc_id", "ordinal").collect()
    assert [r.content.split("\n")[0] for r in got] == ["# Head", "after the blank line there is more"]
    code = spark.createDataFrame([(1, "import x\ndef a():\n  pass\nclass B:\n  y = 1")], "doc_id long, text string")
    assert [(r.line_start, r.line_end) for r in T.code_blocks(code).orderBy("block").collect()] == [(1, 1), (2, 3), (4, 5)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2, "both"), (2, 3, "both"), (3, 1, "both"), (3, 4, "none"), (2, 5, "both"), (5, 6, "both")], "src long, dst long, mode string")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, G.expand(edges, seeds, 2).collect())) == [(1, 0), (2, 1), (3, 2), (5, 2)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], "node long, parent long")
    assert {r.node: r.depth for r in G.depths(tree).collect()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: 21, 6: 21}
    assert G.closure(edges).where("src = 1").count() == 6


def test_path_matching(spark):
    rows = [("s", "documented", ["a", "b", "c"]), ("s", "documented", ["x", "y"]), ("s", "implemented", ["a", "q", "c"]), ("s", "implemented", ["x", "y"]), ("t", "documented", ["a"])]
    got = R.matched_paths(spark.createDataFrame(rows, "subject_key string, side string, path array<string>")).collect()
    assert sorted((r.documented, r.implemented, r.shared) for r in got) == [("a>b>c", "a>q>c", 2), ("x>y", "x>y", 4)]


def test_repository_scan_and_reuse(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 'é'")
    (tmp_path / "src/b.bin").write_text("no")
    (tmp_path / "node_modules/c.js").write_text("no")
    got = readers.repository(spark, str(tmp_path)).collect()
    assert [(r.source_id, r.text) for r in got] == [("src/a.py", "x = 'é'")]
    now = readers.repository(spark, str(tmp_path))
    assert [r.reusable for r in readers.reusable(now, now).collect()] == [True]
    assert [r.reusable for r in readers.reusable(now, now, now).collect()] == [False]


def test_markup_and_trees(spark):
    html = "<h1>A</h1><p>one &amp; <b>two</b></p><script>no</script><h2>B</h2><ul><li>x</li></ul>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    blocks = readers.page_blocks(pages)
    assert [(r.kind, r.text, r.section_path) for r in blocks.orderBy("ordinal").collect()] == [("heading", "A", "A"), ("paragraph", "one & two", "A"), ("heading", "B", "A > B"), ("list_item", "x", "A > B")]
    assert pages.select(readers.markup_text(F.col("html")).alias("t")).first()["t"] == "A\none & two\nB\nx"
    delta = readers.section_delta(readers.section_digests(blocks), readers.section_digests(blocks.where("text <> 'x'")))
    assert [(r.section_path, r.status) for r in delta.collect()] == [("A > B", "changed")]
    node = {"type": "doc", "content": [{"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": "T"}]}, {"type": "panel", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "p"}]}]}]}
    deep = {"type": "paragraph", "content": [{"type": "text", "text": "end"}]}
    for _ in range(400):
        deep = {"type": "panel", "content": [deep]}
    docs = spark.createDataFrame([(1, json.dumps(node)), (2, "broken"), (3, None), (4, json.dumps(deep))], "doc_id long, body string")
    assert sorted((r.doc_id, r.kind, r.text, r.section_path) for r in readers.document_tree(docs).collect()) == [(1, "heading", "T", "T"), (1, "paragraph", "p", "T"), (4, "paragraph", "end", "")]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "runs")
    stores.replace_run(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, v string"), path)
    stores.replace_run(spark.createDataFrame([(2, "c")], "run_id int, v string"), path)
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    table = spark.createDataFrame([("k", 1, "old"), ("m", 1, "stay")], "key string, ord int, v string")
    merged = stores.upserted(table, spark.createDataFrame([("k", 0, "new")], "key string, ord int, v string"), ["key"], "ord")
    assert sorted((r.key, r.v) for r in merged.collect()) == [("k", "new"), ("m", "stay")]
    assert stores.missing(table, merged.where("key = 'k'"), "key").count() == 1


def test_streamed_deltas_match_batch(spark, sf_dir, tmp_path):
    now, before = A.claims(spark, sf_dir).limit(200), A.previous_claims(spark, sf_dir).limit(150)
    land = str(tmp_path / "land")
    before.coalesce(1).write.parquet(land)
    args = (land, before.schema, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "check"))
    deltas.run_deltas(spark, *args).awaitTermination()
    now.coalesce(1).write.mode("append").parquet(land)
    deltas.run_deltas(spark, *args).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.batch for r in out.select("batch").distinct().collect()} == {0, 1}
    want = C.claim_delta(now, before).groupBy("delta_change_type").count()
    key = lambda df: sorted((r[0], r[1]) for r in df.collect())
    assert key(out.where("batch = 0").groupBy("delta_change_type").count()) == [("new_identity", 150)]
    assert sum(n for _, n in key(out.where("batch = 1").groupBy("delta_change_type").count())) == sum(n for _, n in key(want))


def test_similar_pairs_meet_without_an_exchange(spark):
    """All pairs against brute force, with vectors of unlike lengths, repeated ids, nulls and zero vectors; blocks are read
    from where they were written, not dealt out for each pair."""
    rng = np.random.default_rng(3)
    rows = [(i % 55, "abc"[i % 3] if i % 11 else None, "XyxY"[i % 4], [float(x) for x in rng.normal(size=3) + 0.4] + [0.5] * (i % 2)) for i in range(60)] + [(90, "a", "x", [0.0, 0.0, 0.0]), (91, "a", "x", None), (92, "a", "x", [])]
    got = R.similar_pairs(spark.createDataFrame(rows, "id long, source string, value string, vector array<double>"), block=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = []
    for k, (a, s, v, x) in enumerate(rows[:60]):
        for b, s2, v2, y in rows[:k]:
            n = min(len(x), len(y))
            cosine = sum(p * q for p, q in zip(x[:n], y[:n])) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
            if a != b and s != s2 and v.lower() != v2.lower() and cosine >= 0.7:
                want.append((min(a, b), max(a, b), round(cosine, 9), "high" if cosine >= 0.85 else "medium"))
    assert len(want) > 50 and sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got.collect()) == sorted(want)


def test_segments_are_not_broadcast(spark):
    """However small their file: on the driver they would be many times as large. Repeated ids, nulls and lines in falling
    order give what they gave."""
    shape = "source_id string, segment_id long, anchor string, section_path string, line_start int, line_end int, words array<string>"
    seg = spark.createDataFrame([("s", 1, "a", "x", 5, 3, ["p", "q"]), ("s", 2, "a", "x", None, 2, None), ("t", 3, None, None, 1, 1, ["q", "q", "r"]), ("s", 4, "b", "y", 1, 9, ["p", "r", "z"])], shape)
    shape = "source_id string, claim_id string, anchor string, section_path string, line int, words array<string>"
    claim = spark.createDataFrame([("s", "c1", "a", "y", 4, ["p"]), ("s", "c2", "n", "n", 99, ["p", "q", "r"]), ("s", "c3", None, "x", 1, None), ("t", "c4", "n", "n", 9, ["r", "q", "q"]), (None, "c5", "a", "x", 1, ["p"])], shape)
    got = R.claim_segment_links(seg, claim)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = {("c1", 1, 1.0), ("c1", 2, 1.0), ("c1", 4, 0.96), ("c2", 1, 0.9), ("c2", 4, 0.9), ("c3", 1, 0.96), ("c3", 2, 0.96), ("c3", 4, 0.96), ("c4", 3, 0.9)}
    found = sorted((r.claim_id, r.segment_id, r.score) for r in got.collect())
    assert found == sorted(want)
    twice = sorted((r.claim_id, r.segment_id, r.score) for r in R.claim_segment_links(seg, claim.union(claim.where("claim_id IN ('c1', 'c3')"))).collect())
    assert twice == found
