"""Runs from documents, and incremental runs against full ones."""

import pytest
from pyspark.sql import functions as F

from klarspan import adapters as A
from klarspan.functions import semantics
from klarspan.operators import claims as C
from klarspan.operators import domain
from klarspan.plans import runs


def rows(findings, scopes=None, inside=True):
    df = findings.withColumn("scope_key", semantics.scope_key(F.col("object_key")))
    if scopes is not None:
        df = df.join(scopes.select("scope_key"), "scope_key", "left_semi" if inside else "left_anti")
    return sorted(map(tuple, df.select("category", "severity", "object_key", "title").collect()))


@pytest.fixture(scope="module")
def truths(spark, sf_dir):
    return A.event_truths(spark, sf_dir).cache()


def test_incremental_findings_equal_a_full_run_on_changed_scopes(spark, sf_dir, truths):
    before, now = A.previous_claims(spark, sf_dir), A.claims(spark, sf_dir)
    changed = now.withColumn("_k", F.substring_index("subject_key", ".", 1)).where("_k < 'E'").drop("_k")
    same = before.withColumn("_k", F.substring_index("subject_key", ".", 1)).where("_k >= 'E'").drop("_k")
    now = changed.unionByName(same)
    old = runs.deep_run(before, truths).findings
    mode, run = runs.incremental_run(now, truths, C.deduplicated(before), old)
    scopes = runs.impacted(C.deduplicated(now), C.deduplicated(before), truths)
    assert mode == "partial" and 0 < scopes.count()
    full = runs.deep_run(now, truths).findings
    assert rows(run.findings, scopes) == rows(full, scopes) != []
    assert rows(run.findings, scopes, inside=False) == rows(old, scopes, inside=False) != []


def test_fallbacks(spark, sf_dir, truths):
    now = A.previous_claims(spark, sf_dir)
    calm = truths.withColumn("pending_delta_recalculation", F.lit(False))
    mode, run = runs.incremental_run(now, calm)
    full = rows(runs.deep_run(now, calm).findings)
    assert mode == "full" and rows(run.findings) == full != []
    mode, again = runs.incremental_run(now, calm, C.deduplicated(now), run.findings)
    assert mode == "cloned" and rows(again.findings) == full


def test_documents_to_findings(spark, truths):
    v = domain.Vocabulary(("Invoice",), ("OPEN", "PAID"), rules=(domain.Rule("state", "{entity}.lifecycle", "lifecycle_state", each="entity_state"),))
    docs = spark.createDataFrame([(1, "confluence_page", "Rules", "a", "Invoice begins OPEN"), (2, "github_file", "pay", "src/pay.py", "x = 'Invoice PAID'"), (3, "jira_ticket", "T", "t", "Invoice PAID"), (4, "local_doc", None, None, None)], "doc_id long, source_type string, title string, path string, text string")
    claims = runs.document_claims(docs, v)
    got = {(r.subject_key, r.predicate, r.normalized_value, r.source_id, r.source_authority) for r in claims.where("subject_key LIKE 'Invoice.l%'").collect()}
    assert got == {("Invoice.lifecycle", "lifecycle_state", "OPEN", "1", "working_doc"), ("Invoice.lifecycle", "code_lifecycle_state", "PAID", "2", "implementation")}
    assert ("contradiction", "Invoice.lifecycle") in {(r.category, r.object_key) for r in runs.document_run(docs, truths, v).findings.collect()}
    assert runs.document_claims(docs.limit(0), v).count() == 0
