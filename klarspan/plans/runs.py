"""Runs composed of the operators: deep, delta and fast. Each takes and gives DataFrames; claims, scopes and findings
are written to the shared folder once, since several detectors read them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.functions import scoring, semantics
from klarspan.operators import claims as C
from klarspan.operators import domain as D
from klarspan.operators import extraction as X
from klarspan.operators import packages as P
from klarspan.operators import review as V
from klarspan.operators import rules as R
from klarspan.operators import semantic_graph as G
from klarspan.operators.graph import kept
from klarspan.operators.metadata import domain_metadata


@dataclass
class Run:
    claims: DataFrame
    findings: DataFrame
    packages: DataFrame


def _findings(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """Findings of all detectors in one shape: category, severity, object_key, title."""
    shape = lambda df, category, severity, title: df.select(category.alias("category"), severity.alias("severity"), F.col("subject_key").alias("object_key"), title.alias("title"))
    rules = shape(R.findings(claims), F.col("category"), F.col("severity"), F.col("rule"))
    off = shape(C.deviations(claims, truths), F.lit("contradiction"), F.col("severity"), F.concat_ws(":", F.lit("deviation"), "source_type", "source_id"))
    values = shape(X.value_conflicts(claims), F.lit("contradiction"), F.lit("high"), F.concat_ws(":", F.lit("values"), "concept"))
    gaps = shape(X.documentation_gaps(claims).withColumnRenamed("scope", "subject_key"), F.lit("missing_documentation"), F.lit("medium"), F.concat_ws(":", F.lit("gap"), "gap_type"))
    return rules.union(off).union(values).union(gaps)


def _complete(claims: DataFrame, findings: DataFrame) -> Run:
    bucket = scoring.root_cause(F.col("object_key"), F.col("category"), F.col("title"), F.lit(False))
    full = findings.withColumn("finding_ord", F.xxhash64("category", "object_key", "title")).withColumn("bucket", bucket).withColumn("cluster", semantics.scope_key(F.col("object_key")))
    full = full.withColumn("truth", F.lit(False)).withColumn("delta", F.lit(True)).withColumn("source_id", F.col("title"))
    return Run(claims, full, P.packages(full))


def deep_run(claims: DataFrame, truths: DataFrame) -> Run:
    claims = kept(C.deduplicated(claims))
    return _complete(claims, kept(_findings(claims, truths)))


def delta_run(claims: DataFrame, previous: DataFrame, previous_findings: DataFrame, truths: DataFrame) -> Run:
    """Only scopes that changed are examined again; findings of the others carry over."""
    return incremental_run(claims, truths, previous, previous_findings)[1]


def document_claims(docs: DataFrame, vocabulary: D.Vocabulary | None = None, entities=()) -> DataFrame:
    """Claim records of documents (doc_id, source_type, title, path, text), as deep runs take them: what their lines say,
    and what the rules of a vocabulary find. Status and authority come from the line and the document's names; records are
    numbered by a hash of what makes them, and equal ones count once."""
    rows = X.extract_claims(docs, entities).select("doc_id", "subject_key", "predicate", "value", "line_no", "section_path", F.col("value").alias("matched_text"))
    if vocabulary is not None:
        rows = rows.union(D.domain_claims(docs, vocabulary).select("doc_id", "subject_key", "predicate", "value", "line_no", "section_path", "matched_text"))
    named = docs.select("doc_id", "source_type", "title", F.col("path").alias("path_hint"), F.col("doc_id").cast("string").alias("source_id"))
    rows = domain_metadata(rows.join(named, "doc_id"))
    key = ("subject_key", "predicate", "value", "source_id")
    once = rows.groupBy(*key).agg(F.min_by(F.struct("source_type", "title", "path_hint", "line_no", "section_path", "matched_text", "domain_status", "domain_authority"), "line_no").alias("first"))
    return once.select(
        F.xxhash64(*key).alias("record_ord"), F.md5(F.concat_ws("|", *key)).alias("claim_id"), "subject_key", "predicate", F.col("value").alias("normalized_value"), "first.source_type", "source_id",
        F.col("first.domain_authority").alias("source_authority"), F.col("first.domain_status").alias("assertion_status"), "first.title", "first.path_hint", F.col("first.domain_authority").alias("governance"),
        F.when(F.col("first.domain_authority") == "historical", "historic").otherwise("current").alias("temporal"), F.col("first.line_no").alias("line"), "first.section_path", "first.matched_text", F.lit(0.9).alias("confidence"),
        F.md5(F.concat_ws("|", *key)).alias("fingerprint"),
    )


def document_run(docs: DataFrame, truths: DataFrame, vocabulary: D.Vocabulary | None = None, entities=()) -> Run:
    """Documents to findings and packages."""
    return deep_run(document_claims(docs, vocabulary, entities), truths)


def impacted(claims: DataFrame, previous: DataFrame, truths: DataFrame, graph: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scopes to examine again: those of claims that changed in meaning and of pending truths, then those that share claims
    with them, then, with a causal graph (edges, nodes), those that it says they touch."""
    scopes = kept(C.impacted_scopes(C.claim_delta(claims, previous), truths))
    if graph is None:
        return scopes
    edges, nodes = graph
    bound = truths.where("truth_status = 'active' AND pending_delta_recalculation").select(F.concat(F.lit("subject:"), "subject_key").alias("node"))
    return kept(G.causal_expand(edges, nodes, scopes, bound).select("scope_key"))


def incremental_run(claims: DataFrame, truths: DataFrame, previous: DataFrame | None = None, previous_findings: DataFrame | None = None, graph: tuple[DataFrame, DataFrame] | None = None) -> tuple[str, Run]:
    """How the run was made, and the run: `full` without a run before or without its findings, `cloned` if no scope is
    impacted, else `partial`, which examines the impacted scopes and takes the other findings over."""
    claims = kept(C.deduplicated(claims))
    if previous is None or previous_findings is None:
        return "full", _complete(claims, kept(_findings(claims, truths)))
    scopes = impacted(claims, previous, truths, graph)
    shape = ("category", "severity", "object_key", "title")
    if scopes.isEmpty():
        return "cloned", _complete(claims, previous_findings.select(*shape))
    scoped = lambda df: df.withColumn("scope_key", semantics.scope_key(F.col("object_key")))
    again = kept(_findings(kept(C.in_scopes(claims, scopes)), truths))
    carried = scoped(previous_findings).join(scopes, "scope_key", "left_anti").select(*shape)
    touched = scoped(again).join(scopes, "scope_key", "left_semi").select(*shape)
    return "partial", _complete(claims, kept(carried.union(touched)))


def fast_run(docs: DataFrame) -> DataFrame:
    """Review cards of the most important sections of documents (doc_id, source_type, delta_status, text)."""
    chosen = kept(V.prioritised(V.sections(docs)))
    return V.cards(chosen, V.candidates(chosen))
