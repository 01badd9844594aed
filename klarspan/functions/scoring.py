"""Weights, ranks and root causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klarspan.functions.semantics import contains_any, ends_with_any

# Weights in hundredths, so that sums are exact.
SOURCE_WEIGHT = {"metamodel": 110, "confluence_page": 100, "local_doc": 95, "github_file": 78}
OTHER_SOURCE = 70
AUTHORITY_WEIGHT = {"explicit_truth": 250, "confirmed_decision": 160, "ssot": 100, "governed": 45, "working_doc": 15, "implementation": 0, "runtime_observation": -5, "historical": -55, "heuristic": -10}
DESCRIPTOR_WEIGHT = ((("ssot", "target", "reference", "scope-matrix", "run-ssot", "contract"), 35), (("architecture", "policy", "process", "guardrail", "governed"), 15), (("as_is", "legacy", "deprecated", "archive", "historic", "historical"), -40))
GENERATED, TEST_PATHS = ("generated", "export", "dump"), ("/tests/", "fixture", "mock")
WEAK_STATUS = ("deprecated", "secondary_only", "not_ssot")
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
ROOT_CAUSE = {"truth": 0, "write_contract": 1, "policy": 2, "lifecycle": 3, "process": 4, "implementation": 5, "documentation": 6, "clarification": 7, "misc": 8}
CORE = ("truth", "write_contract", "policy", "lifecycle", "process")
CONFLICTS = ("contradiction", "policy_conflict")
SUPPORTING = ("architecture_observation", "missing_definition", "missing_documentation", "traceability_gap", "ownership_gap", "low_confidence_review", "obsolete_documentation", "stale_source", "clarification_needed", "terminology_collision", "open_decision")
DOCUMENTARY = ("architecture_observation", "missing_definition", "missing_documentation", "traceability_gap", "ownership_gap", "low_confidence_review", "obsolete_documentation", "stale_source", "terminology_collision")
ACTION_LANES = ("both", "artifact", "document", "code")


def lookup(key: Column, table: dict, otherwise=None) -> Column:
    found = F.lit(otherwise)
    for name, value in reversed(list(table.items())):
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def entry_weight(source: Column, descriptor: Column, authority: Column, status: Column) -> Column:
    """Hundredths of a claim's vote, at least 20. The descriptor joins source, title, path, governance and time status."""
    text = F.lower(descriptor)
    code = source == "github_file"
    weight = lookup(source, SOURCE_WEIGHT, OTHER_SOURCE)
    for words, points in DESCRIPTOR_WEIGHT:
        weight = weight + F.when(contains_any(text, words), points).otherwise(0)
    weight = weight - F.when(contains_any(text, GENERATED) & (source != "metamodel"), 10).otherwise(0)
    weight = weight - F.when(code & contains_any(text, TEST_PATHS), 25).otherwise(0)
    weight = weight + lookup(authority, AUTHORITY_WEIGHT, 0)
    weight = weight - F.when(status.isin(*WEAK_STATUS), 25).otherwise(0)
    return F.greatest(weight, F.lit(20))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY, 9)


def root_cause_priority(bucket: Column) -> Column:
    return lookup(F.trim(F.coalesce(bucket, F.lit(""))), ROOT_CAUSE, 99)


def root_cause(object_key: Column, category: Column, text: Column, truth: Column, causal: Column | None = None) -> Column:
    """The causal bucket where one is known, else the first that key, category or text suggest."""
    words = F.lower(F.concat_ws(" ", object_key, category, text))
    found = (
        F.when(truth, "truth")
        .when(ends_with_any(object_key, ("write_path", "read_path")) | (category == "read_write_gap") | contains_any(words, ("write contract", "read contract", "write path", "read path")), "write_contract")
        .when(ends_with_any(object_key, ("policy", "approval_policy", "scope_policy")) | category.isin("policy_conflict", "legacy_path_gap") | contains_any(words, ("approval", "guardrail", "policy")), "policy")
        .when(ends_with_any(object_key, ("lifecycle", "review_status")) | contains_any(words, ("lifecycle", "review status", "status-kanon", "status canon")), "lifecycle")
        .when((object_key == "BSM.process") | F.startswith(object_key, F.lit("BSM.phase.")) | F.startswith(object_key, F.lit("BSM.process.")) | contains_any(words, ("bsm.process", "bsm process", "bsm phase", "phase count", "phase source", "phasenmodell")), "process")
        .when(category == "implementation_drift", "implementation")
        .when(category.isin(*DOCUMENTARY), "documentation")
        .when(category.isin("clarification_needed", "open_decision"), "clarification")
        .otherwise("misc")
    )
    return found if causal is None else F.when(F.trim(F.coalesce(causal, F.lit(""))) != "", F.trim(causal)).otherwise(found)


def detail_penalty(category: Column) -> Column:
    return category.isin(*SUPPORTING).cast("int")


def conflict_priority(category: Column) -> Column:
    """0 for findings of a conflict, 2 for supporting details, 1 for all others."""
    return F.when(category.isin(*CONFLICTS), 0).when(category.isin(*SUPPORTING), 2).otherwise(1)
