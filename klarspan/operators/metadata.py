"""What a claim's wording and origin say about it, and how strong the path is that it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import semantics

# Words that decide, in this order.
SSOT = ("ssot", "target", "reference", "scope-matrix", "run-ssot", "contract")
GOVERNED = ("architecture", "policy", "process", "guardrail")
HISTORICAL = ("as_is", "legacy", "deprecated", "historic", "archive")
DEPRECATED = ("deprecated", "legacy", "historic", "veraltet", "removed", "entfaellt", "entfällt")
NOT_SSOT = ("not ssot", "kein ssot", "nicht ssot")
SECONDARY = ("secondary only", "sekundaer", "sekundär")
EXCLUDED = ("excluded", "ausgeschlossen", "without ", "ohne ", "kein ", "keine ", "not ")
FORBIDDING = ("no ", "not ", "without ", "ohne ")
ROLES = (
    ("legacy", ("deprecated", "legacy", "historic", "veraltet", "removed", "archive")),
    ("fallback", ("fallback", "degrade")),
    ("compat", ("compat", "compatibility", "v1 path", "legacy api")),
    ("secondary", ("secondary", "side path", "nebenpfad", "alternate", "alternative path")),
    ("primary", ("primary", "main path", "canonical", "hauptpfad", "ssot")),
)
DOMAIN_DEPRECATED = r"(?i)(?:\bdeprecated\b|\blegacy\b|\bhistoric\b|\bveraltet\b|\bentf[aä]llt\b|\bentfaellt\b|\bremoved\b)"
DOMAIN_NOT_SSOT = r"(?i)(?:\bnot\s+ssot\b|\bkein\s+ssot\b|\bnicht\s+ssot\b|\bsekund[aä]r\b|\bsecondary\b)"
DOMAIN_NEGATION = r"(?i)(?:\bno\b|\bkein(?:e|er|em|en)?\b|\bwithout\b|\bnicht\b|\bexcluded\b|\bausgeschlossen\b|\bnot\b)"
STRONGER = ("approval required", "approval", "guarded", "review", "phase_run_id", "audit envelope", "ssot", "canonical", "validated")
WEAKER = ("without approval", "direct write", "direct publish", "bypass", "manual", "compat", "legacy", "fallback", "degraded", "v1", "raw")
NONCANONICAL = ("legacy", "compat", "fallback", "degraded", "secondary", "bypass", "direct", "manual", "v1")


def has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def focus_value(value: Column, matched: Column) -> Column:
    """The value (else the matched text) behind `[...]: `, or behind `: ` if at least 8 characters follow."""
    compact = F.left(F.trim(F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), matched, F.lit("")), r"\s+", " ")), F.lit(180))
    after = lambda mark: F.substr(compact, F.instr(compact, mark) + len(mark))
    return F.when(F.contains(compact, F.lit("]: ")) & F.contains(compact, F.lit("[")), after("]: ")).when(F.contains(compact, F.lit(": ")) & (F.length(after(": ")) >= 8), after(": ")).otherwise(compact)


def claim_metadata(claims: DataFrame) -> DataFrame:
    """The claims (subject_key, predicate, normalized_value, matched_text, section_path, source_type, title, path_hint)
    with root, property, focus, operator, constraint, value kind, governance, time, authority, status and path role."""
    predicate = F.lower("predicate")
    focus = F.lower("focus_value")
    named = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("path_hint", F.lit(""))))
    matched = F.lower(F.coalesce("matched_text", F.lit("")))
    governance = F.when(F.col("source_type") == "github_file", "implementation").when(has_any(F.concat_ws(" ", named, predicate), SSOT), "ssot").when(has_any(F.concat_ws(" ", named, predicate), GOVERNED), "governed").when(has_any(F.concat_ws(" ", named, predicate), HISTORICAL), "historical").otherwise("working_doc")
    time = F.when(has_any(named, HISTORICAL), "historical").when(has_any(named, ("target", "ssot", "reference")), "target").otherwise("current")
    whole = F.concat_ws(" ", named, matched)
    status = F.when(has_any(whole, DEPRECATED), "deprecated").when(has_any(matched, NOT_SSOT), "not_ssot").when(has_any(whole, SECONDARY), "secondary_only").when(has_any(matched, EXCLUDED) & ~F.contains(matched, F.lit("not null")), "excluded").otherwise("asserted")
    role = F.lit("")
    local = F.concat_ws(" ", named, F.lower(F.coalesce("section_path", F.lit(""))), matched)
    for name, words in reversed(ROLES):
        role = F.when(has_any(local, words), name).otherwise(role)
    operator = (
        F.when(has_any(predicate, ("phase_count", "question_count", "label_count")), "count_equals").when(has_any(predicate, ("phase_order",)), "order_equals").when(has_any(predicate, ("reference",)), "references")
        .when(has_any(predicate, ("policy", "approval")), F.when(has_any(focus, FORBIDDING), "forbids").otherwise("requires")).when(has_any(predicate, ("implemented", "documented", "metamodel")), "describes").otherwise("states")
    )
    kind = F.when(has_any(predicate, ("count", "order")), "numeric").when(has_any(predicate, ("reference", "label_count")), "reference").when(has_any(predicate, ("policy", "lifecycle", "write", "read")), "constraint").otherwise("text")
    constrained = has_any(predicate, ("policy", "approval", "scope_policy", "lifecycle", "review_status", "write", "read"))
    dot = F.instr("subject_key", ".")
    out = claims.withColumn("focus_value", focus_value(F.col("normalized_value"), F.col("matched_text"))).withColumn("governance_level", governance).withColumn("temporal_status", time)
    authority = F.when(F.col("governance_level").isin("ssot", "governed", "implementation"), F.col("governance_level")).when((F.col("governance_level") == "historical") | (F.col("temporal_status") == "historical"), "historical").otherwise("working_doc")
    return out.withColumns({
        "subject_root": F.when(dot > 0, F.left("subject_key", dot - 1)).otherwise(F.col("subject_key")), "property": F.when(dot > 0, F.substr("subject_key", dot + 1)).otherwise(F.col("predicate")),
        "operator": operator, "value_constraint": F.when(constrained, F.col("focus_value")).otherwise(""), "value_kind": kind, "scope_key": semantics.scope_key(F.col("subject_key")),
        "derived_authority": authority, "derived_status": status, "path_role": role,
    })


def domain_metadata(claims: DataFrame) -> DataFrame:
    """Status, authority and operator as domain claims have them; their order of rules is another one."""
    named = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("path_hint", F.lit("")), F.coalesce("source_id", F.lit(""))))
    status = F.when(F.col("matched_text").rlike(DOMAIN_DEPRECATED), "deprecated").when(F.col("matched_text").rlike(DOMAIN_NOT_SSOT), "not_ssot").when(F.col("matched_text").rlike(DOMAIN_NEGATION), "excluded").otherwise("asserted")
    authority = F.when((F.col("source_type") == "metamodel") | has_any(named, SSOT), "ssot").when(has_any(named, GOVERNED), "governed").when(has_any(named, HISTORICAL), "historical").when(F.col("source_type") == "github_file", "implementation").otherwise("working_doc")
    predicate = F.lower("predicate")
    operator = F.when(F.col("domain_status").isin("excluded", "not_ssot"), "forbids").when(has_any(predicate, ("status", "lifecycle")), "defines").when(has_any(predicate, ("hierarchy", "chain", "role")), "describes").otherwise("states")
    return claims.withColumn("domain_status", status).withColumn("domain_authority", authority).withColumn("domain_operator", operator)


def path_strength(*parts: Column) -> Column:
    """Points of a described path: two for each word of the strong kind, minus two for each of the weak kind."""
    text = F.lower(F.translate(F.concat_ws(" ", *parts), "_-", "  "))
    score = F.lit(0)
    for words, points in ((STRONGER, 2), (WEAKER, -2), (("primary",), 1), (("secondary",), -1)):
        for w in words:
            score = score + F.when(F.contains(text, F.lit(w)), points).otherwise(0)
    return score


def path_groups(records: DataFrame) -> DataFrame:
    """Records (subject_key, family, strength, normalized_value, source_id) by family of path. A group's strength is its
    strongest record's, at least zero."""
    return records.groupBy("subject_key", "family").agg(F.greatest(F.lit(0), F.max("strength")).alias("strength"), F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"))


def inferred_variants(records: DataFrame) -> DataFrame:
    """Families of a subject that look like side paths: it has at least two families of unlike strength, the strongest
    ones are the primary paths, and another family's values differ from theirs while it is weaker."""
    groups = path_groups(records)
    by = Window.partitionBy("subject_key")
    groups = groups.withColumn("families", F.count("*").over(by)).withColumn("top", F.max("strength").over(by)).withColumn("least", F.min("strength").over(by)).where("families > 1 AND top > least")
    values = records.select("subject_key", "family", "normalized_value").distinct().join(groups.select("subject_key", "family", (F.col("strength") == F.col("top")).alias("is_primary")), ["subject_key", "family"])
    base = values.where("is_primary").select("subject_key", "normalized_value").distinct()
    unlike = values.where("NOT is_primary").join(base, ["subject_key", "normalized_value"], "left_anti").groupBy("subject_key", "family").agg(F.count("*").alias("n_unlike"))
    weak = groups.where("strength < top").join(unlike, ["subject_key", "family"])
    return weak.select("subject_key", "family", "strength", F.col("top").alias("primary_strength"), "n_unlike", has_any(F.lower("family"), NONCANONICAL).alias("noncanonical"))
