"""What a run leaves and takes over: inherited truths, replaced claims, decisions as event logs, queues, caches, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.functions.text import common_prefix

EXPLICIT = "truth_status = 'active' AND source_kind IN ('user_specification', 'user_acceptance')"


def inherited_truths(truths: DataFrame, run: str) -> DataFrame:
    """Active truths for the next run under ids of their own; a pending recalculation triggers once."""
    return truths.where("truth_status = 'active'").select(F.left(F.sha2(F.concat_ws("|", F.lit(run), "canonical_key"), 256), F.lit(16)).alias("truth_id"), "canonical_key", "subject_key", "predicate", "normalized_value", F.col("pending_delta_recalculation").alias("retrigger"), F.lit(False).alias("pending"))


def with_derived_truth(truths: DataFrame, claims: DataFrame) -> DataFrame:
    """Active keys, and a system truth for the process's phase count if none is active and a claim states one."""
    active = truths.where("truth_status = 'active'").select("subject_key", "predicate", "normalized_value", "source_kind")
    stated = claims.where("subject_key = 'BSM.process' AND predicate = 'phase_count'").groupBy("subject_key", "predicate").agg(F.min_by("normalized_value", "record_ord").alias("normalized_value")).withColumn("source_kind", F.lit("system_inference"))
    return active.union(stated.join(active.select("subject_key", "predicate"), ["subject_key", "predicate"], "left_anti").select(*active.columns))


def replaced(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims with the value of the last change of their fingerprint."""
    last = changes.groupBy("fingerprint").agg(F.max_by("normalized_value", "ord").alias("_new"))
    return claims.join(last, "fingerprint", "left").withColumn("normalized_value", F.coalesce("_new", "normalized_value")).drop("_new")


def rehydrated(cached: DataFrame, documents: DataFrame) -> DataFrame:
    """Cached claims of documents that are reused, all or none of a source: a source with a claim that cannot be
    rebuilt (no evidence line) is left out."""
    whole = cached.groupBy("source_id").agg(F.bool_and(F.col("line").isNotNull()).alias("whole")).where("whole").select("source_id")
    return cached.join(documents.select("source_id").distinct(), "source_id", "left_semi").join(whole, "source_id", "left_semi")


def impacted_packages(members: DataFrame, decided: Column) -> DataFrame:
    """Packages (package, key) that share a key with the decided ones."""
    keys = members.where(decided).select("key").distinct()
    return members.where(~decided).join(keys, "key", "left_semi").select("package").distinct()


def current_state(events: DataFrame, key: str) -> DataFrame:
    """An event log (key, ord, action) as the state of each key: the last action that its order allows. A request is
    pending until it is approved, rejected or cancelled; only an approved one is executed, and once."""
    first = lambda a: F.min(F.when(F.col("action") == a, F.col("ord")))
    seen = events.groupBy(key).agg(*(first(a).alias(a) for a in ("requested", "approved", "rejected", "cancelled", "executed")))
    decided = F.least("approved", "rejected", "cancelled")
    state = F.when(F.col("requested").isNull(), None).when(decided.isNull(), "pending").when(decided == F.col("rejected"), "rejected").when(decided == F.col("cancelled"), "cancelled").when(F.col("executed") > F.col("approved"), "executed").otherwise("approved")
    return seen.select(key, state.alias("state")).where("state IS NOT NULL")


def next_in_queue(runs: DataFrame, now) -> DataFrame:
    """The run to take next: planned before abandoned (lease over), oldest first."""
    open_ = runs.where((F.col("status") == "planned") | ((F.col("status") == "running") & (F.col("lease_until") < F.lit(now).cast("timestamp"))))
    return open_.orderBy(F.when(F.col("status") == "planned", 0).otherwise(1), "created", "run_id").limit(1)


def gate(checks: DataFrame) -> DataFrame:
    """One row: whether all required checks (name, required, ok) hold, and the names of those that don't."""
    bad = F.col("required") & ~F.col("ok")
    return checks.agg((F.count_if(bad) == 0).alias("ready"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("name")))), "|").alias("blocking"))


def comment_statements(comments: DataFrame, most: int = 4) -> DataFrame:
    """The first statements of comments (comment_id, text), split at sentence ends and line breaks."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.!?;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    return comments.select("comment_id", F.posexplode(F.slice(parts, 1, most)).alias("ordinal", "statement"))


def baselines(variants: DataFrame, primaries: DataFrame) -> DataFrame:
    """For each variant path (subject_key, variant_id, path) the primary one that shares most elements, then the longest
    prefix, then documents first, then by name. Distinct paths of a subject meet, each primary one under its first name."""
    own = variants.select("subject_key", "path").distinct()
    first = primaries.groupBy("subject_key", F.col("path").alias("primary_path")).agg(F.min(F.struct((~F.col("is_doc")).alias("later"), F.col("source_id").alias("name"))).alias("first"))
    rank = F.struct((-F.size(F.array_intersect("path", "primary_path"))).alias("shared"), (-common_prefix(F.col("path"), F.col("primary_path"))).alias("prefix"), "first.later", "first.name")
    best = own.join(first, "subject_key").groupBy("subject_key", "path").agg(F.min(rank).alias("rank"))
    return variants.join(best, ["subject_key", "path"]).groupBy("variant_id").agg(F.min("rank").getField("name").alias("primary_id"))
