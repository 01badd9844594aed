"""Claims: first-wins deduplication, filters, consensus, and the differences between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import scoring, semantics, text
from klarspan.operators.graph import kept

DOCS = ("confluence_page", "local_doc")
CODE = ("github_file",)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def deduplicated(claims: DataFrame) -> DataFrame:
    """One claim a fingerprint, the first in input order."""
    return first_by(claims, ["fingerprint"], ["record_ord"])


def is_historical() -> Column:
    return (F.col("source_authority") == "historical") | F.col("temporal").isin("historic", "historical") | F.col("governance").isin("historic", "historical")


def is_primary() -> Column:
    """Evidence that counts on its own: asserted, not secondary, not historical."""
    return ~F.coalesce(F.col("assertion_status"), F.lit("asserted")).isin("deprecated", "secondary_only", "not_ssot") & ~F.coalesce(is_historical(), F.lit(False))


def counts_as_target() -> Column:
    return (F.col("source_authority") != "historical") & (F.col("assertion_status") != "secondary_only")


def descriptor() -> Column:
    return F.concat_ws(" ", "source_type", "title", "path_hint", "governance", "temporal")


def voted(claims: DataFrame) -> DataFrame:
    """Claims that vote, with their trimmed value and weight in hundredths."""
    votes = claims.where((F.coalesce("assertion_status", F.lit("asserted")) != "secondary_only") & (F.trim("normalized_value") != ""))
    return votes.withColumn("value", F.trim("normalized_value")).withColumn("weight", scoring.entry_weight(F.col("source_type"), descriptor(), F.col("source_authority"), F.col("assertion_status")).cast("long"))


def voted_values(votes: DataFrame) -> DataFrame:
    """The distinct values of each aspect with their votes and bucket: buckets are made once a value, not once a claim."""
    values = votes.groupBy("subject_key", "predicate", "value").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("votes"), F.min("record_ord").alias("first_ord"),
        F.bool_or(F.col("source_type").isin("confluence_page", "local_doc", "metamodel") & counts_as_target()).alias("has_doc"), F.bool_or(F.col("source_type").isin(*CODE)).alias("has_code"),
    )
    return values.withColumn("bucket", semantics.consensus_bucket(F.col("subject_key"), F.col("predicate"), F.col("value")))


def truth_targets(aspects: DataFrame, truths: DataFrame) -> DataFrame:
    """For each (subject_key, predicate): the value of the active explicit truth on it, else of the first truth on a
    dotted ancestor. Ancestors are exploded, so this is an equi join."""
    explicit = truths.where("truth_status = 'active' AND source_kind IN ('user_specification', 'user_acceptance')")
    explicit = explicit.groupBy(F.col("subject_key").alias("truth_subject"), F.col("predicate")).agg(F.max_by("normalized_value", "truth_ord").alias("truth_value"), F.min("truth_ord").alias("truth_ord"))
    up = aspects.select("subject_key", "predicate").distinct().withColumn("truth_subject", F.explode(text.ancestors(F.col("subject_key"))))
    found = up.join(explicit, ["truth_subject", "predicate"])
    order = F.struct((F.col("truth_subject") != F.col("subject_key")).alias("far"), "truth_ord")
    return found.groupBy("subject_key", "predicate").agg(F.min_by("truth_value", order).alias("truth_value"))


def consensus(claims: DataFrame, truths: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row for each aspect (subject, predicate) of at least two votes: winner, share, and who covers it."""
    values = voted_values(voted(claims)) if values is None else values
    buckets = values.groupBy("subject_key", "predicate", "bucket").agg(F.sum("weight").alias("weight"), F.sum("votes").alias("votes"), F.min_by("value", "first_ord").alias("shown"), F.bool_or("has_doc").alias("has_doc"), F.bool_or("has_code").alias("has_code"))
    best = F.max_by(F.struct("bucket", "weight", "shown"), F.struct("weight", "votes", "bucket"))
    aspects = buckets.groupBy("subject_key", "predicate").agg(best.alias("best"), F.sum("weight").alias("total"), F.sum("votes").alias("votes"), F.count("*").alias("n_buckets"), F.bool_or("has_doc").alias("has_doc"), F.bool_or("has_code").alias("has_code"))
    aspects = aspects.where("votes >= 2").join(truth_targets(aspects, truths), ["subject_key", "predicate"], "left")
    fixed = F.col("truth_value").isNotNull()
    winner = F.when(fixed, semantics.consensus_bucket(F.col("subject_key"), F.col("predicate"), F.col("truth_value"))).otherwise(F.col("best.bucket"))
    clear = fixed | (2 * F.col("best.weight") > F.col("total"))
    kind = F.when(clear, "clear").when(F.col("n_buckets") > 1, "ambiguous").otherwise("open")
    process_only = ((F.col("subject_key") == "BSM.process") | F.startswith("subject_key", F.lit("BSM.phase."))) & F.col("predicate").isin("phase_count", "phase_reference", "phase_order", "question_count", "question_reference")
    gap = F.when(F.col("has_code") & ~F.col("has_doc"), "code_only").when(F.col("has_doc") & ~F.col("has_code") & ~process_only, "doc_only")
    return aspects.select("subject_key", "predicate", winner.alias("target"), F.coalesce("truth_value", "best.shown").alias("shown"), F.when(fixed, F.lit(100)).otherwise(F.floor(100 * F.col("best.weight") / F.col("total"))).cast("long").alias("percent"), fixed.alias("truth_fixed"), kind.alias("kind"), gap.alias("gap"), "votes")


def deviations(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """Sources that contradict a clear target: one row for each aspect and source."""
    votes = voted(claims)
    values = kept(voted_values(votes))
    targets = consensus(claims, truths, values).where("kind = 'clear'").select("subject_key", "predicate", "target", "truth_fixed", "shown")
    off = values.join(targets, ["subject_key", "predicate"]).where("bucket <> target").select("subject_key", "predicate", "value", "truth_fixed", "shown")
    off = votes.select("subject_key", "predicate", "value", "source_type", "source_id").join(off, ["subject_key", "predicate", "value"])
    return off.groupBy("subject_key", "predicate", "source_type", "source_id").agg(
        F.first("shown").alias("target_value"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("deviating"), F.when(F.first("truth_fixed"), "critical").otherwise("high").alias("severity"), F.count("*").alias("n_claims")
    )


def top_buckets(claims: DataFrame, n: int = 2) -> DataFrame:
    """The n heaviest buckets of each aspect."""
    buckets = voted_values(voted(claims)).groupBy("subject_key", "predicate", "bucket").agg(F.sum("weight").alias("weight"), F.sum("votes").alias("votes"))
    place = F.row_number().over(Window.partitionBy("subject_key", "predicate").orderBy(F.desc("weight"), F.desc("votes"), "bucket"))
    return buckets.withColumn("place", place).where(F.col("place") <= n)


def source_delta(current: DataFrame, previous: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Each current row against the previous one of its key: added, unchanged or changed. Previous keys are unique."""
    before = previous.select(*keys, F.col(content).alias("_before"))
    joined = current.join(before, keys, "left")
    return joined.withColumn("delta_status", F.when(F.col("_before").isNull(), "added").when(F.col("_before") == F.col(content), "unchanged").otherwise("changed")).drop("_before")


def claim_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Each claim against the run before: the same fingerprint is unchanged; the same identity with an aligned value is
    a change of text only, with other values a change of meaning; a new identity is added."""
    identity = ["source_type", "source_id", "subject_key", "predicate"]
    before = previous.groupBy(*identity).agg(F.collect_set("normalized_value").alias("_values"))
    exact = previous.select("fingerprint").distinct().withColumn("_exact", F.lit(True))
    joined = current.join(exact, "fingerprint", "left")
    tags = lambda v: semantics.signature(F.col("subject_key"), F.col("predicate"), v)
    # signatures of the values before are made once for each distinct (aspect, value), not for each claim
    before_tags = before.withColumn("_tagged", F.transform("_values", lambda v: F.struct(v.alias("v"), tags(v).alias("t")))).select(*identity, "_tagged")
    joined = joined.join(before_tags, identity, "left")
    # the claim's own signature stands inside the case, so that exact and new claims never need it
    aligned = semantics.let(tags(F.col("normalized_value")), lambda own: F.exists("_tagged", lambda b: semantics.values_aligned(own, b["t"], F.col("normalized_value"), b["v"])))
    status = F.when(F.col("_exact"), "unchanged").when(F.col("_tagged").isNull(), "added").otherwise("changed")
    change = F.when(F.col("_exact"), "exact").when(F.col("_tagged").isNull(), "new_identity").when(aligned, "textual_only").otherwise("semantic")
    return joined.withColumn("delta_status", status).withColumn("delta_change_type", change).drop("_exact", "_tagged")


def impacted_scopes(delta: DataFrame, truths: DataFrame) -> DataFrame:
    """Scopes of claims whose meaning changed and of truths whose recalculation is pending."""
    changed = delta.where("delta_status = 'added' OR delta_change_type = 'semantic'").select(semantics.scope_key(F.col("subject_key")).alias("scope_key"))
    pending = truths.where("truth_status = 'active' AND source_kind IN ('user_specification', 'user_acceptance') AND pending_delta_recalculation").select(semantics.scope_key(F.col("subject_key")).alias("scope_key"))
    return changed.union(pending).distinct()


def in_scopes(claims: DataFrame, scopes: DataFrame) -> DataFrame:
    """Claims of the metamodel, and those whose package scope or subject is among the scopes."""
    model = claims.where("source_type = 'metamodel'")
    rest = claims.where("source_type <> 'metamodel'").withColumn("_scope", semantics.scope_key(F.col("subject_key")))
    named = rest.withColumn("_key", F.explode(F.array_distinct(F.array("_scope", "subject_key")))).join(scopes.select(F.col("scope_key").alias("_key")), "_key", "left_semi")
    return model.unionByName(named.dropDuplicates(["record_ord"]).select(*claims.columns))


def truth_conflicts(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """Primary claims that contradict an active explicit truth on their subject or a dotted ancestor: one row for each
    truth and source. The ancestors of a subject are exploded, so the prefix join is an equi join."""
    explicit = truths.where("truth_status = 'active' AND source_kind IN ('user_specification', 'user_acceptance')")
    explicit = explicit.select("canonical_key", F.col("subject_key").alias("truth_subject"), F.col("normalized_value").alias("truth_value"))
    near = claims.where(is_primary()).withColumn("truth_subject", F.explode(text.ancestors(F.col("subject_key")))).join(explicit, "truth_subject")
    tags = lambda v: F.array(semantics.signature(F.col("subject_key"), F.col("predicate"), v))
    near = near.withColumn("_own", tags(F.col("normalized_value"))).withColumn("_truth", tags(F.col("truth_value")))
    hit = near.where(semantics.signatures_conflict(F.col("_own"), F.col("_truth"), F.array("normalized_value"), F.array("truth_value")))
    return hit.groupBy("canonical_key", "source_type", "source_id").agg(F.count("*").alias("n_claims"), F.min("record_ord").alias("first_ord"), F.min_by("normalized_value", "record_ord").alias("first_value"))
