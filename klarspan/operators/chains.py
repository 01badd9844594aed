"""Evidence chains and architecture: variants, breaks, confirmed hops and kinds of asynchronous gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chain_variant_conflicts(claims: DataFrame, families) -> DataFrame:
    """A row for each family (name, word; the first that a value contains) of paths, if paths of two or more exist."""
    name = F.lit(None).cast("string")
    for family, word in reversed(families):
        name = F.when(F.contains(F.lower("normalized_value"), F.lit(word)), family).otherwise(name)
    found = claims.withColumn("family", name).where("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("normalized_value").alias("n_variants"), F.count_distinct("source_id").alias("n_sources"))
    return found.withColumn("families", F.count("*").over(Window.partitionBy(F.lit(1)))).where("families > 1").drop("families")  # a row for each of a few families


def chain_breaks(claims: DataFrame, first, second, group: str) -> DataFrame:
    """Groups in which only one of the two kinds of hops (predicates) is claimed, and which one is missing."""
    counts = claims.where(F.col("predicate").isin(*first, *second)).groupBy(group).agg(F.count_if(F.col("predicate").isin(*first)).alias("n_first"), F.count_if(F.col("predicate").isin(*second)).alias("n_second"))
    return counts.where("n_first = 0 OR n_second = 0").withColumn("missing", F.when(F.col("n_first") == 0, "first").otherwise("second"))


def architecture_observations(claims: DataFrame, predicates) -> DataFrame:
    """Subjects that two or more sources confirm, with the predicate that confirmed them first."""
    mine = claims.where(F.col("predicate").isin(*predicates))
    return mine.groupBy("subject_key").agg(F.count_distinct("source_id").alias("n_sources"), F.min_by("predicate", "record_ord").alias("predicate"), F.count("*").alias("n")).where("n_sources > 1")


def supported_risks(risks: DataFrame, support: DataFrame) -> DataFrame:
    """Risks (risk_id, source_id, subject_key) with what else their source says of the subject: number of claims,
    kinds of predicates, and the first function named."""
    index = support.groupBy("source_id", "subject_key").agg(F.count("*").alias("n_support"), F.count_distinct("predicate").alias("n_predicates"), F.min("function_name").alias("function_name"))
    return risks.join(index, ["source_id", "subject_key"], "left").select("risk_id", F.coalesce("n_support", F.lit(0)).alias("n_support"), F.coalesce("n_predicates", F.lit(0)).alias("n_predicates"), "function_name")


def gap_kinds(records: DataFrame, rules) -> DataFrame:
    """record_id and kind of each record (path, function_name): the first of the user's rules (kind, words of the path,
    words of the function) of which its path or function has a word, else `generic`."""
    kind = F.lit("generic")
    has = lambda c, words: [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)) for w in words]
    for name, paths, functions in reversed(rules):
        fits = F.lit(False)
        for test in (*has("path", paths), *has("function_name", functions)):
            fits = fits | test
        kind = F.when(fits, name).otherwise(kind)
    return records.withColumn("kind", kind)


def risk_findings(records: DataFrame, grouped) -> DataFrame:
    """Findings of risks (predicate, source_id, subject_key, kind): kinds that are grouped make one finding over all their
    sources, others one for each predicate, source and subject."""
    key = F.when(F.col("kind").isin(*grouped), F.concat_ws("|", "predicate", "kind")).otherwise(F.concat_ws("|", "predicate", "source_id", "subject_key"))
    return records.withColumn("finding_key", key).groupBy("finding_key").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"), F.count_distinct("subject_key").alias("n_subjects"), F.min("kind").alias("kind"))
