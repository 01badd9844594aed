"""Side paths of an implementation against the leading ones: which records are which, and how their chains differ.

Records of a subject (record_id, subject_key, source_type, source_id, role, value, chains) carry their role, if one is
marked, and chains of what they delegate to: arrays of qualified names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.functions.text import common_prefix
from klarspan.operators.metadata import NONCANONICAL, has_any

VARIANTS = ("secondary", "legacy", "fallback", "compat", "historical", "deprecated")
DOCUMENTS = ("confluence_page", "local_doc", "metamodel")


def chain_alignment(a: Column, b: Column) -> Column:
    """Of two chains: the qualified names they share, leading and trailing ones that agree, and last names they share."""
    last = lambda c: F.array_distinct(F.transform(c, lambda x: F.substring_index(x, ".", -1)))
    prefix, suffix = common_prefix(a, b), common_prefix(F.reverse(a), F.reverse(b))
    return F.struct(F.size(F.array_intersect(a, b)).alias("qualified"), prefix.alias("prefix"), suffix.alias("suffix"), F.size(F.array_intersect(last(a), last(b))).alias("simple"))


def family(chains: Column, source_id: Column) -> Column:
    """A record's family: the qualified names of its chains, or its source if it has none."""
    names = F.array_sort(F.array_distinct(F.flatten(chains)))
    return F.when(F.size(names) > 0, F.array_join(names, "|")).otherwise(source_id)


def roles(records: DataFrame) -> DataFrame:
    """Records with ``path_role`` (primary, variant or null) and ``inferred``. Marked roles stand; documents without a
    mark are primary where a subject has no marked primary record. Code without a mark is told by its strength: families at
    least as strong as the primary records (or, if there are none, the strongest of several) are primary, others whose
    values differ from these are variants if they are weaker or named like a side path."""
    by = "subject_key"
    rows = records.withColumn("family", family(F.col("chains"), F.col("source_id"))).withColumn("is_doc", F.col("source_type").isin(*DOCUMENTS))
    marked = F.when(F.col("role") == "primary", "primary").when(F.col("role").isin(*VARIANTS), "variant")
    rows = rows.withColumn("marked", marked)
    subject = rows.groupBy(by).agg(F.bool_or(F.coalesce(F.col("marked") == "primary", F.lit(False))).alias("has_primary"))
    rows = rows.join(subject, by).withColumn("known", F.coalesce("marked", F.when(F.col("is_doc") & ~F.col("has_primary"), "primary")))
    lead = rows.where("known = 'primary'").groupBy(by).agg(F.max("strength").alias("lead"))
    groups = rows.where("known IS NULL AND NOT is_doc").groupBy(by, "family").agg(F.greatest(F.lit(0), F.max("strength")).alias("group_strength"))
    extent = groups.groupBy(by).agg(F.count("*").alias("families"), F.max("group_strength").alias("top"), F.min("group_strength").alias("least")).join(lead, by, "left")
    extent = extent.where((F.col("families") > 1) & (F.col("lead").isNotNull() | (F.col("top") > F.col("least"))))
    judged = groups.join(extent, by).withColumn("base", F.coalesce("lead", "top")).withColumn("leads", F.when(F.col("lead").isNotNull(), F.col("group_strength") >= F.col("lead")).otherwise(F.col("group_strength") == F.col("top")))
    # without marked or documented primary records, the strongest families are what the others are compared to
    named = rows.where("known IS NULL AND NOT is_doc").join(judged.select(by, "family", "leads", "base", "group_strength", "lead"), [by, "family"], "left")
    baseline = named.where("leads AND lead IS NULL").select(by, "value").union(rows.where("known = 'primary'").select(by, "value")).distinct()
    unlike = named.where("NOT leads").select(by, "family", "value").distinct().join(baseline, [by, "value"], "left_anti").select(by, "family").distinct().withColumn("unlike", F.lit(True))
    named = named.join(unlike, [by, "family"], "left")
    weaker = (F.col("group_strength") < F.col("base")) | has_any(F.lower("family"), NONCANONICAL)
    guess = F.when(F.col("leads") & F.col("lead").isNull(), "primary").when(~F.col("leads") & F.coalesce("unlike", F.lit(False)) & weaker, "variant")
    told = named.select("record_id", guess.alias("guess"))
    return rows.join(told, "record_id", "left").select(*records.columns, "family", "is_doc", F.coalesce("known", "guess").alias("path_role"), (F.col("known").isNull() & F.col("guess").isNotNull()).alias("inferred"))


def compared(told: DataFrame) -> DataFrame:
    """For each variant record the primary one whose chains come nearest: most qualified names shared, then the longest
    common start, then end, then shared last names, then the primary with most names, documents first, and the first source.
    Distinct sets of chains of a subject meet, each primary one under its first record."""
    by = "subject_key"
    own = told.where("path_role = 'variant'").select(by, "family", "chains").distinct().withColumnRenamed("family", "variant_family")
    primary = told.where("path_role = 'primary'").groupBy(by, F.col("family").alias("primary_family"), F.col("chains").alias("primary_chains")).agg(F.min(F.struct((~F.col("is_doc")).alias("later"), "source_id", "record_id")).alias("first"))
    best = lambda a, b: F.array_max(F.coalesce(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: chain_alignment(x, y)))), F.array()))
    score = F.coalesce(best(F.col("chains"), F.col("primary_chains")), F.struct(*(F.lit(0).alias(n) for n in ("qualified", "prefix", "suffix", "simple"))))
    size = F.size(F.array_distinct(F.flatten("primary_chains")))
    rank = F.struct((-F.col("score.qualified")).alias("q"), (-F.col("score.prefix")).alias("p"), (-F.col("score.suffix")).alias("s"), (-F.col("score.simple")).alias("l"), (-size).alias("n"), "first.later", "first.source_id", "first.record_id", "primary_family", "score")
    met = own.join(primary, by).withColumn("score", score).groupBy(by, "variant_family", "chains").agg(F.min(rank).alias("best"))
    rows = told.where("path_role = 'variant'").withColumnRenamed("family", "variant_family").join(met, [by, "variant_family", "chains"])
    shared = F.when(F.col("best.score.qualified") > 0, "qualified").when(F.col("best.score.simple") > 0, "simple").otherwise("none")
    return rows.select(by, F.col("record_id").alias("variant_id"), "variant_family", F.col("best.record_id").alias("primary_id"), "best.primary_family", "best.score.qualified", "best.score.prefix", "best.score.suffix", "best.score.simple", shared.alias("alignment"))


def legacy_path_gaps(records: DataFrame) -> DataFrame:
    """A finding for each subject that has primary and variant records of unlike values: how many of each, the families
    that met, those primary ones without a variant, and whether any role had to be inferred. Lists name families of one
    subject, as counts and their smallest."""
    by = "subject_key"
    told = roles(records)
    sides = told.where("path_role IS NOT NULL").groupBy(by).agg(F.count_if(F.col("path_role") == "primary").alias("n_primary"), F.count_if(F.col("path_role") == "variant").alias("n_variants"), F.bool_or("inferred").alias("inferred"))
    sides = sides.where("n_primary > 0 AND n_variants > 0")
    values = told.where("path_role IS NOT NULL").groupBy(by, "value").agg(F.bool_or(F.col("path_role") == "variant").alias("v"), F.bool_or(F.col("path_role") == "primary").alias("p"))
    conflict = values.groupBy(by).agg(F.bool_or(F.col("v") & ~F.col("p")).alias("unlike")).where("unlike").select(by)
    pairs = compared(told)
    met = pairs.groupBy(by).agg(F.count_distinct("variant_family").alias("variant_families"), F.count_distinct("primary_family").alias("met_families"), F.max("qualified").alias("most_shared"), F.min("alignment").alias("alignment"))
    all_primary = told.where("path_role = 'primary'").groupBy(by).agg(F.count_distinct("family").alias("primary_families"))
    out = sides.join(conflict, by, "left_semi").join(met, by).join(all_primary, by)
    return out.select(by, F.lit("legacy_path_gap").alias("category"), F.lit("high").alias("severity"), "n_primary", "n_variants", "inferred", "variant_families", "met_families", (F.col("primary_families") - F.col("met_families")).alias("unmet_families"), "most_shared", "alignment")
