"""Lists as users see them: orders, partitions by status, duplicates and summaries of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import scoring

#: Places in lists.
CATEGORY_ORDER = ("contradiction", "policy_conflict", "implementation_drift", "missing_documentation", "traceability_gap", "clarification_needed")
GOLD_PRIORITY = {"contradiction": 0, "policy_conflict": 0, "implementation_drift": 1, "missing_documentation": 2, "traceability_gap": 2, "clarification_needed": 3}


def _ranked(column: str, table: dict[str, int], other: int):
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def findings_list(findings: DataFrame, by: str = "severity", category: str | None = None) -> DataFrame:
    """Findings of a category, or all, with their place by severity (severity, category, title) or by category
    (category, severity, title); titles by code points, then by the finding's number."""
    mine = findings if category is None else findings.where(F.col("category") == category)
    keys = [_ranked("severity", scoring.SEVERITY, 9), _ranked("category", {c: i for i, c in enumerate(CATEGORY_ORDER)}, len(CATEGORY_ORDER))]
    order = [*(keys if by == "severity" else reversed(keys)), F.col("title"), F.col("finding_ord")]
    return mine.select("finding_ord", *(k.alias(f"k{i}") for i, k in enumerate(order))).orderBy(*(f"k{i}" for i in range(4))).select("finding_ord", F.col("k0"), F.col("k1"))


def gold_order(findings: DataFrame) -> DataFrame:
    """finding_ord, priority, no_action, key: what gold cases are compared in the order of."""
    key = F.coalesce(F.nullif("object_key", F.lit("")), F.nullif("canonical_key", F.lit("")), F.col("title"))
    action = F.trim(F.coalesce("action", F.lit(""))) != ""
    return findings.select("finding_ord", _ranked("category", GOLD_PRIORITY, 2).alias("priority"), F.when(action, 0).otherwise(1).alias("no_action"), key.alias("key")).orderBy("priority", "no_action", "key", "finding_ord")


def load_order(findings: DataFrame) -> DataFrame:
    """Findings as a store returns them: severity by name, falling, then by number."""
    return findings.select("finding_ord", "severity").orderBy(F.desc("severity"), "finding_ord")


def deduped_cards(cards: DataFrame) -> DataFrame:
    """The first card of each kind, title and pair of sources, letter case aside."""
    key = F.sha1(F.concat_ws("|", "deviation_type", F.lower("title"), F.lower("source_a"), F.lower("source_b")))
    place = F.row_number().over(Window.partitionBy("card_key").orderBy("ord"))
    return cards.withColumn("card_key", key).withColumn("place", place).where("place = 1").drop("place")


def status_partitions(rows: DataFrame, statuses) -> DataFrame:
    """status, n: of each listed status, empty ones too, and of the others together."""
    known = F.when(F.col("status").isin(*statuses), F.col("status")).otherwise("other")
    every = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate((*statuses, "other"))], "status string, place int")
    counts = rows.select(known.alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", "place", F.coalesce("n", F.lit(0)).alias("n"))


def folder_summary(paths: DataFrame, most: int = 30) -> DataFrame:
    """The first folders by name with their numbers of files (path); files without a folder do not count."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return paths.select(folder.alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("files")).orderBy("folder").limit(most)
