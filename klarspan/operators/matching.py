"""Findings and the segments, claims and model nodes that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import text

EXACT, NEARBY = 6, 4


def matched_segments(locations: DataFrame, segments: DataFrame) -> DataFrame:
    """finding_id, segment_id, exact, place: a finding's segments by its locations (finding_id, at, source_type,
    source_id, anchor, section_path, path_hint). Segments of the same source with the location's anchor, section or path
    come first, at most EXACT; without any, the source's first NEARBY. A location meets only the first segments of each
    key, so the join grows with the findings."""
    source = ["source_type", "source_id"]
    found = None
    for key in ("anchor", "section_path", "path_hint"):
        place = F.row_number().over(Window.partitionBy(*source, key).orderBy("ord"))
        first = segments.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("nr", place).where(F.col("nr") <= EXACT).select(*source, key, "segment_id", "ord")
        one = locations.join(first, [*source, key]).select("finding_id", "at", "ord", "segment_id")
        found = one if found is None else found.union(one)
    exact = found.withColumn("exact", F.lit(True))
    near = segments.withColumn("nr", F.row_number().over(Window.partitionBy(*source).orderBy("ord"))).where(F.col("nr") <= NEARBY).select(*source, "segment_id", "ord")
    nearby = locations.join(exact.select("finding_id").distinct(), "finding_id", "left_anti").join(near, source).select("finding_id", "at", "ord", "segment_id", F.lit(False).alias("exact"))
    every = exact.union(nearby).groupBy("finding_id", "segment_id", "exact").agg(F.min(F.struct("at", "ord")).alias("first"))
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("finding_id").orderBy("first", "segment_id")))
    return placed.where(F.col("place") <= F.when(F.col("exact"), EXACT).otherwise(NEARBY)).select("finding_id", "segment_id", "exact", "place")


def delta_insights(matched: DataFrame, segments: DataFrame) -> DataFrame:
    """Each finding's number of segments, the kinds of change among them, and its signal: stable, mixed or the one kind."""
    of = matched.join(segments.select("segment_id", "delta_status"), "segment_id")
    kinds = F.array_sort(F.collect_set(F.when(F.col("delta_status") != "unchanged", F.col("delta_status"))))
    out = of.groupBy("finding_id").agg(F.count("*").alias("n_segments"), kinds.alias("k"), F.count_if(F.col("delta_status") == "changed").alias("n_changed"), F.count_if(F.col("delta_status") == "added").alias("n_added"))
    signal = F.when(F.size("k") == 0, "stable").when(F.size("k") == 1, F.get("k", F.lit(0))).otherwise("mixed")
    return out.select("finding_id", "n_segments", F.array_join("k", "|").alias("statuses"), "n_changed", "n_added", signal.alias("signal"))


def finding_seeds(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """finding_id, node: a finding's own nodes (finding_id, node) where it has some; else the nodes of the claims on its
    object or on what lies below it."""
    own = findings.where("node IS NOT NULL").select("finding_id", "node").distinct()
    rest = findings.where("object_key <> ''").select("finding_id", "object_key").distinct().join(own.select("finding_id").distinct(), "finding_id", "left_anti")
    below = claims.select("subject_key", "node").distinct().select("node", F.explode(text.ancestors(F.col("subject_key"))).alias("object_key")).distinct()
    return own.union(rest.join(below, "object_key").select("finding_id", "node"))


def _name(*columns: str):
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def metaclasses(nodes: DataFrame, edges: DataFrame, most: int = 250) -> DataFrame:
    """Nodes with the label `metaclass`, by name: the packages that contain them and the kinds of their outgoing edges."""
    meta = nodes.where(F.array_contains("labels", "metaclass")).select("id", _name("name", "public_id", "id").alias("name"))
    holders = edges.where("kind = 'CONTAINS'").join(nodes.where(F.array_contains("labels", "package")).select(F.col("id").alias("src"), _name("name", "public_id").alias("package")), "src").groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("package")), "|").alias("packages"))
    outgoing = edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    return meta.join(holders, "id", "left").join(outgoing, "id", "left").fillna({"packages": "", "kinds": ""}).orderBy("name", "id").limit(most)


def model_functions(nodes: DataFrame, edges: DataFrame, ends: str = "Function", callers=("bsmQuestion", "bsmPhase"), most: int = 250) -> DataFrame:
    """Nodes with a label that ends as asked, by name: the questions and phases that refer to them, and how."""
    functions = nodes.where(F.exists("labels", lambda x: F.endswith(x, F.lit(ends)))).select("id", _name("name", "public_id", "id").alias("name"))
    referring = nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, callers)))).select(F.col("id").alias("src"), _name("public_id", "name", "id").alias("ref"))
    refs = edges.join(referring, "src").groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.array_join(F.array_sort(F.collect_set("ref")), "|").alias("refs"))
    return functions.join(refs, "id", "left").fillna({"kinds": "", "refs": ""}).orderBy("name", "id").limit(most)
