"""The semantic graph of claims, the causal edges it implies, and what they attribute and propagate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.functions import semantics, text
from klarspan.operators.graph import BACKWARD, FLOOR, kept

# Relation, edge type, direction (1 along, -1 against), strength in hundredths, mode.
EDGE_RULES = (
    ("truth_on", "constrains", 1, 95, "truth_only"),
    ("belongs_to", "contained_in", 1, 70, "both"),
    ("belongs_to", "contains", -1, 60, "both"),
    ("stated_by", "evidenced_by", 1, 50, "none"),
    ("implements", "implements", 1, 85, "both"),
    ("implements", "decides_write", -1, 80, "both"),
    ("documents", "documents", 1, 65, "delta_only"),
)


def relations(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): subjects in their scope, stated by sources, implemented or documented, and
    bound by truths. Equal relations merge at their highest confidence."""
    subject = F.concat(F.lit("subject:"), "subject_key")
    scope = F.concat(F.lit("scope:"), semantics.scope_key(F.col("subject_key")))
    source = F.concat(F.lit("source:"), "source_id")
    kind = F.when(F.col("source_type") == "github_file", "implements").when(F.col("source_type") == "metamodel", "stated_by").otherwise("documents")
    rows = claims.select(F.explode(F.array(F.struct(subject.alias("src"), scope.alias("dst"), F.lit("belongs_to").alias("relation"), F.lit(1.0).alias("confidence")), F.struct(source.alias("src"), subject.alias("dst"), kind.alias("relation"), F.col("confidence").alias("confidence")))).alias("r")).select("r.*")
    bound = truths.where("truth_status = 'active'").select(F.concat(F.lit("truth:"), "canonical_key").alias("src"), F.concat(F.lit("subject:"), "subject_key").alias("dst"), F.lit("truth_on").alias("relation"), F.lit(1.0).alias("confidence"))
    return rows.union(bound).groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence"))


def causal_edges(relations_: DataFrame) -> DataFrame:
    """Edges of the relations by the rule table: (src, dst, edge_type, mode, strength)."""
    spark = relations_.sparkSession
    rules = spark.createDataFrame(list(EDGE_RULES), "relation string, edge_type string, way int, points int, mode string")
    joined = relations_.join(F.broadcast(rules), "relation")  # the rules are a constant
    along = F.col("way") == 1
    return joined.select(F.when(along, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(along, F.col("dst")).otherwise(F.col("src")).alias("dst"), "edge_type", "mode", F.round(F.col("confidence") * F.col("points") / 100, 6).alias("strength"))


def truth_frames(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(truth, node, depth): what each truth reaches over edges that carry truths."""
    arcs = edges.where("mode IN ('truth_only', 'both')").select("src", "dst").distinct()
    frontier = kept(arcs.where("src LIKE 'truth:%'").select(F.col("src").alias("truth"), F.col("dst").alias("node"), F.lit(1).alias("depth")))
    seen = frontier
    for step in range(2, depth + 1):
        new = frontier.join(arcs, frontier.node == arcs.src).select("truth", F.col("dst").alias("node")).distinct().join(seen.select("truth", "node"), ["truth", "node"], "left_anti").withColumn("depth", F.lit(step))
        frontier = kept(new)
        seen = kept(seen.union(frontier))
    return seen


def attributed(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(seed, node, score): the best score of a cause within ``depth`` steps; steps against an edge count less. An
    edge counts FLOOR at least."""
    s = F.greatest(F.lit(FLOOR), F.col("strength"))
    arcs = edges.select("src", "dst", s.alias("s")).union(edges.select("dst", "src", s * BACKWARD)).groupBy("src", "dst").agg(F.max("s").alias("s"))
    arcs = kept(arcs)
    best = kept(seeds.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("score")))
    for _ in range(depth):
        grown = best.join(arcs, best.node == arcs.src).select("seed", F.col("dst").alias("node"), (F.col("score") * F.col("s")).alias("score"))
        best = kept(best.union(grown).groupBy("seed", "node").agg(F.max("score").alias("score")))
    return best.where("node <> seed")


# The edges that a relation makes: type, direction (1 along, -1 against), mode, what is taken off its
# confidence (which then keeps to 0.4 at least), whether it blocks, whether it carries truths (always, never, or if the
# relation's source or target decides), and whether it needs a target that is written.
RELATION_RULES = (
    ("derived_from_truth", "propagates_truth_to", 1, "truth_and_delta", 0.0, False, "always", False),
    ("governs", "propagates_truth_to", 1, "truth_and_delta", 0.0, False, "always", False),
    ("governs", "gated_by", -1, "delta_only", 0.02, True, "always", False),
    ("contains", "propagates_truth_to", 1, "truth_and_delta", 0.0, False, "source", False),
    ("contains", "depends_on", -1, "delta_only", 0.04, False, "source", False),
    ("belongs_to", "depends_on", 1, "truth_and_delta", 0.0, False, "target", False),
    ("references", "depends_on", 1, "delta_only", 0.0, False, "target", False),
    ("implements", "implemented_by", -1, "truth_and_delta", 0.0, False, "target", False),
    ("implements", "decides_write", 1, "truth_and_delta", 0.02, False, "always", True),
    ("documents", "evidenced_by", -1, "none", 0.0, False, "never", False),
)


def typed_edges(relations_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type, mode, strength, blocking, truth_relevant) of relations (src, dst, relation, confidence)
    between nodes (node, decision_relevant, write_relevant), by RELATION_RULES."""
    rules = relations_.sparkSession.createDataFrame(list(RELATION_RULES), "relation string, edge_type string, way int, mode string, less double, blocking boolean, carries string, written boolean")
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("decision_relevant").alias(f"{s}_decides"), F.col("write_relevant").alias(f"{s}_written"))
    rows = relations_.join(F.broadcast(rules), "relation").join(side("src"), "src").join(side("dst"), "dst")  # the rules are a constant
    rows = rows.where(~F.col("written") | F.col("dst_written"))
    along = F.col("way") == 1
    carries = F.when(F.col("carries") == "always", True).when(F.col("carries") == "source", F.col("src_decides")).when(F.col("carries") == "target", F.col("dst_decides")).otherwise(False)
    strength = F.when(F.col("less") > 0, F.greatest(F.lit(0.4), F.col("confidence") - F.col("less"))).otherwise(F.col("confidence"))
    return rows.select(F.when(along, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(along, F.col("dst")).otherwise(F.col("src")).alias("dst"), "edge_type", "mode", F.round(strength, 6).alias("strength"), "blocking", carries.alias("truth_relevant"))


def causal_expand(edges: DataFrame, nodes: DataFrame, scopes: DataFrame, bound: DataFrame, depth: int = 5) -> DataFrame:
    """(scope_key, depth): the scopes that a change of ``scopes`` (scope_key) touches, at their least depth. It begins at the
    nodes (node, scope_key, canonical_key) of scopes that contain or lie in these, and at the nodes to which retriggered
    truths are ``bound`` (node), and follows edges but those of mode `none`, and those for truths only that carry none."""
    arcs = kept(edges.where("mode <> 'none' AND (mode <> 'truth_only' OR truth_relevant)").select("src", "dst").distinct())
    own = nodes.select("node", "scope_key").where("scope_key <> ''")
    seeds = scopes.where("scope_key <> ''").select("scope_key").distinct()
    inside = own.withColumn("above", F.explode(text.ancestors(F.col("scope_key")))).join(seeds.withColumnRenamed("scope_key", "above"), "above").select("node")
    around = own.join(seeds.select(F.explode(text.ancestors(F.col("scope_key"))).alias("scope_key")).distinct(), "scope_key", "left_semi").select("node")
    frontier = kept(inside.union(around).union(bound.join(nodes.select("node"), "node", "left_semi").select("node")).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for step in range(1, depth + 1):
        new = frontier.join(arcs, frontier.node == arcs.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        frontier = kept(new)
        seen = seen.union(frontier)
    touched = nodes.join(seen, "node").select(F.explode(F.array("scope_key", semantics.scope_key(F.col("canonical_key")))).alias("scope_key"), "depth")
    return touched.union(seeds.withColumn("depth", F.lit(0))).where("scope_key <> ''").groupBy("scope_key").agg(F.min("depth").alias("depth"))


def finding_context(findings: DataFrame, relations_: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(finding_ord, kind, n, examples): what stands around each finding (finding_ord, node): its parents (belongs_to), what
    it contains, who governs it, what governs its parents and from there (two steps), who implements and who documents it.
    ``examples`` are the first ``most`` labels by name; neighbourhoods of one node are gathered once, whatever the findings
    on it."""
    label = nodes.select("node", "canonical_key")
    hop = lambda kind, own, far, name: relations_.where(F.col("relation") == kind).select(F.col(own).alias("node"), F.col(far).alias("far"), F.lit(name).alias("kind"))
    near = hop("belongs_to", "src", "dst", "parent").union(hop("contains", "src", "dst", "part")).union(hop("governs", "dst", "src", "governed_by")).union(hop("implements", "dst", "src", "implemented_by")).union(hop("documents", "dst", "src", "documented_by"))
    asked = findings.select("node").distinct()
    near = kept(near.distinct())
    direct = near.join(asked, "node", "left_semi")
    parents = direct.where("kind = 'parent'").select("node", F.col("far").alias("mid"))
    siblings = near.where("kind IN ('part', 'governed_by')").select(F.col("node").alias("mid"), "far", F.when(F.col("kind") == "part", "sibling").otherwise("parent_governed_by").alias("kind"))
    indirect = parents.join(siblings, "mid").where("node <> far").select("node", "far", "kind").distinct()
    numbered = direct.union(indirect).join(label.withColumnRenamed("node", "far"), "far").select("node", "kind", "canonical_key").distinct()
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("node", "kind").orderBy("canonical_key"))
    counts = numbered.groupBy("node", "kind").agg(F.count("*").alias("n"))
    first = numbered.withColumn("place", place).where(F.col("place") <= most).groupBy("node", "kind").agg(F.array_join(F.array_sort(F.collect_list("canonical_key")), "|").alias("examples"))  # of ``most`` labels
    return findings.select("finding_ord", "node").join(counts.join(first, ["node", "kind"]), "node").select("finding_ord", "kind", "n", "examples")
