"""Bounded expansion, best-score propagation and closure over directed edges.

Each round is a join of the frontier with the edges; tables that a later round reads are checkpointed in the folder
that spark.checkpoint.dir names, so a lost executor costs a round at most."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How strongly a relation passes a cause on.
STRENGTH = {"derived_from_truth": 1.0, "governs": 0.96, "contains": 0.88, "belongs_to": 0.86, "implements": 0.82, "documents": 0.8, "references": 0.66}
OTHER, BACKWARD, FLOOR = 0.55, 0.88, 0.35


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a written table of the folder that all executors share (spark.checkpoint.dir). Where that is unset, only a
    session without executors of its own may use its warehouse folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if (spark.conf.get("spark.master", None) or "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{folder.rstrip('/')}/klarspan/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(node, depth): everything reachable from the seeds (node) in at most ``depth`` steps, at its least depth."""
    edges = edges.where("mode <> 'none'").select("src", "dst").distinct()
    seen = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, depth + 1):
        new = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        frontier = kept(new)
        if frontier.isEmpty():
            break
        seen = kept(seen.union(frontier))
    return seen


def best_paths(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, node, score, hops, path): the best product of edge strengths from each seed within ``depth`` steps; of
    equal scores the shorter path, then the smaller text. Rounds are synchronous: each relaxes all nodes at once."""
    strength = F.col("confidence") * F.coalesce(*(F.when(F.col("relation") == k, F.lit(v)) for k, v in STRENGTH.items()), F.lit(OTHER))
    arcs = edges.select("src", "dst", strength.alias("s")).groupBy("src", "dst").agg(F.max("s").alias("s"))
    best = kept(seeds.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("score"), F.lit(0).alias("hops"), F.col("node").cast("string").alias("path")))
    order = F.struct(F.round(F.col("score"), 12).alias("score"), (-F.col("hops")).alias("short"))
    for step in range(1, depth + 1):
        frontier = best.where(F.col("hops") == step - 1)
        grown = frontier.join(arcs, frontier.node == arcs.src).select("seed", F.col("dst").alias("node"), (F.col("score") * F.col("s")).alias("score"), (F.col("hops") + 1).alias("hops"), F.concat_ws(">", "path", F.col("dst").cast("string")).alias("path"))
        every = best.union(grown).withColumn("order", order)
        top = every.groupBy("seed", "node").agg(F.max("order").alias("top"))
        best = kept(every.join(top, ["seed", "node"]).where("order = top").groupBy("seed", "node").agg(F.first("score").alias("score"), F.first("hops").alias("hops"), F.min("path").alias("path")))
    return best


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst): all pairs connected by any number of steps, or by at most ``depth``."""
    arcs = kept(edges.select("src", "dst").distinct())
    seen = frontier = arcs
    for _ in itertools.count() if depth is None else range(depth - 1):
        new = frontier.select("src", F.col("dst").alias("mid")).join(arcs.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti")
        frontier = kept(new)
        if frontier.isEmpty():
            break
        seen = kept(seen.union(frontier))
    return seen


def reachable_groups(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """Keys reachable from the seeds over shared claims (claim_id, key), without bound on the steps."""
    pairs = members.select("claim_id", "key").distinct()
    seen = kept(seeds.select("key").distinct())
    frontier = seen
    while not frontier.isEmpty():
        touched = pairs.join(frontier, "key", "left_semi").select("claim_id").distinct()
        frontier = kept(pairs.join(touched, "claim_id", "left_semi").select("key").distinct().join(seen, "key", "left_anti"))
        seen = kept(seen.union(frontier))
    return seen


def merge_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: greatest strength, any flag, and the modes joined as bits (1 truth, 2 delta)."""
    bits = F.when(F.col("mode") == "truth_only", 1).when(F.col("mode") == "delta_only", 2).when(F.col("mode") == "both", 3).otherwise(0)
    merged = edges.groupBy("src", "dst").agg(F.max("strength").alias("strength"), F.bool_or("write_relevant").alias("write_relevant"), F.bit_or(bits).alias("bits"))
    return merged.select("src", "dst", "strength", "write_relevant", F.when(F.col("bits") == 3, "both").when(F.col("bits") == 1, "truth_only").when(F.col("bits") == 2, "delta_only").otherwise("none").alias("mode"))


def depths(tree: DataFrame, most: int = 20) -> DataFrame:
    """(node, depth) of a parent table (node, parent; a node once): levels up to the root; a missing parent is one level,
    a cycle stops at ``most`` + 1. Each round doubles the levels that a node sees, so that a few joins do."""
    up = F.col("parent")
    seen = kept(tree.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent")).select("node", up.alias("top"), up.isNotNull().cast("int").alias("depth")))
    while not seen.where(F.col("top").isNotNull() & (F.col("depth") <= most)).isEmpty():
        above = seen.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        open_ = seen.where("top IS NOT NULL").join(above, "top", "left")
        ended = seen.where("top IS NULL").select("node", "top", "depth")
        seen = kept(ended.union(open_.select("node", F.col("next").alias("top"), F.least(F.lit(2 * most), F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))))
    return seen.select("node", F.least(F.lit(most + 1), F.col("depth")).alias("depth"))
