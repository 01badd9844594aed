"""Connected components by contraction: every node joins its smallest neighbour, until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b). Each round is a few joins on distributed tables; nodes should
    be numbered without regard to the links' shape (hashes are), so that the rounds grow with the logarithm of a
    component's diameter. No links: an empty result."""
    links = C.written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while roots is None or not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        parent = C.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
        parent = parent.join(above, "up").select("node", "root")
        roots = parent if roots is None else roots.join(parent.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = C.written(roots, "roots")
        of = lambda side: parent.select(F.col("node").alias(side), F.col("root").alias(f"to_{side}"))
        links = links.join(of("a"), "a").join(of("b"), "b").where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        links = C.written(links, "links")
    return roots
