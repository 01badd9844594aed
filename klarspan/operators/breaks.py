"""Where an observed path leaves the expected one: kinds of divergence, missing parts, pairs of variants, broken chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions.text import common_prefix
from klarspan.operators.graph import kept

ARROW = " -> "


def parts(path: Column) -> Column:
    """The nodes of a written path."""
    return F.filter(F.transform(F.split(path, "->"), lambda x: F.trim(x)), lambda x: x != "")


def _place(prefix: Column, suffix: Column) -> Column:
    return F.when((prefix > 0) & (suffix > 0), "internal").when(prefix > 0, "tail").when(suffix > 0, "prefix").otherwise("full")


def _between(path: Column, prefix: Column, suffix: Column) -> Column:
    return F.slice(path, prefix + 1, F.greatest(F.lit(0), F.size(path) - prefix - suffix))


def divergence(documented: Column, implemented: Column) -> Column:
    """Common start and end of two paths, told independently (in a repetition they may overlap), what each has between them,
    the first unlike nodes, where they meet again, and the mode. Modes say which side lacks something, or that both differ
    (substitution), and whether this lies inside, at the tail, at the prefix or is all; ``aligned`` if neither side has more."""
    prefix, suffix = common_prefix(documented, implemented), common_prefix(F.reverse(documented), F.reverse(implemented))
    left, right = _between(documented, prefix, suffix), _between(implemented, prefix, suffix)
    place, more, less = _place(prefix, suffix), F.size(left) > 0, F.size(right) > 0
    mode = F.when(more & less, F.concat(place, F.lit("_substitution"))).when(more, F.concat(F.lit("implemented_"), place, F.lit("_gap"))).when(less, F.concat(F.lit("documented_"), place, F.lit("_gap"))).otherwise("aligned")
    return F.struct(
        prefix.alias("prefix"), suffix.alias("suffix"), F.get(documented, prefix).alias("documented_at"), F.get(implemented, prefix).alias("implemented_at"),
        left.alias("documented_gap"), right.alias("implemented_gap"), F.when(suffix > 0, F.get(documented, F.size(documented) - suffix)).alias("rejoin_at"), mode.alias("mode"),
    )


def path_break(observed: Column, expected: Column) -> Column:
    """What an observed path lacks of the expected one: mode, place (index in the expected path), nodes before and after the
    break, where the path is met again, the missing nodes, and what is left of the path. Null if nothing is missing, or one
    of the two is empty."""
    prefix, suffix = common_prefix(observed, expected), common_prefix(F.reverse(observed), F.reverse(expected))
    missing = _between(expected, prefix, suffix)
    end = F.size(expected) - suffix
    index = F.when((prefix == 0) & (suffix > 0), end).otherwise(prefix)  # a missing start breaks where the rest begins
    # of paths that share nothing the last missing node stands before the break
    edge = F.when(prefix > 0, prefix).otherwise(end)
    found = F.struct(
        F.concat(_place(prefix, suffix), F.lit("_gap")).alias("mode"), index.cast("int").alias("index"), F.when(edge > 0, F.get(expected, edge - 1)).alias("before"), F.get(expected, edge).alias("after"),
        F.get(expected, end).alias("rejoin_at"), F.array_join(missing, ARROW).alias("missing"), F.array_join(F.slice(expected, index + 1, F.size(expected)), ARROW).alias("remaining"), prefix.alias("prefix"), suffix.alias("suffix"), F.size(missing).alias("n_missing"),
    )
    return F.when((F.size(observed) > 0) & (F.size(expected) > 0) & (F.size(missing) > 0), found)


def matched(candidates: DataFrame, by: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """Candidates (distinct pairs of ``left`` and ``right`` within ``by``) matched one to one, best first, ties by the two
    names. A pair that is the best of both its sides is taken, whatever becomes of the others, so all such pairs of all
    groups are taken in one round; the rounds end when no pair is open."""
    rank = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), F.col(left), F.col(right))
    over = lambda side: Window.partitionBy(*by, side)
    open_, out = candidates.withColumn("_rank", rank), None
    while True:
        best = (F.col("_rank") == F.min("_rank").over(over(left))) & (F.col("_rank") == F.min("_rank").over(over(right)))
        marked = kept(open_.withColumn("_taken", best))
        taken = marked.where("_taken").drop("_taken")
        if taken.isEmpty():
            return (taken if out is None else out).drop("_rank")
        out = taken if out is None else out.union(taken)
        used = F.bool_or("_taken").over(over(left)) | F.bool_or("_taken").over(over(right))
        open_ = marked.withColumn("_used", used).where("NOT _used").drop("_used", "_taken")


def matched_breaks(observed: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Observed and expected paths (by, path) paired one to one with their break: most shared nodes at both ends, then at
    the end, then at the start, then the fewest missing. Only paths that name a common node meet."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.where("path IS NOT NULL").select(*by, F.col("path").alias(name)).distinct().withColumn("_node", F.explode(F.array_distinct(parts(F.col(name)))))

    met = named(observed, "observed").join(named(expected, "expected"), [*by, "_node"]).select(*by, "observed", "expected").distinct()
    rows = met.withColumn("b", path_break(parts(F.col("observed")), parts(F.col("expected")))).where("b IS NOT NULL").select(*by, "observed", "expected", "b.*")
    both = F.col("prefix") + F.col("suffix")
    return matched(rows, by, "observed", "expected", [-both, -F.col("suffix"), -F.col("prefix"), F.col("n_missing")])


def broken_chains(steps: DataFrame, paths: DataFrame, by: list[str], hub: str, derived: str, supports: str, target: str, origin: str, unknown: str = "<source>") -> DataFrame:
    """A finding for each group whose chain origin -> source -> hub -> target lacks one of its two hops everywhere.

    ``steps`` (by, source_id, src, type, dst) are relations in code, ``paths`` (by, path) the paths they make. A group has
    the first hop if a relation ``derived`` leaves the hub, the second if ``supports`` leads from the hub to the target.
    Expected are the paths through all known sources, observed those that are written (or, without any, what the present hop
    makes); the best matched pair tells where the chain breaks."""
    first, second = (F.col("src") == hub) & (F.col("type") == derived), (F.col("src") == hub) & (F.col("dst") == target) & (F.col("type") == supports)
    hops = kept(steps.where(first | second).select(*by, "source_id", "dst", first.alias("first")).distinct())
    state = hops.groupBy(*by).agg(F.bool_or("first").alias("has_first"), F.bool_or(~F.col("first")).alias("has_second"), F.count_distinct("source_id").alias("n_sources")).where("has_first <> has_second")
    state = kept(state.withColumn("break_at", F.when(F.col("has_first"), F.concat_ws(".", F.lit(hub), F.lit(supports))).otherwise(F.concat_ws(".", F.lit(hub), F.lit(derived)))))
    known = hops.where("first").join(state, by, "left_semi").select(*by, F.col("dst").alias("known")).distinct()
    full = state.select(*by, "has_first").join(known, by, "left").withColumn("known", F.coalesce("known", F.lit(unknown)))
    line = lambda *nodes: F.array_join(F.array(*nodes), ARROW)
    expected = full.select(*by, line(F.lit(origin), F.col("known"), F.lit(hub), F.lit(target)).alias("path"))
    written = kept(paths.where("path IS NOT NULL").select(*by, "path").distinct().join(state, by, "left_semi"))
    made = full.join(written, by, "left_anti").select(*by, F.when(F.col("has_first"), line(F.lit(origin), F.col("known"), F.lit(hub))).otherwise(line(F.lit(hub), F.lit(target))).alias("path"))
    observed = kept(written.union(made))
    pairs = kept(matched_breaks(observed, expected, by))
    order = F.struct((-F.col("prefix") - F.col("suffix")).alias("a"), (-F.col("suffix")).alias("b"), F.col("n_missing").alias("c"), "observed", "expected")
    lead = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.min_by(F.struct("observed", "expected", "mode", "index", "before", "after", "rejoin_at", "missing", "remaining"), order).alias("lead"))
    count = lambda df, name: df.groupBy(*by).agg(F.count_distinct("path").alias(name))
    out = state.join(count(observed, "n_observed"), by).join(count(expected, "n_expected"), by).join(lead, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    step = F.when(F.col("has_first"), F.lit(f"{hub} -[:{supports}]-> {target}")).otherwise(F.lit(f"{hub} -[:{derived}]-> {unknown}"))
    return out.select(
        *by, F.lit("implementation_drift").alias("category"), F.lit("high").alias("severity"), "break_at", step.alias("missing_step"), "n_sources", "n_observed", "n_expected", "n_pairs", (F.col("n_observed") - F.col("n_pairs")).alias("unmatched_observed"),
        (F.col("n_expected") - F.col("n_pairs")).alias("unmatched_expected"), "lead.*",
    )
