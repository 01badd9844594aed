"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target weight times the size of the mixture over its number of documents. Each
document draws its count from a Poisson distribution with that mean, by inverting the distribution at a uniform number
hashed from the seed and the document; it is exploded by its count, and all copies are shuffled by a hash of seed,
document and copy, so the result's rows stand in a random order that a seed repeats.

Sources without a target share, weighted by their size, what the targets leave; a null source is a source of its own.
The weights are relative: they are scaled to sum to one over the sources that have documents. Repeated rows of the same
id draw alike. Null ids draw by their text alone. Rates above PART are drawn as a sum of several draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C

#: A single draw's largest mean: its distribution must not underflow.
PART = 16.0
#: Counts considered in a single draw; beyond lies less than 2**-52 of a distribution of mean PART.
STEPS = 80


def rates(docs: DataFrame, weights: dict[str, float], size: float = 1.0) -> DataFrame:
    """source, rate: mean copies of a document so that weights hold in a mixture of ``size`` times the input's rows."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    target = F.lit(None).cast("double")
    for name, weight in weights.items():
        target = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(target)
    counts = counts.withColumn("target", target)
    sums = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("target").isNull(), F.col("n"))).alias("rest_n"), F.sum("target").alias("given"))
    rest = F.greatest(F.lit(0.0), 1 - F.coalesce("given", F.lit(0.0)))
    share = F.coalesce(F.col("target"), rest * F.col("n") / F.col("rest_n"))
    whole = F.coalesce("given", F.lit(0.0)) + F.when(F.col("rest_n").isNotNull(), rest).otherwise(0.0)
    return counts.join(F.broadcast(sums), how="cross").select("source", F.when(whole > 0, share / whole * F.col("total") * size / F.col("n")).otherwise(0.0).alias("rate"))


def _uniform(*parts):
    """A double in [0, 1) of 52 bits, from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_sources(docs: DataFrame, weights: dict[str, float], seed: int = 0, size: float = 1.0) -> DataFrame:
    """The documents, all columns, each as often as drawn, shuffled; mix_copy (from 1) numbers a document's copies
    and takes the place of a column of that name."""
    rate = C.written(rates(docs, weights, size).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate")), "rates")  # so that its size is known when the join is planned
    whole = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column's name clashes
    rated = whole.join(rate, whole["row.source"].eqNullSafe(F.col("mix_source")), "left")  # Spark broadcasts the rates where they are measured small
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce("row.text", F.lit(""))))
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART)).cast("int")
    mean = F.col("mix_rate") / parts

    def draw(part):
        u = _uniform(F.lit(str(seed)), key, part.cast("string"))
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("below"))
        step = lambda s, i: F.when(s["below"] > u, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * mean / i).alias("p"), (s["below"] + s["p"] * mean / i).alias("below")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["k"])

    drawn = F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, b: a + b)
    copies = rated.withColumn("mix_count", drawn).where("mix_count > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    order = F.xxhash64(F.lit(seed), key, F.col("mix_copy"))
    return copies.withColumn("mix_order", order).repartition(F.col("mix_order")).sortWithinPartitions("mix_order").select(*(F.col(f"row.`{c}`") for c in docs.columns if c != "mix_copy"), "mix_copy")


def oracle(weights: dict[str, float], seed: int = 0, size: float = 1.0) -> str:
    """DuckDB SQL for doc_id, source, mix_copy, text."""
    given = " ".join(f"WHEN source = '{s}' THEN {float(w)!r}" for s, w in weights.items())
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, CAST(CASE {given} END AS DOUBLE) AS target FROM documents GROUP BY source),
sums AS (SELECT sum(n) AS total, sum(CASE WHEN target IS NULL THEN n END) AS rest_n, coalesce(sum(target), 0.0) AS given FROM counts),
shares AS (SELECT source, n, total, coalesce(target, greatest(0.0, 1 - given) * n / rest_n) AS share, given + CASE WHEN rest_n IS NOT NULL THEN greatest(0.0, 1 - given) ELSE 0.0 END AS whole FROM counts, sums),
rate AS (SELECT source, CASE WHEN whole > 0 THEN share / whole * total * {size!r} / n ELSE 0.0 END AS rate FROM shares),
part AS (SELECT source, CAST(greatest(1, ceil(rate / {PART!r})) AS INT) AS parts, rate / CAST(greatest(1, ceil(rate / {PART!r})) AS INT) AS mean FROM rate),
cdf AS (SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM part
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM cdf WHERE k < {STEPS}),
steps AS (SELECT source, any_value(parts) AS parts, list(below ORDER BY k) AS cdf FROM cdf GROUP BY source),
keyed AS (SELECT d.*, row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents d),
draws AS (SELECT r, unnest(range(1, parts + 1)) AS part, key, cdf FROM keyed JOIN steps ON keyed.source IS NOT DISTINCT FROM steps.source),
drawn AS (SELECT r, sum(least({STEPS}, len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5('{seed}|' || key || '|' || part), 1, 13)) AS BIGINT) / 4503599627370496.0)))) AS n FROM draws GROUP BY r)
SELECT doc_id, source, text, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INT) AS mix_copy FROM keyed JOIN drawn USING (r)
"""
