"""Ranking, retrieval budgets, decision packages, atomic facts and their history, and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import scoring
from klarspan.operators.graph import kept

BASE, HARD_CAP = 12, 24


def ranked(findings: DataFrame) -> DataFrame:
    """Findings (finding_ord, bucket, severity, category, delta, object_key, title) with their place in the global order.
    Rows are dealt by ranges of the order; a row's place is its place in its range and the sizes of those before."""
    order = [scoring.root_cause_priority(F.col("bucket")), scoring.conflict_priority(F.col("category")), scoring.severity_rank(F.col("severity")), scoring.detail_penalty(F.col("category")), F.when(F.col("delta"), 0).otherwise(1), F.col("object_key"), F.col("title"), F.col("finding_ord")]
    dealt = kept(findings.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return dealt.join(before, "_part").withColumn("place", place.cast("int")).drop("_part", "_before")


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of the global order, by partial top-n of each task."""
    return findings.orderBy(scoring.root_cause_priority(F.col("bucket")), scoring.conflict_priority(F.col("category")), scoring.severity_rank(F.col("severity")), scoring.detail_penalty(F.col("category")), F.when(F.col("delta"), 0).otherwise(1), "object_key", "title", "finding_ord").limit(n)


def for_retrieval(findings: DataFrame, base: int = BASE, cap: int = HARD_CAP) -> DataFrame:
    """The base selection, and up to the cap those that enforce a truth, are severe core causes, or whose core bucket
    the base lacks. (Severe core causes of groups that the base lacks are among the severe ones.)"""
    chosen = top_findings(findings, base).select("finding_ord", "bucket").withColumn("base", F.lit(True))
    core = F.col("bucket").isin(*scoring.CORE)
    buckets = chosen.where(core).select("bucket").distinct().withColumn("covered", F.lit(True))
    rest = findings.join(chosen.select("finding_ord"), "finding_ord", "left_anti").join(buckets, "bucket", "left")
    severe = scoring.severity_rank(F.col("severity")) <= 1
    more = rest.where(F.col("truth") | (core & (severe | F.col("covered").isNull())))
    more = more.orderBy(F.when(F.col("truth"), 0).otherwise(1), scoring.root_cause_priority(F.col("bucket")), scoring.severity_rank(F.col("severity")), F.when(F.col("delta"), 0).otherwise(1), -F.col("confidence"), "object_key", "title", "finding_ord").limit(max(0, cap - base))
    return chosen.select("finding_ord", "base").union(more.select("finding_ord", F.lit(False)))


def packages(findings: DataFrame) -> DataFrame:
    """Findings by cluster and assigned root cause: a cluster with core causes gives all its findings to those."""
    kept = findings.where("category <> 'architecture_observation'")
    rank = scoring.root_cause_priority(F.col("bucket"))
    core = F.when(F.col("bucket").isin(*scoring.CORE), F.struct(rank.alias("p"), "bucket"))
    best = kept.groupBy("cluster").agg(F.min(core).alias("lead"))
    assigned = kept.join(best, "cluster").withColumn("assigned", F.when(F.col("lead").isNull() | F.col("bucket").isin(*scoring.CORE), F.col("bucket")).otherwise(F.col("lead.bucket")))
    first = F.struct((F.col("bucket") != F.col("assigned")).alias("a"), (~F.col("truth")).alias("b"), scoring.conflict_priority(F.col("category")).alias("p"), scoring.detail_penalty(F.col("category")).alias("c"), scoring.severity_rank(F.col("severity")).alias("d"), "title", "finding_ord")
    out = assigned.groupBy("cluster", "assigned").agg(
        F.min(scoring.severity_rank(F.col("severity"))).alias("severity_rank"), F.count("*").alias("n_findings"), F.min_by("finding_ord", first).alias("primary_ord"), F.bool_or("delta").alias("rerender_required"), F.count_distinct("source_id").alias("n_sources")
    )
    return out.withColumn("sort_key", 10 * scoring.root_cause_priority(F.col("assigned")) + F.col("severity_rank"))


def dominant_category(findings: DataFrame) -> DataFrame:
    """The category of each cluster: best severity, then most findings, then name."""
    each = findings.groupBy("cluster", "category").agg(F.count("*").alias("n"), F.min(scoring.severity_rank(F.col("severity"))).alias("rank"))
    return each.groupBy("cluster").agg(F.min_by("category", F.struct("rank", (-F.col("n")).alias("n"), "category")).alias("category"))


def action_lane(has_doc: Column, has_code: Column, has_model: Column) -> Column:
    return F.when(has_doc & has_code, "both").when(has_model, "artifact").when(has_doc, "document").otherwise("code")


def atomic_facts(problems: DataFrame) -> DataFrame:
    """One fact a key over all packages' problems (fact_key, ord, summary, package, source_id): scalars of the first,
    lists joined in order."""
    joined = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])), "|")
    return problems.groupBy("fact_key").agg(F.min_by("summary", "ord").alias("summary"), F.min_by("package", "ord").alias("primary_package"), joined("package").alias("packages"), joined("source_id").alias("sources"), F.count("*").alias("n_problems"))


def fact_history(facts: DataFrame, previous: DataFrame) -> DataFrame:
    """Facts against the latest earlier one of their key (fact_key, run, status, occurrences): open and confirmed ones
    carry on, others open again."""
    latest = previous.groupBy("fact_key").agg(F.max_by(F.struct("status", "run", "occurrences"), "run").alias("before"), F.count_distinct("run").alias("runs"))
    joined = facts.join(latest, "fact_key", "left")
    carried = F.col("before.status").isin("open", "confirmed")
    mode = F.when(F.col("before").isNull(), "new").when(carried, "continued").otherwise("reopened")
    status = F.when(carried, F.col("before.status")).otherwise("open")
    count = F.coalesce(F.greatest(F.col("runs") + 1, F.col("before.occurrences") + 1), F.lit(1))
    return joined.select("fact_key", mode.alias("mode"), status.alias("status"), count.cast("long").alias("occurrences"))


def fact_registry(entries: DataFrame) -> DataFrame:
    """Entries (fact_key, run, status, mode) of all runs, reduced to one row a key: the latest, and in how many runs."""
    return entries.groupBy("fact_key").agg(F.max_by("status", "run").alias("status"), F.max_by("mode", "run").alias("mode"), F.count_distinct("run").alias("runs"), F.max("run").alias("last_run"))


def registry_summary(entries: DataFrame, first: int = 12) -> DataFrame:
    """(section, key, n) over the entries (fact_key, run, status, mode) of all runs: totals of entries, facts, those seen in
    several runs and those that were opened again, facts by their latest status, and the first facts, newest run first, with
    how many runs saw them."""
    facts = kept(fact_registry(entries))
    row = lambda section, key, n: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), n.cast("long").alias("n"))
    totals = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("runs") > 1).alias("recurring"), F.count_if(F.coalesce(F.col("mode") == "reopened", F.lit(False))).alias("reopened"))
    totals = totals.select(F.inline(F.array(*(row("total", k, F.col(k)) for k in ("facts", "recurring", "reopened")))))
    count = entries.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("entries").alias("key"), "n")
    status = facts.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n")).select(F.lit("status").alias("section"), "key", "n")
    newest = facts.orderBy(F.desc("last_run"), "fact_key").limit(first).select(F.lit("latest").alias("section"), F.col("fact_key").cast("string").alias("key"), F.col("runs").alias("n"))
    return totals.union(count).union(status).union(newest)


def retained(cache: DataFrame, keep: int = 3, days: int = 30) -> DataFrame:
    """Rows (source_id, cached_at) that retention keeps: the newest of each source, and whatever is younger than days
    before the newest row of all."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("cached_at"), F.desc("row_id")))
    now = cache.agg(F.max("cached_at").alias("now"))
    return cache.withColumn("place", place).join(F.broadcast(now), how="cross").where((F.col("place") <= keep) | (F.col("cached_at") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))).drop("now")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_p = 1").drop("_p")


def source_set_hash(docs: DataFrame) -> DataFrame:
    """For each source type: the first 32 characters of the sha256 over its sorted `id:hash` entries."""
    entry = F.concat_ws(":", "source_id", "content_hash")
    return docs.groupBy("source_type").agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256), F.lit(32)).alias("set_hash"), F.count("*").alias("n"))


def schema_registry(targets: DataFrame) -> DataFrame:
    """(schema_key, status, claim) targets as one row a key: best status, and how often it was claimed."""
    rank = scoring.lookup(F.col("status"), {"confirmed": 0, "observed_only": 1, "unconfirmed": 2}, 3)
    kind = F.when(F.startswith("schema_key", F.lit("Node:")), "node").when(F.startswith("schema_key", F.lit("Relationship:")), "relationship").otherwise("other")
    return targets.groupBy("schema_key").agg(F.min_by("status", rank).alias("status"), F.count_distinct("claim").alias("n_claims")).withColumn("schema_kind", kind)


def gate(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Labelled expectations (case_id, polarity, category, subject_key) against findings: recall, precision and the
    gate (all found, precision of 0.9, nothing forbidden)."""
    joined = expectations.join(findings.select("category", "subject_key").distinct().withColumn("hit", F.lit(True)), ["category", "subject_key"], "left")
    wanted, hit = F.col("polarity") == "expected", F.col("hit").isNotNull()
    out = joined.agg(F.count_if(wanted).alias("total"), F.count_if(wanted & hit).alias("matched"), F.count_if(~wanted & hit).alias("false_positives"))
    recall = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(1.0)
    precision = F.when(F.col("matched") + F.col("false_positives") > 0, F.col("matched") / (F.col("matched") + F.col("false_positives"))).otherwise(1.0)
    return out.select("total", "matched", "false_positives", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), ((recall == 1.0) & (precision >= 0.9) & (F.col("false_positives") == 0)).alias("passed"))


# Markers of statements in answers.
DEFINITE = ("always", "never", "must", "immer", "niemals")
NEGATED = ("not", "kein", "nicht", "never", "without")
ASSERTING = ("is", "are", "ist", "sind", "the", "of", "gilt")
SCOPED = ("process", "policy", "write", "read", "service", "phase")
FILLERS = ("ok", "yes", "no", "ja", "nein", "danke", "thanks")


def indications(turns: DataFrame) -> DataFrame:
    """Answers (conv_id, turn, text) that state something, with a grade and confidence; questions, fillers and answers
    of at most ten characters state nothing."""
    text = F.trim(F.coalesce("text", F.lit("")))
    low = F.lower(text)
    contains = lambda words: low.rlike("|".join(words))
    asserting = F.arrays_overlap(F.split(low, r"\s+"), F.array(*map(F.lit, ASSERTING)))
    grade = (
        F.when(contains(DEFINITE), "definite")
        .when(asserting & (contains(SCOPED) | contains(NEGATED)), "assertion")
        .when(contains(NEGATED), "negation")
        .when(asserting | (F.length(text) > 30), "general")
    )
    out = turns.where((F.length(text) > 10) & ~F.endswith(text, F.lit("?")) & ~low.isin(*FILLERS)).withColumn("grade", grade).where("grade IS NOT NULL")
    return out.select("conv_id", "turn", "grade", scoring.lookup(F.col("grade"), {"definite": 0.95, "assertion": 0.85, "negation": 0.75, "general": 0.65}).alias("confidence"))
