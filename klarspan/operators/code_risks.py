"""Risks in code as findings: from events of functions to claims, and from these to graded findings, alone or by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.operators import scan
from klarspan.operators.chains import gap_kinds

# Category and severity of a risk by its predicate.
RISKS = {
    "code_evidence_chain_variant_conflict": ("implementation_drift", "high"),
    "code_evidence_chain_break": ("implementation_drift", "high"),
    "code_eventual_consistency_risk": ("read_write_gap", "high"),
    "code_chain_interruption_risk": ("read_write_gap", "high"),
    "code_schema_missing_fields": ("implementation_drift", "high"),
    "code_field_propagation_gap": ("implementation_drift", "medium"),
}
BOUNDARY = ("legacy_path_gap", "medium")
# Of each sequence of steps how it breaks, and what should stand between its steps.
SEQUENCES = {
    "persist_before_enqueue": ("async_gap", ("persist", "protected_reaggregation", "enqueue")),
    "supersede_before_rebuild": ("replacement_gap", ("supersede", "replacement_chain_available", "rebuild")),
}
SUPPORT = ("code_temporal_sequence", "code_missing_required_field", "code_propagation_context")
CLAIM = ("source_id", "subject_key", "predicate", "value", "function_name", "first_line", "last_line")


def risk_claims(events: DataFrame, field: str, required=(), output: str = "Output", path_context: Column | None = None) -> DataFrame:
    """Claims (source_id, subject_key, predicate, value, function_name, first_line, last_line) of events: steps in the wrong
    order, entities written without ``field`` in a side context, outputs without some of the ``required`` fields."""

    def claims(rows: DataFrame, subject: Column, said) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(predicate).alias("predicate"), value.alias("value")) for predicate, value in said))
        return rows.select("source_id", subject.alias("subject_key"), F.inline(pairs), F.col("func").alias("function_name"), F.col("first_line").cast("int").alias("first_line"), F.col("last_line").cast("int").alias("last_line"))

    def sequence(first: str, then: str, helpers: bool, risk: str) -> DataFrame:
        rows = scan.step_gaps(events, first, then, helpers)
        return claims(rows, F.lit(f"TemporalConsistency.{first}_then_{then}"), (("code_temporal_sequence", F.lit(f"{first}_before_{then}")), (risk, F.concat_ws(": ", "func", F.lit(f"{first}, then {then}")))))

    drops = scan.propagation_gaps(events, field, path_context).select("source_id", "func", "entity", F.explode(F.split("contexts", ",")).alias("context"), F.col("line").alias("first_line"), F.col("line").alias("last_line"))
    out = sequence("persist", "enqueue", True, "code_eventual_consistency_risk").union(sequence("supersede", "rebuild", False, "code_chain_interruption_risk"))
    subject = F.concat_ws(".", "entity", F.lit("field_propagation"))
    out = out.union(claims(drops, subject, (("code_propagation_context", F.col("context")),)))
    once = drops.drop("context").distinct()
    out = out.union(claims(once, subject, (("code_missing_required_field", F.lit(field)), ("code_field_propagation_gap", F.concat_ws(": ", "func", F.lit(f"no {field}"))))))
    if required:
        short = scan.output_gaps(events, required).withColumnsRenamed({"line": "first_line"}).withColumn("last_line", F.col("first_line"))
        out = out.union(claims(short, F.lit(f"{output}.fields"), (("code_schema_missing_fields", F.col("missing")),)))
    return out


def risk_records(claims: DataFrame, rules=(), boundary=()) -> DataFrame:
    """One record for each risk (predicate, source_id, subject_key), with its kind and what its source says beside it.

    Kinds of sequences stored before they are queued come from the user's ``rules`` (see ``gap_kinds``): the first rule that
    any function of the source's sequences fits. Chains replaced too early are a kind of their own. Fields dropped from one
    of the ``boundary`` subjects, told by lines alone, are gaps at an entry point."""
    by = ["source_id", "subject_key"]
    says = lambda predicate: F.col("predicate") == predicate
    support = claims.where(F.col("predicate").isin(*SUPPORT))
    beside = support.groupBy(*by).agg(
        F.count_distinct("predicate").alias("n_support"), F.min(F.when(says(SUPPORT[0]), F.col("value"))).alias("sequence"),
        F.min(F.when(says(SUPPORT[0]), F.struct("function_name", "first_line", "last_line"))).alias("window"),
        F.count_distinct(F.when(says(SUPPORT[1]), F.col("value"))).alias("n_missing"), F.min(F.when(says(SUPPORT[1]), F.col("value"))).alias("missing_field"),
        F.coalesce(F.bool_and(F.when(says(SUPPORT[2]), F.col("value") == "line_context")), F.lit(False)).alias("lines_only"),
    )
    names = [name for name, _, _ in rules] + ["generic"]
    told = claims.where(says(SUPPORT[0])).select(*by, F.col("source_id").alias("path"), "function_name").distinct()
    place = F.array_position(F.array(*map(F.lit, names)), F.col("kind"))
    kinds = gap_kinds(told, rules).groupBy(*by).agg(F.min_by("kind", place).alias("gap"))
    risks = claims.where(F.col("predicate").isin(*RISKS)).groupBy("predicate", *by).agg(F.min("value").alias("value"), F.min("function_name").alias("function_name"), F.min("first_line").alias("line"))
    kind = (
        F.when(says("code_eventual_consistency_risk"), F.coalesce("gap", F.lit("generic")))
        .when(says("code_chain_interruption_risk") & (F.col("subject_key") == "TemporalConsistency.supersede_then_rebuild"), "rebuild")
        .when(says("code_field_propagation_gap") & F.col("subject_key").isin(*boundary) & F.col("lines_only"), "entry_point")
    )
    return risks.join(beside, by, "left").join(kinds, by, "left").withColumn("kind", kind).drop("gap")


def finding_key(grouped) -> Column:
    """Records of a grouped kind share the finding of their predicate, subject and kind; others stand alone by source."""
    family = F.concat_ws("|", "predicate", "subject_key", "kind")
    return F.when(F.col("kind").isin(*grouped, "rebuild", "entry_point"), family).otherwise(F.concat_ws("|", "predicate", "source_id", "subject_key"))


def risk_members(records: DataFrame, claims: DataFrame, grouped=()) -> DataFrame:
    """(finding_key, source_id, function_name, first_line, last_line): the functions behind each finding, as rows."""
    keyed = records.select(finding_key(grouped).alias("finding_key"), "source_id", "subject_key")
    sides = claims.where(F.col("predicate").isin(SUPPORT[0], SUPPORT[1])).select("source_id", "subject_key", "function_name", "first_line", "last_line").distinct()
    return keyed.join(sides, ["source_id", "subject_key"]).drop("subject_key").distinct()


def code_risks(records: DataFrame, claims: DataFrame, grouped=()) -> DataFrame:
    """Findings with category, severity, sources and functions (counts and the smallest; ``risk_members`` has them all), the
    number of paths, and, for sequences, how they break, what was seen, expected and is missing. Findings of a family count
    the paths of a gap by its functions, records or sources, whichever are most, other families by sources."""
    keyed = records.withColumn("finding_key", finding_key(grouped))
    lead = F.struct("source_id", "sequence", "window", "missing_field")
    found = keyed.groupBy("finding_key").agg(F.min("predicate").alias("predicate"), F.min("subject_key").alias("subject_key"), F.min("kind").alias("kind"), F.count("*").alias("n_records"), F.count_distinct("source_id").alias("n_sources"), F.max("n_support").alias("n_support"), F.min(lead).alias("lead"))
    functions = risk_members(records, claims, grouped).groupBy("finding_key").agg(F.count_distinct("function_name").alias("n_functions"), F.min("function_name").alias("function_name"))
    out = found.join(functions, "finding_key", "left").withColumn("n_functions", F.coalesce("n_functions", F.lit(0)))
    entry = F.coalesce(F.col("kind") == "entry_point", F.lit(False))
    graded = lambda i: F.when(entry, BOUNDARY[i]).otherwise(_of(F.col("predicate"), {k: v[i] for k, v in RISKS.items()}))
    paths = F.when(F.col("predicate") == "code_eventual_consistency_risk", F.greatest("n_functions", "n_records", "n_sources")).otherwise(F.col("n_sources"))
    sequence = F.col("lead.sequence")
    expected = _of(sequence, {k: "|".join(v[1]) for k, v in SEQUENCES.items()})
    seen = F.split(sequence, "_before_")
    return out.select(
        "finding_key", "predicate", "subject_key", "kind", graded(0).alias("category"), graded(1).alias("severity"), "n_records", "n_sources", "n_functions", "function_name", paths.alias("path_count"), F.coalesce("n_support", F.lit(0)).alias("n_support"), "lead.missing_field",
        F.when(sequence.isNotNull(), F.coalesce(_of(sequence, {k: v[0] for k, v in SEQUENCES.items()}), F.lit("sequence_gap"))).alias("break_mode"), F.array_join(seen, " -> ").alias("observed"),
        F.coalesce(F.replace(expected, F.lit("|"), F.lit(" -> ")), F.array_join(seen, " -> ")).alias("expected"), F.array_join(F.array_except(F.split(expected, "[|]"), seen), " -> ").alias("missing"),
        F.when(F.col("lead.window").isNotNull(), F.concat(F.lit("L"), F.col("lead.window.first_line").cast("string"), F.lit("-L"), F.col("lead.window.last_line").cast("string"))).alias("lines"), entry.alias("legacy_path_gap"),
    )


def _of(column: Column, values: dict[str, str]) -> Column:
    """The value of a key; null for others."""
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out
