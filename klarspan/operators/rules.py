"""The finding rules: what documents, model and code say about one subject is compared class by class.

Values are reduced to one row for each (subject, class, value, predicate) before they are compared, so that a subject
with a great many claims carries only its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.functions import semantics
from klarspan.functions.semantics import ends_with_any
from klarspan.operators.claims import is_primary

POLICY = ("policy", "approval_policy", "scope_policy")
LIFECYCLE = ("lifecycle", "review_status")
#: rule: category, severity
RULES = {
    "B1": ("contradiction", "high"), "B2": ("contradiction", "high"), "B3": ("contradiction", "medium"), "B4": ("contradiction", "high"), "B5": ("policy_conflict", "high"), "B6": ("implementation_drift", "high"),
    "B7": ("implementation_drift", "medium"), "B8": ("contradiction", "medium"), "B9": ("policy_conflict", "high"), "B12": ("contradiction", "medium"), "B13": ("traceability_gap", "low"),
}


def is_process(subject: Column) -> Column:
    return (subject == "BSM.process") | F.startswith(subject, F.lit("BSM.phase.")) | F.startswith(subject, F.lit("BSM.process."))


def value_classes(claims: DataFrame) -> DataFrame:
    """One row a subject: for each source class its number of claims and its distinct (value, predicate) pairs in order."""
    part = claims.where(is_primary()).groupBy("subject_key", "source_type", "normalized_value", "predicate").agg(F.min("record_ord").alias("ord"), F.count("*").alias("n"))
    part = part.withColumn("t", semantics.signature(F.col("subject_key"), F.col("predicate"), F.col("normalized_value")))  # once for each distinct claim
    entry = F.struct("ord", F.col("normalized_value").alias("v"), F.col("predicate").alias("p"), "t")
    own = lambda *kinds: F.col("source_type").isin(*kinds)
    aggs = []
    for name, kinds in {"wiki": ("confluence_page",), "local": ("local_doc",), "doc": ("confluence_page", "local_doc"), "model": ("metamodel",), "code": ("github_file",)}.items():
        aggs += [F.array_sort(F.collect_list(F.when(own(*kinds), entry))).alias(name), F.coalesce(F.sum(F.when(own(*kinds), F.col("n"))), F.lit(0)).alias(f"n_{name}")]
    return part.groupBy("subject_key").agg(*aggs)


def _tags(side: Column, predicate: Column) -> Column:
    return F.transform(side, lambda e: F.when(e["p"] == predicate, e["t"]).otherwise(semantics.signature(F.col("subject_key"), predicate, e["v"])))


def sides_conflict(left: Column, right: Column) -> Column:
    """Set against set, seen with the first predicate of both sides."""
    predicate = F.coalesce(F.get(left, 0)["p"], F.get(right, 0)["p"], F.lit(""))
    values = lambda side: F.transform(side, lambda e: e["v"])
    tags = F.struct(_tags(left, predicate).alias("l"), _tags(right, predicate).alias("r"))
    return (F.size(left) > 0) & (F.size(right) > 0) & semantics.let(tags, lambda t: semantics.signatures_conflict(t["l"], t["r"], values(left), values(right)))


def inner_conflict(side: Column) -> Column:
    """Whether two of the side's values conflict, seen with the earlier one's predicate."""
    seen = lambda a, b: F.when(a["p"] == b["p"], b["t"]).otherwise(semantics.signature(F.col("subject_key"), a["p"], b["v"]))
    pair = lambda a, b: semantics.signatures_conflict(F.array(a["t"]), F.array(seen(a, b)), F.array(a["v"]), F.array(b["v"]))
    return F.exists(side, lambda a: F.exists(side, lambda b: (a["ord"] < b["ord"]) & (a["v"] != b["v"]) & pair(a, b)))


def findings(claims: DataFrame) -> DataFrame:
    """(subject_key, rule, category, severity) for every rule that fires."""
    groups = value_classes(claims)
    subject = F.col("subject_key")
    flags = groups.select(
        "subject_key", *(f"n_{c}" for c in ("wiki", "local", "doc", "model", "code")),
        ((F.col("n_wiki") > 1) & inner_conflict(F.col("wiki"))).alias("wiki_inner"),
        ((F.col("n_local") > 1) & inner_conflict(F.col("local"))).alias("local_inner"),
        ((F.col("n_doc") > 1) & inner_conflict(F.col("doc"))).alias("doc_inner"),
        sides_conflict(F.col("wiki"), F.col("local")).alias("wiki_local"),
        sides_conflict(F.col("model"), F.col("doc")).alias("model_doc"),
        sides_conflict(F.col("doc"), F.col("code")).alias("doc_code"),
    )
    runtime = flags.where(is_process(subject) & (F.col("n_doc") + F.col("n_code") > 0)).select(F.when(subject == "BSM.process", "BSM.process").otherwise(semantics.scope_key(subject)).alias("context")).distinct()
    wide = runtime.where("context = 'BSM.process'").limit(1).select(F.lit(True).alias("wide"))
    flags = flags.withColumn("context", semantics.scope_key(subject)).join(runtime.withColumn("near", F.lit(True)), "context", "left").join(wide, how="left")
    policy = ends_with_any(subject, POLICY)
    model_only = is_process(subject) & (F.col("n_model") > 0) & (F.col("n_doc") == 0) & (F.col("n_code") == 0)
    question = F.contains(subject, F.lit(".question."))
    fires = {
        "B1": F.col("wiki_inner"), "B2": F.col("wiki_local"), "B3": F.col("local_inner"), "B4": F.col("model_doc"), "B5": F.col("doc_code") & policy, "B6": F.col("doc_code") & ~policy,
        "B7": ends_with_any(subject, ("write_path", "read_path")) & (F.col("n_doc") > 0) & (F.col("n_code") == 0),
        "B8": ends_with_any(subject, LIFECYCLE) & F.col("doc_inner"), "B9": policy & F.col("doc_inner"), "B12": is_process(subject) & F.col("doc_inner"),
        "B13": model_only & (~question | F.coalesce("near", F.lit(False)) | F.coalesce("wide", F.lit(False))),
    }
    rows = F.array(*(F.when(fires[r], F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for r, (c, s) in RULES.items()))
    return flags.select("subject_key", F.inline(F.array_compact(rows)))
