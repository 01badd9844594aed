"""Claims from text: line scans of code and documents, and rules over values of one concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.functions import scoring

# What a line's words say about it.
READ = r"(?i)\b(get|list|load|read|fetch|query|find|collect|resolve)\b|_[a-z0-9]*(get|load|read|fetch|query|find|collect|resolve)\b|@router\.get\("
WRITE = r"(?i)\b(create|update|delete|write|persist|save|upsert|merge|patch)\b|_[a-z0-9]*(create|update|delete|write|persist|save|upsert|merge|patch)\b|@router\.(post|put|patch|delete)\("
LIFECYCLE = r"(?i)\b(lifecycle|promotion|histori)\b"
POLICY = r"(?i)\b(read-only|readonly|allowlist|approval|approve|guarded|scope|tenant|policy|contract)\b"
REVIEW_STATUS = r"(?i)\b(review status|review-status|in review|draft|approved|released|freigegeben|archived|historic)\b"
APPROVAL = r"(?i)\b(approval|approve|freigabe|guarded|allowlist|review-only|without approval|ohne freigabe)\b"
SCOPE = r"(?i)\b(tenant|global|project scoped|project-specific|global read)\b"
ASPECTS = (("read_path", "read", READ), ("write_path", "write", WRITE), ("lifecycle", "lifecycle", LIFECYCLE), ("policy", "policy", POLICY), ("review_status", "review_status", REVIEW_STATUS), ("approval_policy", "approval_policy", APPROVAL), ("scope_policy", "scope_policy", SCOPE))
HINTS = (("statement", "Statement"), ("question", "BSM_Question"), ("phase", "BSM_Phase"), ("chunk", "Chunk"), ("document", "Document"), ("inputsource", "InputSource"), ("input source", "InputSource"), ("prompt", "Prompt"), ("metaclass", "MetaClass"), ("confluence", "ConfluencePage"), ("page", "ConfluencePage"))
CONCEPT_PREFIXES = ("puml_", "documented_", "code_", "yaml_", "metamodel_")
RECORD_WEIGHT = {"explicit_truth": 50, "confirmed_decision": 40, "ssot": 35, "governed": 28, "working_doc": 20, "implementation": 12, "runtime_observation": 9, "historical": 5, "heuristic": 4}
POSITIVE = ("pflicht", "zentral", "required", "mandatory", "eigenstaendig", "exists", "definiert")
NEGATIVE = ("entfaellt", "kein", "nicht", "no ", "removed", "deprecated", "soll nicht")


def subject_of(line: Column, fallback: Column, hints=HINTS) -> Column:
    """A back-quoted name, else a hinted object (a corpus's own words go into ``hints``), else the first capitalised name,
    else the fallback."""
    quoted = F.nullif(F.regexp_extract(line, r"`([A-Za-z][A-Za-z0-9_.-]{2,})`", 1), F.lit(""))
    hinted = F.lit(None).cast("string")
    for word, name in reversed(hints):
        hinted = F.when(F.contains(F.lower(line), F.lit(word)), name).otherwise(hinted)
    named = F.nullif(F.regexp_extract(line, r"\b([A-Z][A-Za-z0-9_]{2,})\b", 1), F.lit(""))
    return F.coalesce(quoted, hinted, named, fallback)


def stored_value(line: Column) -> Column:
    """The claim's text as stored: white space collapsed, cut at 180 characters."""
    return F.left(F.trim(F.regexp_replace(line, r"\s+", " ")), F.lit(180))


def sectioned_lines(docs: DataFrame) -> DataFrame:
    """Non-empty lines of documents (doc_id, title, text) with number and section path. Headings are folded into a
    stack: a heading of level n keeps the first n - 1 above it. Only headings are folded; the lines between two of them
    are a slice of the text."""
    heading = r"^\s{0,3}(#{1,6})\s+(\S.*?)\s*$"
    parts = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    numbered = F.transform("parts", lambda x, i: F.struct(F.length(F.regexp_extract(x, heading, 1)).alias("level"), F.regexp_extract(x, heading, 2).alias("title"), (i + 1).alias("no")))
    section = "array<struct<no:int,section:string>>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array(F.struct(F.lit(0).alias("no"), F.lit("").alias("section"))).cast(section).alias("out"))

    def step(s: Column, h: Column) -> Column:
        stack = F.concat(F.slice(s["stack"], 1, h["level"] - 1), F.array(h["title"]))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.struct(h["no"].alias("no"), F.array_join(stack, " > ").alias("section")))).alias("out"))

    rows = docs.select("doc_id", "title", parts.alias("parts")).withColumn("heads", F.filter(numbered, lambda h: h["level"] > 0)).withColumn("sections", F.aggregate("heads", start, step, lambda s: s["out"]))
    until = lambda i: F.coalesce(F.get("sections", i + 1)["no"], F.size("parts") + 1)
    cut = F.transform("sections", lambda s, i: F.struct(s["no"].alias("no"), s["section"].alias("section"), F.slice("parts", s["no"] + 1, until(i) - s["no"] - 1).alias("lines")))
    each = rows.select("doc_id", "title", F.explode(cut).alias("s")).select("doc_id", "title", F.col("s.no").alias("no"), F.col("s.section").alias("section"), F.posexplode("s.lines").alias("at", "raw"))
    return each.where(F.trim("raw") != "").select("doc_id", "title", F.trim("raw").alias("line"), (F.col("no") + F.col("at") + 1).alias("line_no"), F.concat_ws(" > ", "title", F.nullif("section", F.lit(""))).alias("section_path"))


def code_claims(docs: DataFrame) -> DataFrame:
    """Claims of each non-empty line of code (doc_id, title, text): what it reads, writes, keeps or guards."""
    rows = docs.select("doc_id", "title", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "raw")).where(F.trim("raw") != "")
    return line_claims(rows.select("doc_id", "title", F.trim("raw").alias("line"), (F.col("at") + 1).alias("line_no"), F.col("title").alias("section_path")), "implemented", F.col("title"))


def model_entities(docs: DataFrame, entities) -> DataFrame:
    """Claims that a model export (doc_id, title, text) names an entity, at the line where it first does."""
    body = F.coalesce("text", F.lit(""))
    at = lambda e: F.size(F.split(F.substring_index(body, e, 1), "\n"))
    found = F.array_compact(F.array(*(F.when(F.contains(body, F.lit(e)), F.struct(F.lit(e).alias("entity"), at(e).alias("line_no"))) for e in entities)))
    out = docs.select("doc_id", F.explode(found).alias("x"))
    return out.select("doc_id", F.col("x.line_no").alias("line_no"), F.concat(F.col("x.entity"), F.lit(".role")).alias("subject_key"), F.lit("metamodel_entity_exists").alias("predicate"), F.concat(F.col("x.entity"), F.lit(" is defined as a metaclass")).alias("value"), F.concat(F.lit("metamodel_export:"), F.col("x.line_no")).alias("section_path"))


def extract_claims(docs: DataFrame, entities=()) -> DataFrame:
    """Claims of documents (doc_id, source_type, title, text) by what they are: code, prose or a model export; each claim
    (subject, predicate, value, document) once, at its first line. Tickets give none."""
    code = code_claims(docs.where("source_type = 'github_file'"))
    prose = line_claims(sectioned_lines(docs.where("source_type IN ('confluence_page', 'local_doc')")), "documented", F.col("title"))
    every = code.union(prose)
    if entities:
        every = every.union(model_entities(docs.where("source_type = 'metamodel'"), entities))
    return every.groupBy("doc_id", "subject_key", "predicate", "value").agg(F.min_by(F.struct("line_no", "section_path"), "line_no").alias("first")).select("doc_id", "subject_key", "predicate", "value", "first.line_no", "first.section_path")


def line_claims(lines: DataFrame, prefix: str, fallback: Column) -> DataFrame:
    """Claims of each line: one for each aspect its words speak of, on the subject it names."""
    subject = subject_of(F.col("line"), fallback)
    rows = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(a).alias("aspect"), F.lit(f"{prefix}_{n}").alias("predicate"))) for a, n, p in ASPECTS)))
    out = lines.withColumn("subject", subject).withColumn("claim", F.explode(rows))
    return out.select("doc_id", "line_no", F.concat_ws(".", "subject", "claim.aspect").alias("subject_key"), F.col("claim.predicate").alias("predicate"), stored_value(F.col("line")).alias("value"), "section_path")


def config_claims(docs: DataFrame) -> DataFrame:
    """`key: value` and `key = value` lines with their dotted key, from an indentation stack folded over the lines."""
    start = F.struct(F.array().cast("array<struct<indent:int,key:string>>").alias("stack"), F.array().cast("array<struct<no:int,path:string,value:string>>").alias("out"), F.lit(0).alias("no"))
    pattern = r"^(\s*)(?:-\s*)?([A-Za-z0-9_.'\"-]+)\s*[:=]\s*(.*)$"

    def step(s: Column, line: Column) -> Column:
        key = F.translate(F.regexp_extract(line, pattern, 2), "'\"", "")
        indent = F.length(F.regexp_extract(line, pattern, 1))
        stack = F.concat(F.filter(s["stack"], lambda e: e["indent"] < indent), F.array(F.struct(indent.alias("indent"), key.alias("key"))))
        row = F.struct((s["no"] + 1).alias("no"), F.array_join(F.transform(stack, lambda e: e["key"]), ".").alias("path"), F.trim(F.regexp_extract(line, pattern, 3)).alias("value"))
        return F.struct(F.when(key != "", stack).otherwise(s["stack"]).alias("stack"), F.when(key != "", F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"), (s["no"] + 1).alias("no"))

    rows = F.aggregate(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), start, step, lambda s: s["out"])
    return docs.select("doc_id", F.inline(rows)).withColumnRenamed("no", "line_no")


def chain_paths(line: Column) -> Column:
    """The elements of a path written with arrows: the first name of each part."""
    parts = F.transform(F.split(line, "->|→"), lambda p: F.regexp_extract(p, r"([A-Za-z][A-Za-z0-9_]*)", 1))
    return F.filter(parts, lambda p: p != "")


def concept(predicate: Column) -> Column:
    out = predicate
    for prefix in CONCEPT_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix}", "")
    return F.replace(out, F.lit("allowlist_"), F.lit(""))


def record_weight(authority: Column, status: Column) -> Column:
    """Hundredths: an authority's tenths, by 0.7 if the claim is weak."""
    return scoring.lookup(authority, RECORD_WEIGHT, 10) * F.when(status.isin(*scoring.WEAK_STATUS), 7).otherwise(10)


def value_conflicts(claims: DataFrame) -> DataFrame:
    """Concepts of subjects with at least two sources whose values differ: the heaviest value first."""
    own = claims.withColumn("concept", concept(F.col("predicate"))).withColumn("value", F.upper(F.trim("normalized_value")))
    wide = own.groupBy("subject_key").agg(F.count_distinct("source_id").alias("n")).where("n >= 2").select("subject_key")
    by_value = own.join(wide, "subject_key", "left_semi").groupBy("subject_key", "concept", "value").agg(F.sum(record_weight(F.col("source_authority"), F.col("assertion_status"))).alias("weight"), F.count("*").alias("n"))
    out = by_value.groupBy("subject_key", "concept").agg(F.max_by("value", F.struct("weight", "n", "value")).alias("majority"), F.max("weight").alias("weight"), F.count("*").alias("n_values"))
    return out.where("n_values > 1")


def role_conflicts(claims: DataFrame) -> DataFrame:
    """Subjects that one source denies and another affirms."""
    low = F.lower("normalized_value")
    exists = F.col("source_type") == "metamodel"
    negative = ~exists & low.rlike("|".join(NEGATIVE))
    positive = ~exists & ~negative & low.rlike("|".join(POSITIVE))
    out = claims.groupBy("subject_key").agg(F.count_distinct("source_id").alias("n_sources"), F.count_if(negative).alias("negative"), F.count_if(positive | exists).alias("positive"))
    return out.where("n_sources >= 2 AND negative > 0 AND positive > 0")


def documentation_gaps(claims: DataFrame) -> DataFrame:
    """Scopes that code speaks of and documents don't: a missing part of a documented root needs one claim, a missing
    root two."""
    root = F.substring_index("subject_key", ".", 1)
    docs = claims.where(F.col("source_type").isin("confluence_page", "local_doc", "metamodel") & (F.col("source_authority") != "historical") & (F.col("assertion_status") != "secondary_only"))
    known = docs.select("subject_key").distinct()
    roots = docs.select(root.alias("root")).distinct().withColumn("documented", F.lit(True))
    code = claims.where((F.col("source_type") == "github_file") & (F.col("source_authority") != "historical") & (F.col("assertion_status") != "secondary_only")).join(known, "subject_key", "left_anti").withColumn("root", root).join(roots, "root", "left")
    scope = F.when(F.col("documented") & (F.col("subject_key") != F.col("root")), F.col("subject_key")).otherwise(F.col("root"))
    p, s = F.col("predicate"), F.col("subject_key")
    kind = F.when(F.bool_or(p.rlike("policy|approval")), "policy").when(F.bool_or(p.rlike("lifecycle|review_status")), "lifecycle").when(F.bool_or(s.rlike(r"^BSM\.(phase|process)")), "process").otherwise("entity")
    out = code.withColumn("scope", scope).groupBy("scope").agg(F.count("*").alias("n_claims"), kind.alias("gap_type"), F.bool_or(F.coalesce("documented", F.lit(False))).alias("root_documented"))
    inner = F.contains("scope", F.lit(".")) & F.col("root_documented")
    return out.where(F.when(inner, F.col("n_claims") >= 1).otherwise(F.col("n_claims") >= 2))


def near_lines(events: DataFrame, span: int = 24, ahead: int = 1) -> DataFrame:
    """Pairs of entity and write lines of one source within ``span`` lines, the write at most ``ahead`` lines before the
    entity. A band join: lines are dealt into buckets of ``span`` and each meets its own and the next one."""
    left = events.where("kind = 'entity'").select("source_id", F.col("line").alias("entity_line"), F.explode(F.array(F.floor(F.col("line") / span), F.floor(F.col("line") / span) + 1, F.floor(F.col("line") / span) - 1)).alias("bucket"))
    right = events.where("kind = 'write'").select("source_id", F.col("line").alias("write_line"), F.floor(F.col("line") / span).alias("bucket"))
    gap = F.col("write_line") - F.col("entity_line")
    return left.join(right, ["source_id", "bucket"]).where((gap <= span) & (gap >= -ahead)).select("source_id", "entity_line", "write_line")


def sequence_risks(events: DataFrame) -> DataFrame:
    """Functions whose first persisting line stands before their last enqueueing one."""
    out = events.groupBy("source_id", "func").agg(F.min(F.when(F.col("kind") == "persist", F.col("line"))).alias("persist"), F.max(F.when(F.col("kind") == "enqueue", F.col("line"))).alias("enqueue"))
    return out.where("persist < enqueue")
