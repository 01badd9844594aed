"""Sections: minimal changed paths, claims to extract again, and texts cut into sections for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.functions import text

CODE_BLOCK = r"^(class\s+\w+|async\s+def\s+\w+|def\s+\w+|interface\s+\w+|function\s+\w+|const\s+\w+\s*=)"


def _stripped(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\n\x0b\f\r"))


def _inner(tokens: Column) -> Column:
    """All runs of neighbouring tokens, as joined paths: what overlap looks for, so that it becomes an equi join."""
    n = F.size(tokens)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(tokens, i, j - i + 1), " > "))))
    return F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def minimal_paths(changed: DataFrame) -> DataFrame:
    """Of each source's section paths (source_id, section_path) those in which no shorter one of them stands; normalised."""
    paths = changed.select("source_id", text.section_tokens(F.col("section_path")).alias("t")).where(F.size("t") > 0).select("source_id", "t", F.array_join("t", " > ").alias("path")).distinct()
    parts = paths.select("source_id", "path", F.explode(_inner(F.col("t"))).alias("part")).where("part <> path")
    covered = parts.join(paths.select("source_id", F.col("path").alias("part")), ["source_id", "part"], "left_semi").select("source_id", "path").distinct()
    return paths.select("source_id", "path").join(covered, ["source_id", "path"], "left_anti")


def regeneration(claims: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """record_ord, action: claims (record_ord, source_id, section_path) of sections that were removed are dropped; those
    without a section, and those whose section meets a changed one, are extracted again; the others are reused. Sources
    without changes are reused whole."""
    minimal = minimal_paths(changed)
    of = claims.select("record_ord", "source_id", text.section_tokens(F.col("section_path")).alias("t")).withColumn("path", F.array_join("t", " > "))
    own = of.select("source_id", "t", "path").distinct()
    inside = own.select("source_id", "path", F.explode(_inner(F.col("t"))).alias("part")).join(minimal.select("source_id", F.col("path").alias("part")), ["source_id", "part"], "left_semi").select("source_id", "path")
    heads = minimal.select("source_id", F.split("path", " > ").alias("p")).select("source_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), " > "))).alias("path"))
    touched = inside.union(heads).distinct().withColumn("touched", F.lit(True))
    gone = removed.select("source_id", F.array_join(text.section_tokens(F.col("section_path")), " > ").alias("path")).where("path <> ''").distinct().withColumn("gone", F.lit(True))
    some = minimal.select("source_id").distinct().withColumn("some", F.lit(True))
    out = of.join(touched, ["source_id", "path"], "left").join(gone, ["source_id", "path"], "left").join(some, "source_id", "left")
    action = F.when(F.col("gone"), "drop").when(F.col("touched") | (F.col("some") & (F.col("path") == "")), "regenerate").otherwise("reuse")
    return out.select("record_ord", action.alias("action"))


def review_parts(docs: DataFrame, least: int = 900) -> DataFrame:
    """Sections of texts (doc_id, source_type, title, text) for a review: code by its classes and functions, other texts by
    headings; without either, paragraphs gathered up to ``least`` characters, under the title."""
    docs = docs.select("doc_id", "source_type", "title", _stripped(F.coalesce("text", F.lit(""))).alias("body"))
    body = F.col("body")
    pieces = lambda pattern: F.split(body, rf"(?m)(?={pattern})")
    code = (F.col("source_type") == "github_file") & body.rlike(f"(?m){CODE_BLOCK}")
    headed = body.rlike(r"(?m)^#{1,6}\s+.+$")
    code_parts = F.transform(F.filter(pieces(CODE_BLOCK), lambda p: p.rlike(CODE_BLOCK)), lambda p: F.struct(F.regexp_extract(p, CODE_BLOCK, 1).alias("heading"), _stripped(p).alias("body")))
    cut = lambda p: F.struct(_stripped(F.regexp_replace(F.regexp_extract(p, r"^(#{1,6}\s+[^\n]+)", 1), "^#+", "")).alias("heading"), _stripped(F.regexp_replace(p, r"^#{1,6}\s+[^\n]+", "")).alias("body"))
    heading_parts = F.filter(F.transform(F.filter(pieces(r"^#{1,6}\s+.+$"), lambda p: p.rlike(r"^#{1,6}\s+.+")), cut), lambda s: s["body"] != "")
    own = docs.select("doc_id", "title", "body", F.when(code, code_parts).when(headed, heading_parts).alias("found"))
    paragraphs = F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda p: _stripped(p)), lambda p: p != "")
    gathered = F.transform(_gathered(paragraphs, least), lambda p: F.struct(F.col("title").alias("heading"), p.alias("body")))
    parts = F.when(F.size("found") > 0, F.col("found")).otherwise(gathered)
    return own.select("doc_id", F.posexplode(parts).alias("ordinal", "p")).select("doc_id", "ordinal", "p.heading", "p.body")


def _gathered(paragraphs: Column, least: int) -> Column:
    """Paragraphs joined until they reach ``least`` characters."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        n, joined = s["n"] + F.length(p), F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        full = n >= least
        return F.struct(F.when(full, "").otherwise(joined).alias("open"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, F.concat(s["out"], F.array(joined))).otherwise(s["out"]).alias("out"))

    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["open"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def fast_selection(docs: DataFrame, signals, path_words=(".puml", "metamodel_export.json", "current_dump.json", "ssot", "status", "scope", "run", "pipeline")) -> DataFrame:
    """Documents that a fast run extracts claims from: chosen ones, models, prose with a signal word, code with a signal
    word or a telling path."""
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    body = F.lower(F.coalesce("text", F.lit("")))
    path = F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("path_hint", F.lit(""))))
    signal = any_of(body, signals)
    prose = F.col("source_type").isin("confluence_page", "local_doc") & signal
    code = (F.col("source_type") == "github_file") & (signal | any_of(path, path_words))
    return docs.where(F.col("chosen") | (F.col("source_type") == "metamodel") | prose | code)


def style_profile(docs: DataFrame, most: int = 8, sample: int = 20, least: int = 100) -> DataFrame:
    """The most frequent headings of the first documents of over ``least`` characters, numbers aside."""
    first = docs.where(F.length("text") > least).orderBy("doc_id").limit(sample)
    found = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    clean = F.trim(F.regexp_replace(F.col("heading"), r"[0-9.]+\s*", ""))
    headings = first.select(F.explode(found).alias("heading")).select(clean.alias("heading")).where("heading <> ''")
    return headings.groupBy("heading").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "heading").limit(most)


def changed_pages(listed: DataFrame, previous: DataFrame, cached: DataFrame) -> DataFrame:
    """page_id, action: a listed page is reused if its revision is the one seen before and the cache holds its body."""
    seen = previous.select("page_id", F.col("revision").alias("old")).dropDuplicates(["page_id"])
    out = listed.join(seen, "page_id", "left").join(cached.select("page_id").distinct().withColumn("held", F.lit(True)), "page_id", "left")
    return out.select("page_id", F.when((F.col("revision") == F.col("old")) & F.col("held"), "reuse").otherwise("fetch").alias("action"))


def access_state(pages: DataFrame) -> DataFrame:
    """restriction and sensitivity of pages (restrictions, classification, prop_key, prop_value, label): the explicit field
    decides, then the property, then the label; else unknown."""
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    key, value, label = F.col("prop_key"), F.col("prop_value"), F.col("label")
    by_property = F.when(has(key, ("restriction", "access", "visibility", "permission")), F.when(has(value, ("restricted", "private", "internal", "confidential", "secret")), "restricted").when(has(value, ("public", "open", "unrestricted")), "none"))
    restriction = F.coalesce(F.when(F.col("restrictions").isNotNull(), F.when(F.col("restrictions") > 0, "restricted").otherwise("none")), by_property, F.when(has(label, ("restricted", "private", "confidential", "secret")), "restricted"), F.lit("unknown"))
    explicit = F.nullif(F.trim("classification"), F.lit(""))
    by_key = F.when(has(key, ("classification", "sensitivity", "data-class", "security")), F.when(has(value, ("restricted", "confidential", "secret", "internal", "sensitive", "pii", "gdpr")), "restricted").when(has(value, ("standard", "public", "open")), "standard"))
    by_label = F.when(has(label, ("confidential", "restricted", "secret", "sensitive", "pii", "gdpr")), "restricted").when(has(label, ("public", "standard", "open")), "standard")
    sensitivity = F.coalesce(F.when(explicit.isNotNull(), F.when(F.lower(explicit).isin("restricted", "confidential", "secret", "internal-sensitive"), "restricted").otherwise("standard")), by_key, by_label, F.lit("unknown"))
    return pages.select("page_id", restriction.alias("restriction"), sensitivity.alias("sensitivity"))
