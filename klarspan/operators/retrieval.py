"""Segments, full-text search and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import text

K1, B = 1.2, 0.75
#: Weights of a segment's fields in search.
FIELDS = {"title": 4.0, "section": 2.0, "keywords": 1.0, "content": 1.0}


def lines(docs: DataFrame) -> DataFrame:
    """One row a line of the text, numbered from 1."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")


def segments(docs: DataFrame, flush: int = 700, least: int = 16) -> DataFrame:
    """Text segments: a heading starts one, and so does the first blank line after ``flush`` characters; segments under
    ``least`` characters drop out. A fold over each document's lines."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))

    def flushed(s: Column) -> Column:
        return F.when(F.length(F.trim(s["buffer"])) >= least, F.concat(s["done"], F.array(F.trim(s["buffer"])))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        heading = line.rlike("^#{1,6} ")
        blank = (F.trim(line) == "") & (F.length(s["buffer"]) >= flush)
        joined = F.when(s["buffer"] == "", line).otherwise(F.concat(s["buffer"], F.lit("\n"), line))
        return F.when(heading, F.struct(flushed(s).alias("done"), line.alias("buffer"))).when(blank, F.struct(flushed(s).alias("done"), F.lit("").alias("buffer"))).otherwise(F.struct(s["done"].alias("done"), joined.alias("buffer")))

    found = docs.select("doc_id", F.posexplode(F.aggregate(parts, start, step, flushed)).alias("ordinal", "content"))
    return found.select("doc_id", "ordinal", "content", text.content_hash(F.col("content")).alias("segment_hash"))


def code_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of code: a line that starts a class, function or decorated route begins one."""
    rows = lines(docs)
    start = F.col("line").rlike(r"^(class |def |async def |@)").cast("int")
    block = F.sum(start).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("block", block).groupBy("doc_id", "block").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count("*").alias("n_lines"))


def postings(segments_: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(segment_id, term, tf) with the fields' weights summed into the term frequency, and the segments' lengths."""
    parts = None
    for name, column in fields.items():
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0))
        one = segments_.select("segment_id", F.explode(words).alias("term"), F.lit(FIELDS[name]).alias("w"))
        parts = one if parts is None else parts.union(one)
    return parts.groupBy("segment_id", "term").agg(F.sum("w").alias("tf"), F.count("*").alias("n"))


def bm25(posted: DataFrame, queries: DataFrame, n_segments: int, limit: int = 10) -> DataFrame:
    """The best segments of each query (query_id, terms), by BM25 over weighted frequencies. The lexical score falls
    with the rank value, as 1 / (1 + rank)."""
    length = posted.groupBy("segment_id").agg(F.sum("n").alias("len"))
    mean = length.agg(F.sum("len").alias("all"))
    asked = queries.select("query_id", F.explode("terms").alias("term"))
    hits = posted.join(asked, "term")
    df = posted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(df, "term").join(length, "segment_id").join(F.broadcast(mean), how="cross")
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(n_segments) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") * n_segments / F.col("all")))
    scored = hits.groupBy("query_id", "segment_id").agg(F.round(F.sum(part), 6).alias("bm25"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "segment_id"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).withColumn("lexical_score", F.round(1 / (1 + F.abs("bm25")), 6))


def met(findings: DataFrame, segments_: DataFrame, most: int = 5) -> DataFrame:
    """finding_id, segment_id, direct, overlap: a finding (finding_id, source_id, anchor, words) and the segments of its
    source that have its anchor or a word in common. Of segments that are alike in anchor and words only the first
    ``most`` can be among a finding's best ``most``; the others meet nothing."""
    alike = Window.partitionBy("source_id", "anchor", "words").orderBy("segment_id")
    first = segments_.select("source_id", "segment_id", "anchor", F.array_sort(F.array_distinct("words")).alias("words")).withColumn("nr", F.row_number().over(alike)).where(F.col("nr") <= most)
    asked = findings.select("finding_id", "source_id", F.explode(F.array_distinct("words")).alias("word"))
    shared = asked.join(first.select("source_id", "segment_id", F.explode("words").alias("word")), ["source_id", "word"]).select("finding_id", "segment_id", F.lit(1).alias("word"), F.lit(False).alias("direct"))
    direct = findings.join(first, ["source_id", "anchor"]).select("finding_id", "segment_id", F.lit(0).alias("word"), F.lit(True).alias("direct"))
    every = shared.union(direct).groupBy("finding_id", "segment_id").agg(F.sum("word").alias("shared"), F.bool_or("direct").alias("direct"))
    sizes = findings.select("finding_id", F.greatest(F.lit(1), F.size(F.array_distinct("words"))).alias("n"))
    return every.join(sizes, "finding_id").select("finding_id", "segment_id", "direct", (F.col("shared") / F.col("n")).alias("overlap"))


def hybrid(candidates: DataFrame) -> DataFrame:
    """Score of (direct boolean, lexical, overlap, cosine) candidates: direct matches count most."""
    score = 1.2 * F.col("direct").cast("int") + 1.1 * F.coalesce("lexical", F.lit(0.0)) + F.col("overlap") + F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0)))
    return candidates.withColumn("score", F.round(score, 6))


def snippets(scored: DataFrame) -> DataFrame:
    """The best segments of each finding with a positive score: as many as its budget says."""
    place = F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("score"), "segment_id"))
    return scored.where("score > 0").withColumn("place", place).where(F.col("place") <= F.col("budget"))


def snippet_budget(bucket: Column, severity: Column) -> Column:
    return F.when(severity.isin("critical", "high") & bucket.isin("truth", "write_contract", "policy"), 5).when(severity.isin("critical", "high"), 4).otherwise(3)
