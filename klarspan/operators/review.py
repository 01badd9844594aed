"""Fast review: prioritised sections, candidate pairs and heuristic cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.functions import scoring, text
from klarspan.operators.sections import review_parts

# Weights and signals of the fast review.
SOURCE_POINTS = {"confluence_page": 4, "metamodel": 5, "local_doc": 4, "github_file": 3, "jira_ticket": 2}
DELTA_POINTS = {"added": 4, "changed": 3, "unchanged": 0}
TERMS = ("approval", "review", "write", "read", "policy", "status", "phase", "question", "required", "must", "workflow", "owner", "schnittstelle", "prozess")
OBSOLETE, GAP = ("deprecated", "obsolete", "veraltet", "legacy"), ("todo", "tbd", "offen", "unclear", "missing")
MOST_SECTIONS, MOST_PAIRS, LEAST_BODY, LEAST_SCORE, LEAST_ALONE = 48, 14, 60, 3, 8


def sections(docs: DataFrame) -> DataFrame:
    """Sections of whole documents (doc_id, source_type, title, text, delta_status), see ``review_parts``, with bodies of
    at least 60 characters, and their priority."""
    rows = review_parts(docs).join(docs.select("doc_id", "source_type", "title", "delta_status"), "doc_id")
    rows = rows.withColumn("body", F.trim(F.regexp_replace("body", r"\s+", " "))).where(F.length("body") >= LEAST_BODY)
    rows = rows.withColumn("low", F.lower(F.concat_ws("\n", "heading", "body")))
    points = scoring.lookup(F.col("source_type"), SOURCE_POINTS, 1) + scoring.lookup(F.col("delta_status"), DELTA_POINTS, 2)
    for term in TERMS:
        points = points + F.contains("low", F.lit(term)).cast("int")
    return rows.select(text.section_id(F.col("doc_id").cast("string"), F.col("ordinal"), F.col("heading")).alias("section_id"), "doc_id", "source_type", "delta_status", points.alias("priority"), "title", "heading", "body")


def prioritised(sections_: DataFrame, most: int = MOST_SECTIONS) -> DataFrame:
    """The first sections by priority, with their topic words (those of the heading apart too)."""
    first = sections_.orderBy(F.desc("priority"), "section_id").limit(most)
    return first.withColumns({"tokens": text.topic_tokens(F.concat_ws("\n", "title", "heading", "body")), "heading_tokens": text.topic_tokens(F.col("heading"))}).drop("title", "heading")


def candidates(chosen: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """The two best partners of each prioritised section among the others' documents: two points for each shared topic
    word, three for each that both headings have, and two if either side changed, three at least; each pair once. A
    section of high priority without a partner stands alone (right_id is null). The first ``most`` in section order."""
    own = F.explode(F.transform("tokens", lambda t: F.struct(t.alias("token"), F.array_contains("heading_tokens", t).alias("heads"))))
    side = lambda s: chosen.select(*(F.col(c).alias(f"{s}_{c}") for c in ("section_id", "doc_id", "delta_status", "priority")), own.alias("t")).select("*", "t.token", F.col("t.heads").alias(f"{s}_heads")).drop("t")
    shared = side("l").join(side("r"), "token").where("l_section_id <> r_section_id AND l_doc_id <> r_doc_id")
    pairs = shared.groupBy("l_section_id", "l_priority", "r_section_id", "l_delta_status", "r_delta_status").agg(F.count("*").alias("overlap"), F.count_if(F.col("l_heads") & F.col("r_heads")).alias("headings"))
    score = 2 * F.col("overlap") + 3 * F.col("headings") + F.when((F.col("l_delta_status") != "unchanged") | (F.col("r_delta_status") != "unchanged"), 2).otherwise(0)
    place = F.row_number().over(Window.partitionBy("l_section_id").orderBy(F.desc("score"), "r_section_id"))
    best = pairs.withColumn("score", score).where(F.col("score") >= LEAST_SCORE).withColumn("place", place).where("place <= 2")
    turn = lambda priority, section, nr: F.struct((-F.col(priority)).alias("p"), F.col(section).alias("l"), F.lit(nr).alias("place") if isinstance(nr, int) else nr)
    once = best.groupBy(F.least("l_section_id", "r_section_id").alias("left_id"), F.greatest("l_section_id", "r_section_id").alias("right_id")).agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"), F.min(turn("l_priority", "l_section_id", F.col("place"))).alias("turn"))
    matched = best.select(F.col("l_section_id").alias("section_id")).distinct()
    alone = chosen.where(F.col("priority") >= LEAST_ALONE).join(matched, "section_id", "left_anti")
    alone = alone.select(F.col("section_id").alias("left_id"), F.lit(None).cast("string").alias("right_id"), F.col("priority").cast("long").alias("score"), F.lit(0).cast("long").alias("overlap"), turn("priority", "section_id", 1).alias("turn"))
    return once.union(alone).orderBy("turn").limit(most).drop("turn")


def card_type(left: Column, right: Column, overlap: Column) -> Column:
    """What a pair of bodies suggests: obsolete before gap before error before misunderstanding; null under two words."""
    has = lambda words: F.lower(left).rlike("|".join(words)) | F.lower(right).rlike("|".join(words))
    negated = r"(^|[^a-z])(not|no|kein|nicht|never)([^a-z]|$)"
    conflict = F.lower(left).rlike(negated) != F.lower(right).rlike(negated)
    return F.when(overlap < 2, None).when(has(OBSOLETE), "obsolete").when(has(GAP), "gap").when(conflict, "error").otherwise("misunderstanding")


def cards(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """A card for each pair that suggests a deviation, and a gap for each section that stands alone."""
    body = lambda s: chosen.select(F.col("section_id").alias(f"{s}_id"), F.col("body").alias(f"{s}_body"))
    joined = pairs.join(body("left"), "left_id").join(body("right"), "right_id", "left")
    kind = F.when(F.col("right_id").isNull(), "gap").otherwise(card_type(F.col("left_body"), F.col("right_body"), F.col("overlap")))
    confidence = F.when(F.col("right_id").isNull(), 0.62).when(F.col("deviation_type") == "misunderstanding", 0.58).otherwise(0.68)
    return joined.withColumn("deviation_type", kind).where("deviation_type IS NOT NULL").select("left_id", "right_id", "score", "deviation_type", confidence.alias("confidence"))
