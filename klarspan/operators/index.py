"""A full-text index that runs maintain: what changed among segments, postings by partition, and searches over them.

Segments (segment_id, source_id, segment_hash and the fields of search) are dealt into partitions by their source. An
update rebuilds the postings of partitions in which a segment changed, and takes the other partitions over as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.functions import text
from klarspan.operators import retrieval
from klarspan.operators.graph import kept

PARTITIONS = 64


def part_of(source_id, partitions: int = PARTITIONS):
    return F.pmod(F.xxhash64(source_id), F.lit(partitions)).cast("int")


def segment_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(segment_id, source_id, status): segments against those of the run before, by id and hash."""
    now = current.select("segment_id", F.col("source_id").alias("now_source"), F.col("segment_hash").alias("now"))
    then = previous.select("segment_id", F.col("source_id").alias("then_source"), F.col("segment_hash").alias("then"))
    status = F.when(F.col("then_source").isNull(), "added").when(F.col("now_source").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return now.join(then, "segment_id", "full").select("segment_id", F.coalesce("now_source", "then_source").alias("source_id"), status.alias("status"))


def build(segments: DataFrame, fields: dict[str, str], partitions: int = PARTITIONS) -> DataFrame:
    """Postings (part, segment_id, term, tf, n) of all segments, written by partition."""
    parts = segments.select("segment_id", part_of("source_id", partitions).alias("part"))
    return kept(retrieval.postings(segments, fields).join(parts, "segment_id").select("part", "segment_id", "term", "tf", "n"))


def update(postings: DataFrame, delta: DataFrame, segments: DataFrame, fields: dict[str, str], partitions: int = PARTITIONS) -> DataFrame:
    """The postings after a run: partitions with an added, changed or removed segment are replaced by their segments' new
    postings. A segment that left its source for another one counts in both partitions."""
    touched = delta.where("status <> 'unchanged'").select("segment_id", part_of("source_id", partitions).alias("part"))
    before = postings.select("segment_id", "part").join(touched.select("segment_id"), "segment_id", "left_semi").select("part")
    touched = kept(touched.select("part").union(before).distinct())
    again = segments.withColumn("part", part_of("source_id", partitions)).join(touched, "part", "left_semi").drop("part")
    return kept(postings.join(touched, "part", "left_anti").unionByName(build(again, fields, partitions)))


def search(postings: DataFrame, queries: DataFrame, n_segments: int, limit: int = 8) -> DataFrame:
    """(query_id, segment_id, bm25, lexical_score): the best segments for the first eight words of three letters or more of
    each query (query_id, text)."""
    asked = queries.select("query_id", text.keywords(F.col("text"), 8).alias("terms"))
    return retrieval.bm25(postings, asked, n_segments, limit).select("query_id", "segment_id", "bm25", "lexical_score")
