"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klarspan.llm import decontaminate as decontamination
from klarspan.llm import infill, licenses, mixing, packing, periods, topk, url_filter
from klarspan.llm.language import identify
from klarspan.llm.pii import find_pii
from klarspan.llm.simhash import simhash_dedup
from klarspan.llm.substring_dedup import substring_dedup

from klarspan.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), length=35).drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=400, passage=256).drop("spans", "repeated")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), length=10).drop("spans", "text_md5")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), url_filter.outcomes_of(_table(spark, sf_dir, "labels")))


#: The mixture: a first source cut to a tenth, two lifted, the others as they are.
WEIGHTS = {"src0": 0.1, "src1": 0.15, "src2": 0.1}


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS, seed=20)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"), size=4, radius=4)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), size=1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(periods.planted(_table(spark, sf_dir, "documents")), least=6, exponent=4)
    best = periods.longest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(_table(spark, sf_dir, "documents"), seed=1, percent=90, suffix_first=20)
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_top_k, op3_substring_dedup, op4_language_id, op5_pii, op6_suffix_array_dedup, op7_decontaminate, op8_url_filter, op9_mix_sources, op10_simhash_dedup, op11_best_fit_packing, op12_periodic_runs, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.ORACLE, "op2_top_k": topk.ORACLE, "op7_decontaminate": decontamination.ORACLE, "op8_url_filter": url_filter.ORACLE, "op9_mix_sources": mixing.oracle(WEIGHTS, seed=20), "op13_fill_in_middle": infill.oracle(seed=1, percent=90, suffix_first=20)}
