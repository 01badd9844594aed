"""Benchmark decontamination with DataFrame functions alone.

The windows (n-grams) of the benchmark are hashed and broadcast; every window of every document probes that set in
the scan's own stage, survivors are verified word by word against the benchmark's windows, and each document's hits
merge into spans. The broadcast holds 8 bytes a window and is made only up to MOST_WINDOWS windows; beyond, the same
windows meet in a shuffled join.

Windows name the set of their items by a fingerprint, and so do documents the sets of their windows: the items of each
combination are gathered once, not once for each document that shows it.

Null or empty text has no words; an item without words has no windows. Repeated rows each give a row. A null item id
is written as `null`. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct windows that are broadcast at most (some 24 MB).
MOST_WINDOWS = 1_000_000
#: Stands for the document itself among its windows' hashes.
DOCUMENT = -0x5EED5EED5EED


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _starts(words: Column, length: int | Column) -> Column:
    """Where windows of a length start, from 1."""
    n = F.size(words) - length + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """size, win (the words, space-joined), hash, item: the windows of each item, each once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.lit(length), F.size("words")))
    each = items.select("item", "size", F.explode(F.array_distinct(F.transform(_starts(F.col("words"), F.col("size")), lambda i: F.slice("words", i, F.col("size"))))).alias("part"))
    return each.select("size", F.concat_ws(" ", "part").alias("win"), F.xxhash64("part").alias("hash"), "item").distinct()


def item_sets(each: DataFrame) -> DataFrame:
    """size, win, hash, items: the windows, each with the fingerprint of the set of its items."""
    sums = [F.sum(F.xxhash64("item", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return each.groupBy("size", "win", "hash").agg(F.concat_ws(":", F.count("*"), *sums).alias("items"))


def _members(each: DataFrame, windows: DataFrame) -> DataFrame:
    """items, item: the members of each set of items, taken from one window that has it."""
    one = windows.groupBy("items").agg(F.min(F.struct("size", "win")).alias("w")).select("items", "w.*")
    return each.join(one, ["size", "win"]).select("items", "item")


def _hits(docs: DataFrame, windows: DataFrame, most_windows: int) -> DataFrame:
    """row, doc_id, text_md5, n_words, spans ([start, end) in words), sets (of items, sorted)."""
    known = windows.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each of at most ``length`` sizes
    sizes = sorted((r["size"] for r in known), reverse=True)
    small = sum(r["n"] for r in known) <= most_windows
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), words_of(F.col("text")).alias("words"))
    hashed = lambda k: F.transform(_starts(F.col("words"), k), lambda i: F.xxhash64(F.slice("words", i, k)))
    hashes = [hashed(k) for k in sizes]
    each = texts.select("row", "doc_id", "text_md5", "words", F.posexplode(F.concat(F.array(F.lit(DOCUMENT)), *hashes)).alias("at", "hash"))
    pos, size, below = F.lit(0), F.lit(0), F.lit(0)
    for k in sizes:  # the windows of all sizes stand in one array, after the document itself
        here = F.col("at") > below
        pos, size = F.when(here, F.col("at") - below).otherwise(pos), F.when(here, F.lit(k)).otherwise(size)
        below = below + F.greatest(F.size("words") - k + 1, F.lit(0))
    probe = windows.select("hash").union(spark.range(1).select(F.lit(DOCUMENT).cast("long").alias("hash"))).distinct()
    win = F.when(size > 0, F.concat_ws(" ", F.slice("words", F.greatest(pos, F.lit(1)), size))).otherwise(F.col("row").cast("string"))  # documents meet no window, each under a key of its own
    described = ["row", "doc_id", "text_md5", F.size("words").cast("long").alias("n_words"), pos.alias("pos"), size.alias("size"), win.alias("win")]
    if small:
        hits = each.join(F.broadcast(probe), "hash", "left_semi").select(*described)
    else:
        hits = each.select("hash", *described).join(probe, "hash", "left_semi").drop("hash")
    hits = hits.join(windows.select("size", "win", "items"), ["size", "win"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct((F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.col("size")).alias("end")))
    by_doc = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_md5").alias("text_md5"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(hit)).alias("hits"), F.array_sort(F.collect_set("items")).alias("sets"))

    def merged(spans: Column, h: Column) -> Column:
        last = F.element_at(spans, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= h["start"]), F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(longer))).otherwise(F.concat(spans, F.array(h)))

    spans = F.aggregate("hits", F.array().cast("array<struct<start:int,end:int>>"), merged)
    return by_doc.select("row", "doc_id", "text_md5", "n_words", spans.alias("spans"), "sets")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans ([start, end) in words), text_md5."""
    each = C.written(benchmark_windows(benchmark, length), "windows")
    windows = C.written(item_sets(each), "item_sets")
    key = F.when(F.size("sets") > 0, F.sha2(F.array_join("sets", ","), 256)).otherwise(F.concat(F.lit("row "), F.col("row").cast("string")))  # rows without hits are not one hot key
    found = C.written(_hits(docs, windows, most_windows).withColumn("key", key), "hits")
    combinations = found.where(F.size("sets") > 0).groupBy("key").agg(F.first("sets").alias("sets")).select("key", F.explode("sets").alias("items"))
    members = combinations.join(_members(each, windows), "items").select("key", "item").distinct()
    ids = F.array_sort(F.collect_list("item"))
    digests = members.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.join(digests, "key", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "text_md5")


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents, all columns, without those in which a window of the benchmark stands."""
    windows = C.written(item_sets(benchmark_windows(benchmark, length)), "item_sets")
    bad = _hits(docs, windows, most_windows).where(F.size("spans") > 0).select("text_md5").distinct()
    return docs.join(bad, F.md5(F.coalesce(docs["text"], F.lit(""))) == bad["text_md5"], "left_anti")


ORACLE_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {ORACLE_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS part FROM sized),
doc AS (SELECT row_number() OVER () AS r, doc_id, {ORACLE_WORDS} AS w FROM documents),
spot AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win)),
hit AS (SELECT r, i, k, item FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS part FROM spot) JOIN win USING (k, part)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN ids USING (r)
"""
