"""Short overviews of what there is to read: a repository's folders, services, routes and settings, and a wiki's spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from klarspan.operators.function_claims import functions_of
from klarspan.operators.graph import kept

#: How many lines of each section an overview shows, public methods of a service, pages of a space.
SHOWN = {"folder": 20, "service": 15, "route": 20, "setting": 10}
METHODS, PAGES, HEAD = 5, 25, 300
ROUTE = r"(?i)@\w*\.(?:router\.)?(?:get|post|put|patch|delete)\(\s*[\"'][^\"']+"


def repository_overview(files: DataFrame, setting: str = r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b") -> DataFrame:
    """(section, place, line) of code files (source_id, text): folders with their numbers of files, classes with their first
    public methods, routes with their verbs, and settings (names that fit the pattern), each by name, as many as are shown."""
    files = files.where("source_id IS NOT NULL")
    folder = F.regexp_extract("source_id", "^(.*)/[^/]*$", 1)
    folders = files.select(folder.alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n")).select(F.lit("folder").alias("section"), F.concat("folder", F.lit("/ ("), F.col("n").cast("string"), F.lit(" files)")).alias("line"), F.col("folder").alias("by"))
    methods = functions_of(files).select("source_id", F.regexp_replace("func", r"\.[^.]*$", "").alias("class"), "func", "name", "first_line").where("class <> func AND NOT startswith(name, '_')").distinct()
    nr = F.row_number().over(Window.partitionBy("source_id", "class").orderBy("first_line", "name"))
    public = methods.withColumn("nr", nr).where(F.col("nr") <= METHODS).groupBy("source_id", "class").agg(F.array_sort(F.collect_list(F.struct("nr", "name"))).alias("m"))
    line = F.concat("class", F.lit(" ("), "source_id", F.lit("): "), F.array_join(F.transform("m", lambda x: x["name"]), ", "))
    services = public.select(F.lit("service").alias("section"), line.alias("line"), line.alias("by"))
    body = F.coalesce("text", F.lit(""))
    found = files.select(F.explode(F.regexp_extract_all(body, F.lit(ROUTE), F.lit(0))).alias("r")).distinct()
    route = F.concat_ws(" ", F.upper(F.regexp_extract("r", r"(?i)\.(get|post|put|patch|delete)\(", 1)), F.regexp_extract("r", r"[\"']([^\"']+)$", 1))
    routes = found.select(F.lit("route").alias("section"), route.alias("line"), route.alias("by"))
    settings = files.select(F.explode(F.regexp_extract_all(body, F.lit(setting), F.lit(0))).alias("line")).select(F.lit("setting").alias("section"), "line", F.col("line").alias("by"))
    out = None
    for rows, section in ((folders, "folder"), (services, "service"), (routes, "route"), (settings, "setting")):
        first = kept(rows.distinct().orderBy("by", "line").limit(SHOWN[section]))
        out = first if out is None else out.union(first)
    return out.select("section", F.row_number().over(Window.partitionBy("section").orderBy("by", "line")).alias("place"), "line")  # the few rows shown


def wiki_map(pages: DataFrame) -> DataFrame:
    """(space, n_pages, place, line) of pages (page_id, space, title, text): the first pages of each space by id, with the first
    heading within their first 300 characters. Pages without a space are in ``default``."""
    space = F.coalesce(F.nullif("space", F.lit("")), F.lit("default"))
    rows = pages.where("page_id IS NOT NULL").select("page_id", space.alias("space"), "title", F.left(F.coalesce("text", F.lit("")), F.lit(HEAD)).alias("head"))
    counts = rows.groupBy("space").agg(F.count("*").alias("n_pages"))
    # the first pages of each range of ids, then of these: no task holds the pages of a large space
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("page_id", "title"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("page_id"), F.lit(256)))
    first = dealt.withColumn("place", by("space", "_part")).where(F.col("place") <= PAGES).withColumn("place", by("space")).where(F.col("place") <= PAGES)
    theme = F.nullif(F.trim(F.left(F.trim(F.regexp_extract("head", r"(?m)^#{1,3}\s+(.+)", 1)), F.lit(60))), F.lit(""))
    name = F.coalesce(F.nullif("title", F.lit("")), F.col("page_id").cast("string"))
    return first.join(counts, "space").select("space", "n_pages", "place", F.concat_ws(": ", name, theme).alias("line"))
