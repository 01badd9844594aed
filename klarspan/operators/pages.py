"""Analytics of a page tree: depth, children, titles, issues and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.operators.graph import depths

# Words of titles that tell technical pages from those on the subject.
TECHNICAL = (
    "api", "code", "deployment", "docker", "pipeline", "cicd", "ci/cd",
    "architektur", "architecture", "schema", "migration", "config",
    "endpoint", "swagger", "openapi", "terraform", "helm", "kubernetes",
    "git", "repository", "branch", "build", "test", "unit", "e2e",
    "backend", "frontend", "service", "microservice", "database", "db",
    "redis", "neo4j", "postgres", "sql", "cypher", "query",
    "debugging", "troubleshooting", "monitoring", "logging", "log",
    "devops", "infrastructure", "infra", "server", "cluster",
    "cython", "pydantic", "fastapi", "react", "vite", "typescript",
)
SUBJECT = (
    "anforderung", "requirement", "prozess", "process", "workflow",
    "geschäft", "business", "kunde", "customer", "benutzer", "user",
    "anleitung", "guide", "handbuch", "manual", "tutorial",
    "faq", "hilfe", "help", "support", "bedienung", "nutzung",
    "konzept", "concept", "strategie", "strategy", "roadmap",
    "rollen", "role", "berechtigung", "permission", "governance",
    "bsm", "metamodell", "metamodel", "audit", "compliance",
    "dokumentation", "doku", "übersicht", "overview", "zusammenfassung",
    "entscheidung", "decision", "richtlinie", "policy", "vorgabe",
    "onboarding", "schulung", "training", "einführung",
)


def title_class(title: Column) -> Column:
    low = F.lower(title)
    count = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    a, b = count(TECHNICAL), count(SUBJECT)
    return F.when((a > 0) & (b > 0), "mixed").when(a > b, "technical").when(b > a, "subject").otherwise("unclear")


def page_issues(pages: DataFrame) -> DataFrame:
    """Pages (node, parent, title) with depth, number of children, class and issues."""
    children = pages.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    rows = pages.join(depths(pages), "node").join(children, "node", "left").fillna({"children": 0})
    key = F.coalesce(F.concat(F.lit("="), F.lower(F.trim("title"))), F.lit(""))  # pages without a title are alike
    same = rows.groupBy(key.alias("_title")).agg(F.count("*").alias("same"))  # counted before the exchange, so that a frequent title is one row
    rows = rows.withColumn("class", title_class(F.col("title"))).withColumn("_title", key).join(same, "_title")
    tests = {
        "deep": F.col("depth") > 4, "long": F.length("title") > 80, "short": F.length("title") < 4, "runs": F.col("title").rlike("__|---"), "fat": F.col("children") > 12,
        "mixed": F.col("class") == "mixed", "unclear": F.col("class") == "unclear", "duplicate": F.col("same") > 1,
    }
    issues = F.array_join(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))), "|")
    return rows.select("node", "depth", "children", "class", issues.alias("issues"))


def key_figures(issues: DataFrame) -> DataFrame:
    """One row: totals by class and issue, and the structure and readability scores (0 to 100)."""
    n = lambda name: F.count_if(F.array_contains(F.split("issues", r"\|"), name))
    kinds = ("deep", "long", "short", "fat", "mixed", "unclear", "duplicate")
    out = issues.agg(F.count("*").alias("pages"), *(n(k).alias(k) for k in kinds), F.round(F.avg("depth"), 1).alias("avg_depth"), F.max("depth").alias("max_depth"))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    return out.withColumn("structure", clamp(100 - 8 * F.col("deep") - 10 * F.col("fat") - 15 * F.col("duplicate") - 5 * F.col("mixed") - 3 * F.col("unclear"))).withColumn("readability", clamp(100 - 8 * F.col("long") - 5 * F.col("short") - 6 * F.col("mixed")))


def scores(pages: DataFrame, issues: DataFrame, findings: DataFrame) -> DataFrame:
    """One row over pages (node, parent, title) with their issues: pages by class, those with issues and all issues, average
    and greatest depth, orphans (neither parent nor children), the share of clearly classified pages (percent), and scores from
    0 to 100: structure, readability (titles over 60 or under 8 characters count) and findings a page. No pages: zeros."""
    rows = issues.join(pages.select("node", "parent", "title"), "node")
    each = F.filter(F.split("issues", r"\|"), lambda x: x != "")
    n = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    kinds = ("subject", "technical", "mixed", "unclear")
    out = rows.withColumn("each", each).agg(
        F.count("*").alias("pages"), *(n(F.col("class") == k, k) for k in kinds), n(F.size("each") > 0, "with_issues"), F.coalesce(F.sum(F.size("each")), F.lit(0)).alias("issues"), F.coalesce(F.round(F.avg("depth"), 1), F.lit(0.0)).alias("avg_depth"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        n(F.col("parent").isNull() & (F.col("depth") == 0) & (F.col("children") == 0), "orphans"), n(F.col("depth") > 4, "_deep"), n(F.col("children") > 12, "_fat"), n(F.array_contains("each", "duplicate"), "_same"), n(F.length("title") > 60, "_long"), n(F.length("title") < 8, "_short"),
    )
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c)).cast("long")
    whole = lambda part: F.coalesce(F.round(F.try_divide(part, F.col("pages"))), F.lit(0)).cast("long")
    found = findings.agg(F.count("*").alias("_found"))  # one row
    return out.join(F.broadcast(found), how="cross").select(
        "pages", *kinds, "with_issues", "issues", "avg_depth", "max_depth", "orphans", whole(100 * (F.col("subject") + F.col("technical"))).alias("coverage"),
        clamp(100 - 8 * F.col("_deep") - 10 * F.col("_fat") - 15 * F.col("_same") - 5 * F.col("mixed") - 3 * F.col("unclear")).alias("structure"),
        clamp(100 - 8 * F.col("_long") - 5 * F.col("_short") - 6 * F.col("mixed")).alias("readability"), F.least(F.lit(100), whole(20 * F.col("_found"))).cast("long").alias("cross_references"),
    )


def suggestions(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each deep, overloaded, mixed or unclear page and each group of equal titles."""
    kinds = F.explode(F.array_intersect(F.split("issues", r"\|"), F.array(*map(F.lit, ("deep", "fat", "mixed", "unclear"))))).alias("kind")
    single = issues.select(kinds, F.col("node").cast("string").alias("key"))
    groups = pages.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), "key")
    return single.union(groups)
