"""Tokens, vectors, sections and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword search leaves out.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "und", "der", "die", "das", "mit")


def _words(text: Column, pattern: str, stopwords) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*stopwords)))


def keywords(text: Column, limit: int, stopwords=STOPWORDS) -> Column:
    """The first ``limit`` distinct words of at least three letters, in order of appearance."""
    return F.slice(_words(text, "[a-z0-9_]{3,}", stopwords), 1, limit)


def topic_tokens(text: Column, stopwords=STOPWORDS) -> Column:
    return _words(text, "[a-z0-9_]{4,}", stopwords)


def query_tokens(text: Column, limit: int = 8, stopwords=STOPWORDS) -> Column:
    return F.slice(_words(text, "[a-z0-9_]{2,}", stopwords), 1, limit)


def keyword_overlap(left: Column, right: Column) -> Column:
    """Share of the left words that the right ones contain; 0 if either side is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.size(F.array_distinct(left))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def section_id(document: Column, index: Column, heading: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("|", document, index.cast("string"), heading)), F.lit(16))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate(text: Column, limit: int) -> Column:
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 3))), F.lit("..."))).otherwise(text)


def excerpt(text: Column, sentences: int = 2, chars: int = 420) -> Column:
    """The first sentences, cut at a number of characters."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"(?<=[.!?])\s+")
    return truncate(F.array_join(F.slice(parts, 1, sentences), " "), chars)


def cleaned_list(values: Column) -> Column:
    """Trimmed, without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def scopes_overlap(left: Column, right: Column) -> Column:
    """Equal, or one a dotted prefix of the other."""
    return (left == right) | F.startswith(left, F.concat(right, F.lit("."))) | F.startswith(right, F.concat(left, F.lit(".")))


def ancestors(key: Column) -> Column:
    """A dotted key and all its dotted prefixes, so that prefix joins become equi joins."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def section_tokens(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">"), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def sections_overlap(target: Column, candidate: Column) -> Column:
    """The target's tokens stand together in the candidate's, or the candidate is a prefix of the target."""
    last = F.size(candidate) - F.size(target) + 1
    inside = F.when((F.size(target) > 0) & (last > 0), F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(candidate, i, F.size(target)) == target)).otherwise(F.lit(False))
    return inside | ((F.size(candidate) > 0) & (F.slice(target, 1, F.size(candidate)) == candidate))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def path_divergence(documented: Column, implemented: Column) -> Column:
    """Shared prefix and suffix lengths (computed each on their own), what each path has between them, and the mode."""
    prefix, suffix = common_prefix(documented, implemented), common_prefix(F.reverse(documented), F.reverse(implemented))
    gap = lambda p: F.slice(p, prefix + 1, F.greatest(F.lit(0), F.size(p) - prefix - suffix))
    left, right = gap(documented), gap(implemented)
    mode = (
        F.when(F.array_join(documented, ">") == F.array_join(implemented, ">"), "equal")
        .when((prefix > 0) & (suffix > 0), "internal")
        .when(prefix > 0, "tail")
        .when(suffix > 0, "prefix")
        .otherwise("full")
    )
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"), left.alias("documented_gap"), right.alias("implemented_gap"), mode.alias("mode"))
