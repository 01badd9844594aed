"""Claims about whole functions and script blocks: what they read, write, keep or guard, and how they persist.

Functions of Python files come from a small parser; blocks of scripts are runs of lines, found with windows over a file's
lines. What they claim, and the shape of their persistence, are expressions over these rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.operators.extraction import HINTS, stored_value, subject_of
from klarspan.operators.repo import has_hint
from klarspan.sources.parsers import chain_of

NAMES = ["source_id", "func", "name", "decorators", "calls", "literals", "doc", "first_line", "last_line", "snippet"]
FUNCTIONS = "source_id string, func string, name string, decorators array<string>, calls array<string>, literals array<string>, doc string, first_line int, last_line int, snippet string"

# Words of names and bodies.
READ_VERBS = ("get", "list", "load", "read", "fetch", "query", "find", "collect", "resolve")
WRITE_VERBS = ("create", "update", "delete", "write", "persist", "save", "upsert", "merge", "patch", "publish")
LIFECYCLE_HINTS = ("status", "lifecycle", "promotion", "review", "histori", "freigabe")
POLICY_HINTS = ("read_only", "readonly", "allowlist", "approval", "approve", "guard", "scope", "tenant", "policy", "contract")
READ_ROUTES, WRITE_ROUTES = ("get",), ("post", "put", "patch", "delete")
SCRIPT_READS = ("fetch(", ".get(", "queryclient", "load", "usequery")
SCRIPT_WRITES = (".post(", ".put(", ".patch(", ".delete(", "mutate(", "usemutation")
SCRIPT_SYMBOL = r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function|const|let|class|interface|type)\s+([A-Za-z_][A-Za-z0-9_]*)"
LEAST_BLOCK = 18
# Signs of how a function persists.
GRAPH_BACKEND = ("neo4j", "execute_query", "execute_write", "write_transaction", "session", "tx.run", "merge (", "create (")
REPOSITORY_BACKEND = ("repo", "repository", "adapter")
CALL_OPERATIONS = (("repository_upsert", "(save|persist|upsert|merge)$"), ("repository_relationship_write", "(create_relationship|merge_relationship)$"), ("neo4j_query_write", "(execute_query|run|execute_write|write_transaction)$"))
HISTORY = ("history", "historic", "version", "audit_trail")


def _functions(text: str) -> Iterator[tuple]:
    """(func, name, decorators, calls, literals, doc, first line, last line) of a file's functions. Nested functions are
    functions of their own; what they do is also said of the one around them."""
    import ast

    try:
        todo = [((), ast.parse(text))]
    except (SyntaxError, ValueError, RecursionError):
        return
    while todo:
        around, node = todo.pop()
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                todo.append((around, child))
                continue
            path = (*around, child.name)
            todo.append((path, child))
            if isinstance(child, ast.ClassDef):
                continue
            inside = [n for part in child.body for n in ast.walk(part)]
            doc = ast.get_docstring(child) or ""
            calls = [chain_of(n.func) for n in inside if isinstance(n, ast.Call)]
            literals = [n.value for n in inside if isinstance(n, ast.Constant) and isinstance(n.value, str)]
            marks = [chain_of(d) for d in child.decorator_list]
            yield ".".join(path), child.name, marks, [c for c in dict.fromkeys(calls) if c], list(dict.fromkeys(literals[1 if doc else 0 :])), doc, child.lineno, child.end_lineno


def functions_of(files: DataFrame) -> DataFrame:
    """Functions of Python files (source_id, text), see ``_functions``, with their lines. Files that do not parse (and null
    or empty ones) give none."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, text in zip(frame["source_id"], frame["text"]):
                lines = text.splitlines()
                rows += [(source, *f, "\n".join(lines[f[6] - 1 : f[7]])) for f in _functions(text)]
            yield pd.DataFrame(rows, columns=NAMES)

    return files.select("source_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(parse, FUNCTIONS)


def _claimed(rows: DataFrame, tests: dict[str, Column], hint_text: Column, place: Column, hints) -> DataFrame:
    """A claim for each aspect that holds, on the subject that the hint text names."""
    aspects = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(a).alias("aspect"), F.lit("implemented_" + a.removesuffix("_path")).alias("predicate"))) for a, test in tests.items())))
    out = rows.withColumn("_subject", subject_of(hint_text, place, hints)).withColumn("_place", place).withColumn("_claim", F.explode(aspects))
    value = stored_value(F.concat("_place", F.lit(" ["), "_claim.predicate", F.lit("] "), "snippet"))
    return out.select("source_id", F.concat_ws(".", "_subject", "_claim.aspect").alias("subject_key"), "_claim.predicate", value.alias("value"), F.col("_place").alias("section_path"), "first_line", "last_line")


def function_claims(functions: DataFrame, hints=HINTS) -> DataFrame:
    """Claims (source_id, subject_key, predicate, value, section_path, first_line, last_line) of functions, once an aspect:
    read and write from routes in decorators and verbs in names, lifecycle and policy from words of names and bodies."""
    name, both = F.lower("name"), F.lower(F.concat_ws("\n", "name", "snippet"))
    verb = lambda verbs: name.rlike(f"^({'|'.join(verbs)})|({'|'.join(verbs)})_")
    routed = lambda routes: F.exists("decorators", lambda d: F.lower(d).rlike(rf"\.({'|'.join(routes)})\(\)$"))
    tests = {"read_path": routed(READ_ROUTES) | verb(READ_VERBS), "write_path": routed(WRITE_ROUTES) | verb(WRITE_VERBS), "lifecycle": has_hint(both, LIFECYCLE_HINTS), "policy": has_hint(both, POLICY_HINTS)}
    hint_text = F.concat_ws("\n", "name", "func", F.array_join("decorators", " "), "doc", "snippet", "source_id")
    return _claimed(functions, tests, hint_text, F.col("func"), hints)


def persistence(functions: DataFrame) -> DataFrame:
    """(source_id, func, kind, name): how functions persist. Kinds are the backend (a graph, else a repository), operations
    (from the ends of calls, verbs of queries and signs of history) and targets (labels and relations that queries name)."""
    said = F.lower(F.concat_ws(" ", "calls", "literals", "func"))
    history = has_hint(said, HISTORY)
    up = lambda t: F.upper(t)
    link = lambda t: F.contains(t, F.lit(")-[")) | F.contains(t, F.lit("]-("))
    verbs = {
        "neo4j_merge_relationship": lambda t: F.contains(up(t), F.lit("MERGE")) & link(t), "neo4j_create_relationship": lambda t: F.contains(up(t), F.lit("CREATE")) & link(t),
        "neo4j_merge_node": lambda t: F.contains(up(t), F.lit("MERGE")) & F.contains(t, F.lit("(")), "neo4j_create_node": lambda t: F.contains(up(t), F.lit("CREATE")) & F.contains(t, F.lit("(")),
        "neo4j_set_properties": lambda t: F.contains(up(t), F.lit("SET ")), "neo4j_delete": lambda t: F.contains(up(t), F.lit("DELETE ")),
    }
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"))
    names = lambda pattern, prefix: F.transform(F.flatten(F.transform("literals", lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))), lambda x: row("target", F.concat(F.lit(prefix), x)))
    owner = F.replace(F.initcap(F.regexp_replace(F.lower(F.substring_index("func", ".", 1)), "[^a-z0-9]+", " ")), F.lit(" "), F.lit(""))
    ends = lambda pattern: F.exists("calls", lambda c: F.lower(c).rlike(pattern))
    backend = F.when(has_hint(said, GRAPH_BACKEND), row("backend", F.lit("neo4j"))).when(has_hint(said, REPOSITORY_BACKEND), row("backend", F.lit("repository")))
    rows = [
        backend, F.when(history, row("target", F.concat(F.lit("History:"), owner))), F.when(history, row("operation", F.lit("history_append"))),
        *(F.when(ends(p), row("operation", F.lit(n))) for n, p in CALL_OPERATIONS), *(F.when(F.exists("literals", test), row("operation", F.lit(n))) for n, test in verbs.items()),
    ]
    every = F.concat(F.array_compact(F.array(*rows)), names(r"\(\s*[A-Za-z_][A-Za-z0-9_]*\s*:\s*([A-Za-z_][A-Za-z0-9_]*)", "Node:"), names(r"\[\s*[A-Za-z_][A-Za-z0-9_]*\s*:\s*([A-Z_][A-Z0-9_]*)", "Relationship:"))
    return functions.select("source_id", "func", F.inline(F.array_distinct(every)))


def script_blocks(files: DataFrame) -> DataFrame:
    """Blocks (source_id, symbol, first_line, last_line, snippet) of scripts (source_id, title, text): runs of lines that end
    before an empty line or a declared symbol, under the symbol declared last (before any, the title). A block of fewer than
    18 characters is none. The lines of a file are numbered in one window; no window spans files."""
    by = ["source_id", "_file"]
    lines = files.select("source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_file", F.xxhash64("title", "text"))
    lines = lines.select(*by, "title", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw")).distinct()
    order = Window.partitionBy(*by, "title").orderBy("at")
    symbol = F.nullif(F.regexp_extract("raw", SCRIPT_SYMBOL, 1), F.lit(""))
    lines = lines.withColumn("symbol", symbol).withColumn("blank", F.trim(F.regexp_replace("raw", r"\s", " ")) == "")
    lines = lines.withColumn("block", F.count_if(F.col("symbol").isNotNull() | F.col("blank")).over(order)).withColumn("symbol", F.coalesce(F.last("symbol", True).over(order), "title"))
    rows = lines.where("NOT blank").groupBy(*by, "title", "block").agg(F.min("symbol").alias("symbol"), (F.min("at") + 1).alias("first_line"), (F.max("at") + 1).alias("last_line"), F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("lines"))
    snippet = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["raw"]), "\n"), r"^\s+|\s+$", "")
    return rows.withColumn("snippet", snippet).where(F.length("snippet") >= LEAST_BLOCK).select("source_id", "title", "symbol", "first_line", "last_line", "snippet")


def script_claims(blocks: DataFrame, hints=HINTS) -> DataFrame:
    """Claims of script blocks as those of functions, from verbs and words anywhere in their symbol and text."""
    both = F.lower(F.concat_ws("\n", "symbol", "snippet"))
    low = F.lower("snippet")
    tests = {"read_path": has_hint(both, READ_VERBS) | has_hint(low, SCRIPT_READS), "write_path": has_hint(both, WRITE_VERBS) | has_hint(low, SCRIPT_WRITES), "lifecycle": has_hint(both, LIFECYCLE_HINTS), "policy": has_hint(both, POLICY_HINTS)}
    return _claimed(blocks, tests, F.concat_ws("\n", "symbol", "snippet", "title", "source_id"), F.col("symbol"), hints)
