"""What functions of code do, line by line: one pass over each file gives a table of events, rules are joins over it.

An event (source_id, func, block, kind, name, line) says that a line of a function shows something: a pattern's kind, a
call of a name, an entity, a field. Rules over events: one kind of step before another (steps may be taken by helpers
that the function calls, however deep), fields that a context needs and does not get, and outputs with missing fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.operators.graph import kept

EVENTS = "source_id string, func string, block int, kind string, name string, line int"

# What a line of code does. A pattern with a group gives the event the group's text as its name.
STEPS = {
    "persist": r"(?i)(?:\b|_)(?:persist\w*|save\w*|upsert\w*|merge\w*|create_node\w*|create_relationship\w*|merge_relationship\w*|execute_write\w*|bulk_write\w*|write_transaction\w*|write_cypher_guarded|apply_write_rule|run_write_rule)\s*\(",
    "enqueue": r"(?i)(?:\b|_)(?:enqueue\w*|add_job\w*|submit\w*|schedule\w*|dispatch\w*|delay\w*|send_task\w*|apply_async|create_job\w*|queue_job\w*|publish\w*)\s*\(",
    "supersede": r"(?i)(?:\b|_)(?:supersede\w*|historize\w*|historise\w*|archive\w*|deactivate\w*|set_historic\w*|mark_historic\w*)\s*\(",
    "rebuild": r"(?i)(?:\b|_)(?:rebuild\w*|regenerate\w*|rematerializ\w*|materializ\w*|consolidat\w*|create_new\w*|build_new\w*|generate_new\w*)\s*\(",
    "context": r"(?i)(?<![A-Za-z0-9])(?:refine|manual(?!_raw)(?:\b|[_:]))",
    "schema": r"(?i)(?:response_schema|output_schema|json_schema|structured_output|function_call|tool_call|response_format|parse_response|extract_from_response)",
}
NAME_CONTEXT = r"(?i)(?<![A-Za-z0-9])(?:refine|manual|legacy|fallback|v1|compat)(?![A-Za-z0-9])"
NOT_CALLS = frozenset({"if", "for", "while", "return", "yield", "case", "match", "with"})
#: Lines between a context or an entity and the writes it belongs to, and how far an entity may stand behind them.
NEAR, AHEAD = 24, 1


def _docstrings(text: str) -> set[int]:
    """Lines inside the docstrings of the file, its classes and functions."""
    import ast

    try:
        todo = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError):
        return set()
    lines: set[int] = set()
    while todo:
        node = todo.pop()
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            lines |= set(range(first.lineno, first.end_lineno + 1))
        todo += [n for n in node.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
    return lines


def line_events(text: str, patterns: dict[str, re.Pattern], entities: dict[str, str]) -> Iterator[tuple]:
    """(func, block, kind, name, line) of a file. Classes and functions form a stack by indentation; a line belongs to the
    innermost function, named with the innermost class; ``block`` counts the functions begun so far."""
    hidden = _docstrings(text)
    stack: list[tuple[int, bool, str]] = []  # indentation, whether a class, name
    block, signature = 0, 0  # signature: brackets of a function's head that are still open
    for no, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or no in hidden:
            continue
        indent = len(raw) - len(raw.lstrip())
        opened = line.count("(") - line.count(")")
        if signature <= 0:
            while stack and indent <= stack[-1][0]:
                stack.pop()
        head = re.match(r"(class|(?:async\s+)?def)\s+(\w+)", line)
        if head and signature <= 0:
            stack.append((indent, head[1] == "class", head[2]))
            signature = opened
            if head[1] != "class":
                block += 1
                yield _scope(stack), block, "def", head[2], no
            continue
        if line.startswith("#"):
            continue
        signature = signature + opened if signature > 0 else 0
        func = _scope(stack)
        for kind, pattern in patterns.items():
            for found in pattern.finditer(line) if pattern.groups else filter(None, [pattern.search(line)]):
                yield func, block, kind, next((g.lower() for g in found.groups() if g), ""), no
        low = line.lower()
        bare = re.sub("[^a-z0-9]+", "", low)
        for entity in {e for word, e in entities.items() if word in low or word in bare}:
            yield func, block, "entity", entity, no
        for name in set(re.findall(r"\b([A-Za-z_]\w*)\s*\(", line)) - NOT_CALLS:
            yield func, block, "call", name, no


def _scope(stack: list[tuple[int, bool, str]]) -> str:
    cls = next((n for _, is_class, n in reversed(stack) if is_class), "")
    func = next((n for _, is_class, n in reversed(stack) if not is_class), "")
    return f"{cls}.{func}" if cls and func else func


def code_events(files: DataFrame, entities: dict[str, str] | None = None, fields: str = "", more: dict[str, str] | None = None) -> DataFrame:
    """Events of Python files (source_id, text), each once a line. ``entities`` maps words (lower case) to the entity they
    speak of, ``fields`` is a pattern of assigned field names (a group), ``more`` are patterns of further kinds."""
    kinds = STEPS | ({"field": fields} if fields else {}) | (more or {})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = {k: re.compile(p) for k, p in kinds.items()}
        for frame in frames:
            rows = [(source, *e) for source, text in zip(frame["source_id"], frame["text"]) for e in dict.fromkeys(line_events(text, patterns, entities or {}))]
            yield pd.DataFrame(rows, columns=["source_id", "func", "block", "kind", "name", "line"])

    return files.select("source_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(scan, EVENTS)


def scan_state(events: DataFrame) -> DataFrame:
    """(source_id, func, kind, names, lines, first, last): what each function shows, by kind. Names are those of a file's
    vocabulary; lines those of one function."""
    return events.groupBy("source_id", "func", "kind").agg(F.count_distinct("name").alias("names"), F.count_distinct("line").alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"))


def helper_calls(events: DataFrame) -> DataFrame:
    """(source_id, func, target, line): calls of functions of the same file by their bare name."""
    named = events.where("kind = 'def'").select("source_id", "name", F.col("func").alias("target")).distinct()
    return events.where("kind = 'call'").select("source_id", "func", "name", "line").join(named, ["source_id", "name"]).where("func <> target").select("source_id", "func", "target", "line").distinct()


def reaching(events: DataFrame, kind: str, calls: DataFrame) -> DataFrame:
    """(source_id, func): functions that take a step of some kind, or call one that does, over any number of helpers."""
    arcs = kept(calls.select("source_id", "func", "target").distinct())
    seen = frontier = kept(events.where(F.col("kind") == kind).select("source_id", "func").distinct())
    while not frontier.isEmpty():
        callers = arcs.join(frontier.withColumnRenamed("func", "target"), ["source_id", "target"]).select("source_id", "func").distinct()
        frontier = kept(callers.join(seen, ["source_id", "func"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def step_gaps(events: DataFrame, first: str, then: str, helpers: bool = False) -> DataFrame:
    """(source_id, func, first_line, last_line): functions that take a step ``first`` before their last step ``then``;
    with ``helpers``, calls of functions that reach such a step count as one."""
    own = events.where(F.col("kind").isin(first, then)).select("source_id", "func", "kind", "line")
    if helpers:
        calls = kept(helper_calls(events))
        reach = reaching(events, then, calls)
        through = calls.join(reach.withColumnRenamed("func", "target"), ["source_id", "target"]).select("source_id", "func", F.lit(then).alias("kind"), "line")
        own = own.union(through)
    out = own.groupBy("source_id", "func").agg(F.min(F.when(F.col("kind") == first, F.col("line"))).alias("first_line"), F.max(F.when(F.col("kind") == then, F.col("line"))).alias("last_line"))
    return out.where("first_line < last_line")


def step_claims(events: DataFrame) -> DataFrame:
    """Claims (source_id, subject_key, predicate, value, line) of both kinds of gaps: state stored before the work on it is
    queued, and a chain replaced before its replacement is built."""
    kinds = (("persist", "enqueue", True, "TemporalConsistency.persist_then_enqueue", "code_eventual_consistency_risk"), ("supersede", "rebuild", False, "TemporalConsistency.supersede_then_rebuild", "code_chain_interruption_risk"))
    out = None
    for first, then, helpers, subject, risk in kinds:
        gaps = step_gaps(events, first, then, helpers)
        value = F.concat(F.col("func"), F.lit(f": {first} in line "), F.col("first_line").cast("string"), F.lit(f", {then} in line "), F.col("last_line").cast("string"))
        rows = gaps.select("source_id", F.lit(subject).alias("subject_key"), F.inline(F.array(F.struct(F.lit("code_temporal_sequence").alias("predicate"), F.lit(f"{first}_before_{then}").alias("value")), F.struct(F.lit(risk).alias("predicate"), value.alias("value")))), F.col("first_line").alias("line"))
        out = rows if out is None else out.union(rows)
    return out


def propagation_gaps(events: DataFrame, field: str, path_context=None) -> DataFrame:
    """(source_id, func, entity, contexts, line): functions in a side context that write an entity without handing on
    ``field``. They store, replace or rebuild something; their name or a line near a write names the context; a line near
    a write, and not behind all of them, names the entity. A function counts if it has an event of kind ``write`` or its
    source fits ``path_context`` (a column of source_id)."""
    by = ["source_id", "func"]
    writes = events.where("kind IN ('persist', 'supersede', 'rebuild', 'write')").select(*by, F.col("line").alias("write_line"), F.floor(F.col("line") / NEAR).alias("bucket")).distinct()
    span = events.where("kind IN ('persist', 'supersede', 'rebuild', 'write')").groupBy(*by).agg(F.max("line").alias("last_write"), F.bool_or(F.col("kind") != "write").alias("stores"), F.bool_or(F.col("kind") == "write").alias("writes"))
    span = span.where(F.col("stores") & (F.col("writes") | (F.lit(False) if path_context is None else path_context)))
    near = events.where("kind IN ('entity', 'context')").select(*by, "kind", "name", "line", F.explode(F.array(*(F.floor(F.col("line") / NEAR) + i for i in (-1, 0, 1)))).alias("bucket"))
    near = near.join(writes, [*by, "bucket"]).where(F.abs(F.col("line") - F.col("write_line")) <= NEAR).select(*by, "kind", "name", "line").distinct()
    named = events.where(F.col("kind") == "def").groupBy(*by).agg(F.min("line").alias("start"), F.bool_or(F.col("name").rlike(NAME_CONTEXT)).alias("by_name"))
    lines = near.where("kind = 'context'").select(*by).distinct().withColumn("by_line", F.lit(True))
    given = events.where((F.col("kind") == "field") & (F.col("name") == field)).select(*by).distinct()
    entities = near.where("kind = 'entity'").join(span, by).where(F.col("line") <= F.col("last_write") + AHEAD).select(*by, F.col("name").alias("entity")).distinct()
    out = entities.join(given, by, "left_anti").join(named, by, "left").join(lines, by, "left")
    contexts = F.array_join(F.array_compact(F.array(F.when(F.col("by_line"), F.lit("line_context")), F.when(F.col("by_name"), F.lit("name_context")))), ",")
    return out.withColumn("contexts", contexts).where("contexts <> ''").select(*by, "entity", "contexts", F.coalesce("start", F.lit(1)).alias("line"))


def output_gaps(events: DataFrame, required, least: int = 2) -> DataFrame:
    """(source_id, func, found, missing, line): outputs described in a function's block, from its first line that speaks of
    a schema on, which name at least ``least`` of the required fields (events of kind ``output``) but not all."""
    by = ["source_id", "block"]
    starts = events.where("kind = 'schema'").groupBy(*by).agg(F.min("line").alias("start"), F.min_by("func", "line").alias("func"))
    fields = events.where((F.col("kind") == "output") & F.col("name").isin(*required)).select(*by, "name", "line").join(starts, by).where("line >= start")
    found = fields.groupBy(*by, "start", "func").agg(F.array_sort(F.collect_set("name")).alias("found"))  # at most the required names
    missing = F.array_except(F.array_sort(F.array(*map(F.lit, required))), F.col("found"))
    return found.withColumn("missing", missing).where((F.size("found") >= least) & (F.size("missing") > 0)).select("source_id", "func", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"), F.col("start").alias("line"))
