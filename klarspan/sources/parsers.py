"""Parsers of code and notation: Python symbols and calls, graph-query fragments, tables, diagrams and allow-lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.operators.extraction import config_claims
from klarspan.operators.graph import closure

SYMBOLS = "source_id string, kind string, name string, target string, line int"


def python_symbols(files: DataFrame) -> DataFrame:
    """(source_id, kind, name, target, line) of Python files (source_id, text): classes, bases, functions, imports and
    calls, named by their enclosing scopes. Files that do not parse give one row of kind `error`."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        def dotted(node) -> str:
            if isinstance(node, ast.Name):
                return node.id
            if isinstance(node, ast.Attribute):
                return f"{dotted(node.value)}.{node.attr}".lstrip(".")
            return dotted(node.func) if isinstance(node, ast.Call) else ""

        for frame in frames:
            rows = []
            for source, text in zip(frame["source_id"], frame["text"]):
                try:
                    todo = [(ast.parse(text or ""), "")]
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((source, "error", "", "", 0))
                    continue
                while todo:
                    node, scope = todo.pop()
                    inner = scope
                    if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                        inner = f"{scope}.{node.name}".lstrip(".")
                        is_class = isinstance(node, ast.ClassDef)
                        rows.append((source, "class" if is_class else "function", inner, "", node.lineno))
                        rows += [(source, "base", inner, dotted(b), node.lineno) for b in (node.bases if is_class else ()) if dotted(b)]
                    elif isinstance(node, ast.Call) and dotted(node.func):
                        rows.append((source, "call", scope, dotted(node.func), node.lineno))
                    elif isinstance(node, ast.Import):
                        rows += [(source, "import", a.asname or a.name, a.name, node.lineno) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        rows += [(source, "import", a.asname or a.name, f"{node.module or ''}.{a.name}".lstrip("."), node.lineno) for a in node.names]
                    todo += [(child, inner) for child in ast.iter_child_nodes(node)]
            yield pd.DataFrame(rows, columns=["source_id", "kind", "name", "target", "line"])

    return files.select("source_id", "text").mapInPandas(parse, SYMBOLS)


FACTS = "source_id string, module string, kind string, scope string, name string, target string, line int"
#: Bases whose classes are interfaces, and wrappers of a type that stand for what they hold.
INTERFACES = ("Protocol", "typing.Protocol", "ABC", "abc.ABC")
WRAPPERS = ("Optional", "typing.Optional", "Annotated", "typing.Annotated")


def module_of(path: Column) -> Column:
    """The dotted module of a file's path: without a leading src, its suffix and __init__."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"\.py$", ""), r"^(\./)*(src/)?", "")
    parts = F.filter(F.split(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "[^A-Za-z0-9_]", "_")), "."), F.lit("")), F.lit("module"))


def chain_of(node) -> str:
    """A dotted chain of names; a call in it ends in brackets."""
    import ast

    if isinstance(node, ast.Await):
        return chain_of(node.value)
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return (inner := chain_of(node.value)) and f"{inner}.{node.attr}"
    return (inner := chain_of(node.func)) and f"{inner}()" if isinstance(node, ast.Call) else ""


def type_of(node) -> str:
    """The class that an annotation names: of an optional one its content, of a union its first member but None."""
    import ast

    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return type_of(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return ""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return type_of(node.left) or type_of(node.right)
    if isinstance(node, ast.Subscript):
        inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
        return type_of(inner) if chain_of(node.value) in WRAPPERS else ""
    return chain_of(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def _function_facts(node, symbol: str, cls: str) -> list[tuple]:
    """What a function says: result type, typed parameters, assignments, attributes it sets, contexts and calls."""
    import ast

    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    types = {a.arg: t for a in args if (t := type_of(a.annotation))}
    out = [("function", cls, symbol, "", node.lineno), ("returns", "", symbol, type_of(node.returns), node.lineno)]
    out += [("decorator", "", symbol, chain_of(d).removesuffix("()"), node.lineno) for d in node.decorator_list]
    out += [("local", symbol, name, f"{t}()", node.lineno) for name, t in types.items()]
    for inner in ast.walk(node):
        if isinstance(inner, ast.Call) and (chain := chain_of(inner.func)):
            out.append(("call", symbol, cls, chain, inner.lineno))
        elif isinstance(inner, (ast.Assign, ast.AnnAssign)):
            value = chain_of(inner.value) if inner.value is not None else ""
            annotated = type_of(inner.annotation) if isinstance(inner, ast.AnnAssign) else ""
            for to in inner.targets if isinstance(inner, ast.Assign) else [inner.target]:
                bound = f"{annotated}()" if annotated else f"{types[value]}()" if value in types else value
                if isinstance(to, ast.Name) and bound:
                    out.append(("local", symbol, to.id, bound, inner.lineno))
                elif isinstance(to, ast.Attribute) and chain_of(to.value) == "self" and bound and cls:
                    out.append(("attribute", cls, to.attr, bound, inner.lineno))
        elif isinstance(inner, (ast.With, ast.AsyncWith)):
            for item in inner.items:
                chain = chain_of(item.context_expr)
                if chain:
                    out.append(("context", symbol, cls, chain.removesuffix("()"), inner.lineno))
                if chain and isinstance(item.optional_vars, ast.Name):
                    out.append(("local", symbol, item.optional_vars.id, chain, inner.lineno))
    return out


def file_facts(module: str, text: str, is_package: bool = False) -> list[tuple]:
    """(kind, scope, name, target, line) of a Python file: what later joins resolve across files. In a package's own file,
    relative imports begin with the package."""
    import ast

    try:
        todo = [(node, module, "") for node in ast.parse(text or "").body]
    except (SyntaxError, ValueError, RecursionError):
        return [("error", "", "", "", 0)]
    out, package = [], module.split(".") + ["__init__"] * is_package
    while todo:
        node, scope, cls = todo.pop()
        if isinstance(node, ast.ClassDef):
            own = f"{scope}.{node.name}"
            out.append(("class", cls, own, "", node.lineno))
            bases = [chain_of(b) for b in node.bases]
            out += [("base", "", own, b, i) for i, b in enumerate(bases) if b and b not in INTERFACES]
            abstract = any(chain_of(d).endswith("abstractmethod") for f in node.body for d in getattr(f, "decorator_list", ()))
            if abstract or any(b in INTERFACES for b in bases) or node.name.endswith(("Protocol", "Interface")):
                out.append(("interface", "", own, "", node.lineno))
            out += [("attribute", own, f.target.id, f"{t}()", f.lineno) for f in node.body if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name) and (t := type_of(f.annotation))]
            todo += [(child, own, own) for child in node.body]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += _function_facts(node, f"{scope}.{node.name}", cls)
        elif isinstance(node, ast.Import):
            out += [("import", "", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            above = package[: max(0, len(package) - node.level)] if node.level else []
            start = ".".join([*above, *filter(None, [node.module])])
            out += [("import", "", a.asname or a.name, f"{start}.{a.name}".lstrip("."), node.lineno) for a in node.names if a.name != "*"]
        elif isinstance(node, (ast.If, ast.Try)):
            todo += [(child, scope, cls) for child in ast.iter_child_nodes(node) if isinstance(child, ast.stmt)]
    return out


def repo_facts(files: DataFrame) -> DataFrame:
    """Facts of a repository's Python files (source_id, path, text), one row each: classes with bases and typed
    attributes, functions with result types, local variables, contexts, decorators and calls, and imports, all by full
    names. Names inside the facts are not resolved yet; files that do not parse give a row of kind `error`."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(source, module, *fact) for source, module, text, package in zip(frame["source_id"], frame["module"], frame["text"], frame["package"]) for fact in file_facts(module, text, package)]
            yield pd.DataFrame(rows, columns=["source_id", "module", "kind", "scope", "name", "target", "line"])

    path = F.coalesce("path", F.lit(""))
    return files.select("source_id", module_of(path).alias("module"), F.coalesce("text", F.lit("")).alias("text"), path.rlike(r"(^|[/\\\\])__init__\.py$").alias("package")).mapInPandas(parse, FACTS)


def resolved_calls(symbols: DataFrame) -> DataFrame:
    """(src, dst): calls between functions. A bare or `self.` name resolves within its file, first to a method of the
    caller's class, else to any function of that last name in the file."""
    functions = symbols.where("kind = 'function'").select("source_id", F.col("name").alias("dst_name"), F.substring_index("name", ".", -1).alias("last"))
    calls = symbols.where("kind = 'call' AND name <> ''").select("source_id", "name", F.substring_index("target", ".", -1).alias("last"), "line")
    own = F.regexp_replace("name", r"\.[^.]*$", "")
    near = calls.join(functions, ["source_id", "last"]).withColumn("same", F.col("dst_name") == F.concat_ws(".", own, "last"))
    best = near.groupBy("source_id", "name", "last").agg(F.min_by("dst_name", F.struct(~F.col("same"), "dst_name")).alias("dst_name"))
    key = lambda c: F.concat_ws(":", "source_id", c)
    return best.select(key("name").alias("src"), key("dst_name").alias("dst")).distinct()


def reachable_calls(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    return closure(resolved_calls(symbols), depth)


def transitive_bases(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst): every class with all classes it descends from, by last names within a file."""
    bases = symbols.where("kind = 'base'").select(F.concat_ws(":", "source_id", F.substring_index("name", ".", -1)).alias("src"), F.concat_ws(":", "source_id", F.substring_index("target", ".", -1)).alias("dst"))
    return closure(bases, depth)


def graph_relations(text: Column) -> Column:
    """Relations that a graph query names: (from label, type, to label), in the direction of the arrow."""
    pattern = r"\(\w*:?(\w*)[^)]*\)\s*(<?)-\[\w*:(\w+)[^\]]*\]-(>?)\s*\(\w*:?(\w*)[^)]*\)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(found, lambda x: F.struct(F.when(part(x, 2) == "<", part(x, 5)).otherwise(part(x, 1)).alias("src"), part(x, 3).alias("type"), F.when(part(x, 2) == "<", part(x, 1)).otherwise(part(x, 5)).alias("dst")))


def table_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, header, cell) of pipe tables: a line before a rule of dashes is the header of those below. Lines
    are rows that look back to the last rule and the last line without a pipe, so that the work grows with the lines."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = texts.select("doc_id", F.sha2("text", 256).alias("digest"), F.split("text", r"\r?\n").alias("lines"))
    above = F.concat(F.array(F.lit("")), F.slice("lines", 1, F.size("lines") - 1))
    lines = split.select("doc_id", "digest", F.posexplode(F.arrays_zip("lines", above.alias("above"))).alias("no", "r")).select("doc_id", "digest", "no", F.col("r.lines").alias("line"), F.col("r.above").alias("above"))
    piped = F.startswith(F.trim("line"), F.lit("|"))
    marked = lines.withColumn("piped", piped).withColumn("rule", piped & F.col("line").rlike(r"^[\s|:-]+$"))
    so_far = Window.partitionBy("doc_id", "digest").orderBy("no")  # rows of one id and text have the same lines, so they may share one
    last_rule = F.max(F.when(F.col("rule"), F.struct("no", "above"))).over(so_far)
    last_bare = F.max(F.when(~F.col("piped"), F.col("no"))).over(so_far)
    seen = marked.select("doc_id", "no", "line", "piped", "rule", last_rule.alias("under"), last_bare.alias("bare"))
    rows = seen.where(F.col("piped") & ~F.col("rule") & (F.col("under.no") > F.coalesce("bare", F.lit(-1))))
    flat = rows.select("doc_id", (F.col("no") + 1).alias("line_no"), cells(F.col("under.above")).alias("h"), F.posexplode(cells(F.col("line"))).alias("i", "cell"))
    return flat.select("doc_id", "line_no", F.get("h", F.col("i")).alias("header"), "cell")


def diagram_arrows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, src, dst, label) of arrows in diagram text, outside notes and legends."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("no", "line"))
    line = F.trim("line")
    opens = line.rlike(r"(?i)^(note|legend)\b") & ~line.rlike(":")
    closes = line.rlike(r"(?i)^end ?(note|legend)")
    depth = F.sum(opens.cast("int") - closes.cast("int")).over(Window.partitionBy("doc_id").orderBy("no"))
    pattern = r"^\[?(\w+)\]?\s*[-.]+(?:\[[^\]]*\])?[-.]*>+\s*\[?(\w+)\]?\s*(?::\s*(.*))?$"
    found = rows.withColumn("depth", depth).where((F.col("depth") <= 0) & line.rlike(pattern))
    return found.select("doc_id", (F.col("no") + 1).alias("line_no"), F.regexp_extract(line, pattern, 1).alias("src"), F.regexp_extract(line, pattern, 2).alias("dst"), F.regexp_extract(line, pattern, 3).alias("label"))


def allow_list(docs: DataFrame, name: str = "allow") -> DataFrame:
    """Entries of configuration below a key whose name holds ``name``: (doc_id, line_no, path, value)."""
    return config_claims(docs).where(F.contains(F.lower("path"), F.lit(name)))


def missing_fields(found: Column, required: Column) -> Column:
    """Required fields that are not found."""
    return F.array_except(required, found)
