"""Graph queries inside code and configuration: their text, the relations they name, and the paths these make."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.operators.graph import kept

# Words that make a string a graph query, and keys of configuration that hold one.
KEYWORDS = r"(?i)\b(?:MATCH|MERGE|CREATE|SET|RETURN|WITH|WHERE|OPTIONAL\s+MATCH|DETACH\s+DELETE|REMOVE|UNWIND|CALL)\b"
BLOCK_KEYS = r"(?i)cypher|query|template"
#: A node and the relation behind it, in either direction, before another node; groups: variable and label of the first,
#: arrow back, type, arrow forth, variable and label of the second.
_NODE = r"\(\s*([A-Za-z_]\w*)?\s*(?::\s*([A-Za-z_]\w*))?[^()]*\)"
EDGE = _NODE + r"\s*(<?)\s*-\s*\[\s*\w*\s*:\s*([A-Za-z_]+)[^\]]*\]\s*-\s*(>?)\s*(?=" + _NODE + ")"


def file_fragments(path: str, text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of the query strings of a file: literals of Python code, one for each expression of
    adjoining parts (a formatted string's values count as nothing), or the blocks of keys that say so in configuration."""
    import ast

    if path.endswith((".yaml", ".yml")):
        for m in re.finditer(r"(?m)^([ \t]*)(?:- )?([\w-]+):[ \t]*[|>][-+]?[ \t]*\n((?:(?:\1[ \t]+[^\n]*|[ \t]*)(?:\n|\Z))*?)(?=\1\S|(?![ \t\n])|\Z)", text):
            if re.search(BLOCK_KEYS, m[2]):
                first = text.count("\n", 0, m.start(3)) + 1
                yield first, first + m[3].rstrip("\n").count("\n"), m[3]
        return
    try:
        todo: list[ast.AST] = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError):
        return
    while todo:
        node = todo.pop()
        if isinstance(node, ast.JoinedStr):
            yield node.lineno, node.end_lineno, "".join(v.value if isinstance(v, ast.Constant) else "" for v in node.values)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            yield node.lineno, node.end_lineno, node.value
        else:
            todo += ast.iter_child_nodes(node)


def query_fragments(files: DataFrame) -> DataFrame:
    """(source_id, line, end_line, text) of all graph queries in files (source_id, path, text)."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(KEYWORDS)
        for frame in frames:
            rows = [(source, *f) for source, path, text in zip(frame["source_id"], frame["path"], frame["text"]) for f in file_fragments(path, text) if word.search(f[2])]
            yield pd.DataFrame(rows, columns=["source_id", "line", "end_line", "text"])

    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return files.select("source_id", plain("path"), plain("text")).mapInPandas(find, "source_id string, line int, end_line int, text string")


def query_edges(fragments: DataFrame) -> DataFrame:
    """(source_id, line, ordinal, src, type, dst) of fragments, in the direction of the arrow. A node without a label has
    that of its variable elsewhere in the fragment, or none (an empty text); chains share their inner nodes."""
    group = lambda i: F.regexp_extract_all("text", F.lit(EDGE), F.lit(i))
    parts = F.arrays_zip(*(group(i).alias(n) for i, n in ((1, "a"), (2, "al"), (3, "back"), (4, "type"), (5, "forth"), (6, "b"), (7, "bl"))))
    named = F.regexp_extract_all("text", F.lit(r"\(\s*([A-Za-z_]\w*)\s*:\s*([A-Za-z_]\w*)"), F.lit(0))
    pair = lambda x, i: F.regexp_extract(x, r"\(\s*([A-Za-z_]\w*)\s*:\s*([A-Za-z_]\w*)", i)
    label = lambda own, var: F.when(own != "", own).otherwise(F.coalesce(F.filter(F.col("named"), lambda x: x["name"] == var)[0]["label"], F.lit("")))
    rows = fragments.select("source_id", "line", F.transform(named, lambda x: F.named_struct(F.lit("name"), pair(x, 1), F.lit("label"), pair(x, 2))).alias("named"), F.posexplode(parts).alias("ordinal", "e"))
    left, right = label(F.col("e.al"), F.col("e.a")), label(F.col("e.bl"), F.col("e.b"))
    back = (F.col("e.back") == "<") & (F.col("e.forth") != ">")
    return rows.select("source_id", "line", "ordinal", F.when(back, right).otherwise(left).alias("src"), F.upper("e.type").alias("type"), F.when(back, left).otherwise(right).alias("dst"))


def query_steps(edges: DataFrame, labels: Collection[str], against: Collection[str] = ()) -> DataFrame:
    """Claims (source_id, line, subject_key, predicate, value) of the edges between two named nodes, one of them among
    ``labels``: each relation, each step of the chain, and which way the chain is read."""
    named = edges.where((F.col("src") != "") & (F.col("dst") != ""))
    arrow = F.concat("src", F.lit(" -[:"), "type", F.lit("]-> "), "dst")
    on_chain = F.col("src").isin(*labels) | F.col("dst").isin(*labels)
    rows = F.array_compact(
        F.array(
            F.struct(F.concat(F.lit("GraphWrite."), "type").alias("subject_key"), F.lit("code_graph_relation").alias("predicate"), arrow.alias("value")),
            F.when(on_chain, F.struct(F.concat_ws(".", F.lit("EvidenceChain.step"), "src", "type", "dst").alias("subject_key"), F.lit("code_evidence_chain_step").alias("predicate"), arrow.alias("value"))),
            F.when(on_chain, F.struct(F.lit("EvidenceChain.direction").alias("subject_key"), F.lit("code_evidence_chain_direction").alias("predicate"), F.when(F.col("type").isin(*against), "against").otherwise("along").alias("value"))),
        )
    )
    return named.select("source_id", "line", F.inline(rows)).distinct()


def query_paths(edges: DataFrame, against: Collection[str] = ()) -> DataFrame:
    """(source_id, line, path, hops) of each fragment: its longest walks over named nodes, from a node that nothing leads to
    (or, in a circle, from every node) to one that leads nowhere new. Relations in ``against`` are walked backwards, from
    what was derived on to what it was derived from last. Fragments walk at once, one relation a round."""
    turned = F.col("type").isin(*against) if against else F.lit(False)
    arcs = edges.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    arcs = kept(arcs.select("source_id", "line", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct())
    by = ["source_id", "line"]
    entered = arcs.select(*by, F.col("b").alias("a")).distinct()
    open_ = arcs.join(entered, [*by, "a"], "left_anti")
    circles = arcs.join(open_.select(*by).distinct(), by, "left_anti")
    frontier = kept(open_.union(circles).select(*by, F.array("a", "b").alias("path")))
    out = None
    while not frontier.isEmpty():
        ahead = arcs.withColumnRenamed("a", "end").groupBy(*by, "end").agg(F.collect_set("b").alias("next"))  # the nodes of one fragment
        step = kept(frontier.withColumn("end", F.element_at("path", -1)).join(ahead, [*by, "end"], "left").withColumn("next", F.array_except(F.coalesce("next", F.array().cast("array<string>")), "path")))
        ended = step.where(F.size("next") == 0).select(*by, "path")
        out = ended if out is None else out.union(ended)
        frontier = kept(step.select(*by, "path", F.explode("next").alias("b")).select(*by, F.concat("path", F.array("b")).alias("path")))
    rows = frontier if out is None else out
    return rows.select(*by, F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).alias("hops")).distinct()


def full_paths(paths: DataFrame, origin: Column, starts: Collection[str]) -> DataFrame:
    """Paths that begin with one of ``starts``, with the origin that stands before it."""
    first = F.substring_index("path", " -> ", 1)
    return paths.where(first.isin(*starts)).withColumn("path", F.concat_ws(" -> ", origin, "path")).withColumn("hops", F.col("hops") + 1)
