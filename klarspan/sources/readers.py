"""Readers: files of a repository, wiki pages as blocks, JSON document trees, and model dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which files a repository scan reads.
SUFFIXES = ("py", "ts", "tsx", "js", "md", "rst", "txt", "yaml", "yml", "json", "toml", "puml", "sql", "cypher")
EXCLUDED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", ".idea", ".pytest_cache")


def repository(spark: SparkSession, root: str, suffixes=SUFFIXES, excluded=EXCLUDED) -> DataFrame:
    """source_id (path below root), text, content_hash, length, modified for every file of an allowed suffix outside
    excluded folders. Read as binary files, so names are pruned before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index("path", base, -1)
    inside = ~F.concat(F.lit("/"), path).rlike("/(" + "|".join(e.replace(".", r"\.") for e in excluded) + ")/")
    text = F.decode("content", "UTF-8")
    return files.where(inside).select(path.alias("source_id"), text.alias("text"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), "length", F.col("modificationTime").alias("modified"))


def reusable(current: DataFrame, previous: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Current files (source_id, length, modified) with whether the previous read can stand: not among the changed
    paths where those are known, else same size and time."""
    before = previous.select("source_id", F.col("length").alias("_l"), F.col("modified").alias("_m"))
    joined = current.join(before, "source_id", "left")
    if changed is not None:
        joined = joined.join(changed.select("source_id").distinct().withColumn("_c", F.lit(True)), "source_id", "left")
        return joined.withColumn("reusable", F.col("_l").isNotNull() & F.col("_c").isNull()).drop("_l", "_m", "_c")
    return joined.withColumn("reusable", F.coalesce((F.col("_l") == F.col("length")) & (F.col("_m") == F.col("modified")), F.lit(False))).drop("_l", "_m")


def markup_text(html: Column) -> Column:
    """Plain text of markup: scripts and styles go, block ends break lines, entities are resolved."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|table|ul|ol|section|article|title)\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, kind, text, section_path of markup pages (page_id, html): a stateful parser over Arrow batches."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        class Blocks(HTMLParser):
            KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_cell", "pre": "code"}

            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.out, self.kind, self.parts, self.hidden = [], [], None, [], 0

            def close_block(self):
                text = " ".join("".join(self.parts).split())
                if text:
                    if self.kind and self.kind.startswith("h") and self.kind[1:].isdigit():
                        self.stack = [*self.stack[: int(self.kind[1:]) - 1], text]
                    self.out.append((self.KINDS.get(self.kind, "text"), text, " > ".join(self.stack)))
                self.parts = []

            def handle_starttag(self, tag, attrs):
                self.hidden += tag in ("script", "style")
                if tag in self.KINDS:
                    self.close_block()
                    self.kind = tag

            def handle_endtag(self, tag):
                self.hidden -= tag in ("script", "style") and self.hidden > 0
                if tag == self.kind:
                    self.close_block()
                    self.kind = None

            def handle_data(self, data):
                if not self.hidden:
                    self.parts.append(data)

        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"]):
                parser = Blocks()
                parser.feed(html or "")
                parser.close_block()
                rows += [(page, i, *block) for i, block in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "kind", "text", "section_path"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, ordinal int, kind string, text string, section_path string")


def document_tree(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, text, section_path of nested JSON document trees (doc_id, body): any depth, by an explicit
    stack over Arrow batches."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def flat(node) -> str:
            parts, todo = [], [node]
            while todo:
                n = todo.pop()
                if isinstance(n, dict):
                    parts.append(n.get("text") or "")
                    todo += reversed(n.get("content") or [])
            return " ".join("".join(parts).split())

        for frame in frames:
            rows = []
            for doc, body in zip(frame["doc_id"], frame["body"]):
                try:
                    todo = [json.loads(body or "{}")]
                except ValueError:
                    todo = []
                stack, n = [], 0
                while todo:
                    node = todo.pop()
                    if not isinstance(node, dict):
                        continue
                    kind = node.get("type")
                    if kind in ("heading", "paragraph", "codeBlock", "tableCell", "listItem"):
                        text = flat(node)
                        if kind == "heading":
                            stack = [*stack[: int((node.get("attrs") or {}).get("level", 1)) - 1], text]
                        if text:
                            rows.append((doc, n, kind, text, " > ".join(stack)))
                            n += 1
                    else:
                        todo += reversed(node.get("content") or [])
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "kind", "text", "section_path"])

    return docs.select("doc_id", "body").mapInPandas(walk, "doc_id long, ordinal int, kind string, text string, section_path string")


def section_digests(blocks: DataFrame) -> DataFrame:
    """For each page and section: the sha256 over its `kind:text` lines in order."""
    line = F.concat_ws(":", "kind", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda b: b["line"])
    return blocks.groupBy("page_id", "section_path").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


def section_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sections that were added, removed or changed between two digests of pages."""
    joined = current.withColumnRenamed("digest", "now").join(previous.withColumnRenamed("digest", "before"), ["page_id", "section_path"], "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return joined.withColumn("status", status).where("status IS NOT NULL").select("page_id", "section_path", "status")


MODEL = "entity_kind string, id string, name string, label string, type string, ord int, phase_id string, question string"


def model_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a model dump (JSON lines or an array), with nulls as empty strings."""
    rows = spark.read.schema(MODEL).option("multiLine", True).json(path)
    return rows.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def phases_with_questions(model: DataFrame) -> DataFrame:
    """Each phase with its questions in order; phases without questions stay."""
    questions = model.where("entity_kind = 'question'").groupBy("phase_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "question"))), lambda q: q["question"]), "|").alias("questions"), F.count("*").alias("n_questions"))
    return model.where("entity_kind = 'phase'").select(F.col("id").alias("phase_id"), "name", "ord").join(questions, "phase_id", "left").fillna({"questions": "", "n_questions": 0})


def label_summary(model: DataFrame, column: str = "label", most: int = 40) -> DataFrame:
    """How often each label (or type) occurs: the most frequent first."""
    return model.where(F.col(column) != "").select(F.explode(F.split(column, ",")).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)
