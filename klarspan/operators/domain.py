"""Domain claims from lines of text: a rule engine whose rules, entities and states are the user's data.

A rule looks at one line with its context. It names a subject and a predicate, and takes its value from the first of its
cases that the line fits, or from the line itself. A rule that is made for each entity, or for each entity and state,
gives their product over the line; a rule with a capture gives one claim for each match. Lines come from documents (with
headings, tables), diagrams (with partitions, notes and legends), configuration (with sections) and code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from klarspan.operators.extraction import sectioned_lines, stored_value
from klarspan.operators.metadata import DOMAIN_NEGATION, domain_metadata

# Words of a table row that make it a header.
HEADER_WORDS = ("status", "state", "start", "initial", "entity", "artefakt", "object")
ARROW = r"\s*(?:->|→)\s*"


@dataclass(frozen=True)
class Rule:
    """``each`` says what a claim is made for: the line, its entities (or "general" if it names none), its entities and
    states, or the matches of ``where`` (whose groups ``entity`` and ``value`` come first and second). ``{entity}`` in the
    subject is replaced. Without cases the value is the state, or the match's second group. A case (pattern, value) of an
    empty pattern always fits; a line that fits no case gives nothing."""

    family: str
    subject: str
    predicate: str
    where: str = ""
    each: str = "line"
    cases: Sequence[tuple[str, str]] = ()
    unless: str = ""


@dataclass(frozen=True)
class Vocabulary:
    """Entities (as written), states (upper case) and the path that evidence takes through entities: its first entity is
    left out of the active path, ``centre`` must be on it."""

    entities: Sequence[str]
    states: Sequence[str]
    origin: str = ""
    centre: str = ""
    rules: Sequence[Rule] = field(default_factory=tuple)

    @property
    def entity_pattern(self) -> str:
        return r"\b(" + "|".join(map(re.escape, self.entities)) + r")\b"

    @property
    def state_pattern(self) -> str:
        return r"(?i)\b(" + "|".join(map(re.escape, self.states)) + r")\b"


def families(vocabulary: Vocabulary, *, decision: str, denial: str = DOMAIN_NEGATION, hierarchy: Sequence[tuple[str, str]] = (), scope: Sequence[tuple[str, str]] = (), chain: Sequence[tuple[str, str]] = (), verbs: str = "is|must|shall|will|may|can", start: str = "starts?|begins?|initial") -> tuple[Rule, ...]:
    """The usual families over a vocabulary: what an entity is, its states, whether a decision is taken for it, how runs are
    layered, how phases are scoped, the kind of evidence chain, and the state it begins with. ``hierarchy``, ``scope`` and
    ``chain`` are cases; a rule without cases is left out."""
    name = "|".join(map(re.escape, vocabulary.entities))
    state = "|".join(map(re.escape, vocabulary.states))
    rules = [
        Rule("role", "{entity}.role", "entity_role_assertion", rf"(?i)\b({name})\b\s+(?:{verbs})\s+([^.;]{{5,120}})", "match"),
        Rule("status", "{entity}.status_canon", "defined_status", each="entity_state"),
        Rule("decision", "{entity}.decision", "decision", decision, "entity", ((denial, "excluded"), ("", "included"))),
        Rule("initial", "{entity}.initial_state", "initial_status", rf"(?i)\b({name})\b.*?(?:{start})\s+(?:as|with|in)?\s*\b({state})\b", "first"),
    ]
    for family, subject, predicate, cases in (("hierarchy", "Run.model", "run_hierarchy", hierarchy), ("scope", "Phase.scope_distinction", "phase_scope_type", scope), ("chain", "EvidenceChain.direction", "evidence_chain_type", chain)):
        if cases:
            rules.append(Rule(family, subject, predicate, cases=tuple(cases)))
    return tuple(rules)


def _value(line: Column, rule: Rule, otherwise: Column) -> Column:
    if not rule.cases:
        return otherwise
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rule.cases):
        out = F.lit(value) if not pattern else F.when(line.rlike(pattern), value).otherwise(out)
    return out


def _claims(line: Column, rule: Rule, v: Vocabulary) -> Column:
    """An array of (family, subject_key, predicate, value), some of them null."""
    entities = F.array_distinct(F.regexp_extract_all(line, F.lit(v.entity_pattern), F.lit(1)))
    states = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(v.state_pattern), F.lit(1)), lambda s: F.upper(s)))

    def claim(entity: Column, value: Column) -> Column:
        subject = F.replace(F.lit(rule.subject), F.lit("{entity}"), entity)
        return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(rule.family).alias("family"), subject.alias("subject_key"), F.lit(rule.predicate).alias("predicate"), F.left(value, F.lit(200)).alias("value")))

    if rule.each == "entity":
        found = F.transform(F.when(F.size(entities) > 0, entities).otherwise(F.array(F.lit("general"))), lambda e: claim(e, _value(line, rule, e)))
    elif rule.each == "entity_state":
        found = F.flatten(F.transform(entities, lambda e: F.transform(states, lambda s: claim(e, _value(line, rule, s)))))
    elif rule.each == "match":
        matches = F.regexp_extract_all(line, F.lit(rule.where), F.lit(0))
        found = F.transform(matches, lambda m: claim(F.regexp_extract(m, rule.where, 1), _value(line, rule, F.trim(F.regexp_extract(m, rule.where, 2)))))
    elif rule.each == "first":
        found = F.array(claim(F.regexp_extract(line, rule.where, 1), _value(line, rule, F.upper(F.regexp_extract(line, rule.where, 2)))))
    else:
        found = F.array(claim(F.lit(""), _value(line, rule, F.lit(None).cast("string"))))
    when = [line.rlike(rule.where)] if rule.where else []
    when += [~line.rlike(rule.unless)] if rule.unless else []
    for test in when:
        found = F.when(test, found)
    return found


def arrow_path(line: Column, v: Vocabulary) -> Column:
    """The entities of a path written with arrows: the first that each part names."""
    parts = F.when(line.rlike("->|→"), F.split(line, ARROW))
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, v.entity_pattern, 1)), lambda e: e != "")


def path_claims(line: Column, v: Vocabulary, prefix: str = "documented") -> Column:
    """Claims of a path: the active one from the entity before the centre on, and the full one from the origin on."""
    path = arrow_path(line, v)
    own = F.when(F.get(path, F.lit(0)) == v.origin, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    at = F.array_position(own, v.centre)
    active = F.when(at > 0, F.slice(own, F.greatest(at - 1, F.lit(1)).cast("int"), F.size(own)))
    full = F.when((F.size(path) >= 3) & (F.get(path, F.lit(0)) == v.origin) & (F.array_position(path, v.centre) >= 3), path)
    named = lambda p, subject, least: F.when(F.size(p) >= least, F.struct(F.lit("path").alias("family"), F.lit(f"EvidenceChain.{subject}").alias("subject_key"), F.lit(f"{prefix}_evidence_chain_{'path' if subject == 'active_path' else subject}").alias("predicate"), F.array_join(p, " -> ").alias("value")))
    return F.array(named(active, "active_path", 2), named(full, "full_path", 3))


def rule_claims(lines: DataFrame, v: Vocabulary, prefix: str = "documented") -> DataFrame:
    """Claims (doc_id, line_no, section_path, family, subject_key, predicate, value) of lines (doc_id, line_no, line,
    section_path), by all rules at once: a line is read once, whatever the number of rules. With an origin or a centre,
    paths are claimed too."""
    arrays = [F.coalesce(_claims(F.col("line"), r, v), F.array()) for r in v.rules]
    if v.centre:
        arrays.append(path_claims(F.col("line"), v, prefix))
    rows = F.array_distinct(F.array_compact(F.concat(*arrays)))
    return lines.select("doc_id", "line_no", "line", "section_path", F.explode(rows).alias("claim")).select("doc_id", "line_no", "section_path", "claim.*", "line")


# lines with their context


def table_lines(lines: DataFrame) -> DataFrame:
    """Rows of pipe tables (doc_id, line_no, line, section_path, headers, cells) with the header that is carried down to
    them: the last header row above, in the same section and without a line between that is no table row."""
    cells = F.filter(F.transform(F.split(F.regexp_extract("line", r"^\|(.+)\|$", 1), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines.where(F.col("line").rlike(r"^\|.+\|$")).withColumn("cells", cells)
    header = F.exists("cells", lambda c: F.lower(c).rlike("|".join(HEADER_WORDS)))
    # rows of one table stand on lines that follow each other
    order = Window.partitionBy("doc_id").orderBy("line_no")
    new = (F.col("line_no") - F.lag("line_no").over(order) > 1) | (F.col("section_path") != F.lag("section_path").over(order))
    rows = rows.withColumn("is_header", header).withColumn("table", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    within = Window.partitionBy("doc_id", "table").orderBy("line_no")
    rows = rows.withColumn("headers", F.last(F.when(F.col("is_header"), F.col("cells")), ignorenulls=True).over(within))
    return rows.where("NOT is_header").select("doc_id", "line_no", "line", "section_path", "headers", "cells")


def table_claims(lines: DataFrame, v: Vocabulary) -> DataFrame:
    """Claims of table rows: the states that a row gives each entity it names, and the one of its initial column."""
    rows = table_lines(lines)
    text = F.array_join("cells", " | ")
    entities = F.array_distinct(F.regexp_extract_all(text, F.lit(v.entity_pattern), F.lit(1)))
    states = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(v.state_pattern), F.lit(1)), lambda s: F.upper(s)))
    pairs = F.arrays_zip(F.slice("headers", 1, F.size("cells")).alias("h"), F.col("cells").alias("c"))
    first = F.get(F.filter(pairs, lambda x: F.lower(x["h"]).rlike("initial|start") & x["c"].rlike(v.state_pattern)), F.lit(0))["c"]
    initial = F.upper(F.regexp_extract(first, v.state_pattern, 1))
    made = lambda family, subject, predicate, e, value: F.when(value != "", F.struct(F.lit(family).alias("family"), F.concat(e, F.lit(subject)).alias("subject_key"), F.lit(predicate).alias("predicate"), value.alias("value")))
    claims = F.transform(entities, lambda e: F.concat(F.array(made("initial", ".initial_state", "initial_status", e, initial)), F.transform(states, lambda s: made("status", ".status_canon", "defined_status", e, s))))
    return rows.select("doc_id", "line_no", "line", "section_path", F.explode(F.array_compact(F.flatten(claims))).alias("claim")).select("doc_id", "line_no", "section_path", "claim.*", "line")


def diagram_lines(docs: DataFrame) -> DataFrame:
    """Lines of diagrams (doc_id, title, text) with the context of their block: (doc_id, line_no, line, section_path,
    partition, block, previous). The text of a note or legend is preceded by its partition and heading, and its section
    names the block; ``previous`` is the last line above that is not empty. Comments and directives are left out."""
    rows = docs.select("doc_id", "title", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "raw"))
    line = F.trim("raw")
    rows = rows.select("doc_id", "title", (F.col("at") + 1).alias("line_no"), line.alias("line")).where((line != "") & ~line.rlike("^['@]"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.col("line")
    partition = F.nullif(F.regexp_extract("line", r'(?i)^partition\s+"([^"]+)"', 1), F.lit(""))
    note = r"(?i)^(note|legend)\b([^:]*)(:\s*(.*))?$"
    opens, ends = text.rlike(note) & ~text.rlike(r"(?i)^legend\b[^:\s]"), text.rlike(r"(?i)^end\s*(note|legend)\b")
    inline = F.trim(F.regexp_extract("line", note, 4))
    rows = rows.withColumn("is_partition", partition.isNotNull()).withColumn("partition", F.coalesce(F.last(partition, ignorenulls=True).over(order), F.lit("")))
    heading = F.trim(F.concat_ws(" ", F.nullif(F.col("partition"), F.lit("")), F.lower(F.regexp_extract("line", note, 1)), F.nullif(F.trim(F.regexp_extract("line", note, 2)), F.lit(""))))
    # an opening line without text begins a block, its end or a note with text ends it
    change = F.when(ends | (opens & (inline != "")), F.struct(F.lit("").alias("kind"), F.lit("").alias("heading"))).when(opens, F.struct(F.lower(F.regexp_extract("line", note, 1)).alias("kind"), heading.alias("heading")))
    rows = rows.withColumn("state", F.last(change, ignorenulls=True).over(order)).withColumn("opens", opens).withColumn("ends", ends).withColumn("inline", inline).withColumn("heading", heading).withColumn("previous", F.coalesce(F.lag("line").over(order), F.lit("")))
    kept_lines = rows.where("NOT is_partition AND NOT ends AND NOT (opens AND inline = '')")
    block = F.coalesce(F.col("state.kind"), F.lit(""))
    before = F.when(F.col("opens"), F.col("heading")).otherwise(F.coalesce(F.col("state.heading"), F.lit("")))
    said = F.when(F.col("opens"), F.col("inline")).otherwise(F.col("line"))
    place = F.concat_ws(":", "title", F.col("line_no").cast("string"), F.nullif(block, F.lit("")))
    return kept_lines.select("doc_id", "line_no", F.trim(F.concat_ws(" ", F.nullif(before, F.lit("")), said)).alias("line"), place.alias("section_path"), "partition", block.alias("block"), "previous")


def hop_claims(lines: DataFrame, relation: str, left: str, right: str) -> DataFrame:
    """Lines of diagrams that name a relation while their context (partition, line before, line) names both its ends."""
    context = F.concat_ws(" ", "partition", "previous", "line")
    word = lambda w: rf"(?i)\b{re.escape(w)}\b"
    hit = F.col("line").rlike(word(relation)) & context.rlike(word(left)) & context.rlike(word(right))
    return lines.where(hit).select("doc_id", "line_no", "section_path", F.lit("hop").alias("family"), F.lit("EvidenceChain.hop").alias("subject_key"), F.lit("puml_evidence_chain_hop").alias("predicate"), F.lit(f"{left} -[:{relation}]-> {right}").alias("value"), "line")


def config_lines(docs: DataFrame) -> DataFrame:
    """Lines of configuration (doc_id, title, text), without comments, with their top-level section carried down."""
    rows = docs.select("doc_id", "title", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "raw"))
    order = Window.partitionBy("doc_id").orderBy("at")
    key = F.nullif(F.regexp_extract("raw", r"^([A-Za-z_][A-Za-z0-9_]*)\s*:", 1), F.lit(""))
    rows = rows.withColumn("section", F.last(key, ignorenulls=True).over(order)).withColumn("line", F.trim("raw"))
    return rows.where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select("doc_id", (F.col("at") + 1).alias("line_no"), "line", F.concat_ws(" > ", "title", "section").alias("section_path"), F.coalesce("section", F.lit("")).alias("section"), "raw")


def allowed_writes(lines: DataFrame, v: Vocabulary) -> DataFrame:
    """Entries of allow-lists (lines of configuration) with the entities that may be written."""
    entry = F.regexp_extract("raw", r"^\s+-\s+([A-Za-z_][A-Za-z0-9_:>\-]+)", 1)
    found = F.array_distinct(F.regexp_extract_all(entry, F.lit(v.entity_pattern), F.lit(1)))
    rows = lines.withColumn("entry", entry).select("doc_id", "line_no", "section_path", "section", "entry", "line", F.explode(found).alias("entity"))
    return rows.select("doc_id", "line_no", "section_path", F.lit("allowlist").alias("family"), F.concat("entity", F.lit(".write_contract")).alias("subject_key"), F.lit("yaml_write_allowlist_entry").alias("predicate"), F.concat("entity", F.lit(" in "), "section", F.lit(": "), "entry").alias("value"), "line")


# claims as records, and which lines a document has


def claim_records(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims as records with status, authority, operator, temporal status, confidence and fingerprint, from the line they
    stand on and their document (doc_id, source_type, title, path)."""
    rows = claims.join(docs.select("doc_id", "source_type", "title", F.col("path").alias("path_hint"), F.col("doc_id").cast("string").alias("source_id")), "doc_id")
    rows = domain_metadata(rows.withColumn("matched_text", F.col("line")))
    return rows.select(
        "doc_id", "source_type", "line_no", "section_path", "family", "subject_key", "predicate", "value", F.col("domain_status").alias("assertion_status"), F.col("domain_authority").alias("source_authority"), F.col("domain_operator").alias("operator"),
        F.when(F.col("domain_authority") == "historical", "historical").otherwise("current").alias("temporal_status"), F.lit(0.9).alias("confidence"), stored_value(F.col("line")).alias("matched_text"),
        F.concat_ws("|", F.lit("domain"), "subject_key", "predicate", "source_id", F.col("line_no").cast("string")).alias("fingerprint"),
    )


PREFIXES = {"code": "code_", "config": "yaml_", "diagram": "puml_"}


def document_kind(source_type: Column, path: Column) -> Column:
    """How a document is read: as a model, diagram, configuration, code or prose, by its source and the end of its path."""
    low = F.lower(F.coalesce(path, F.lit("")))
    by_path = F.when(low.rlike(r"\.(puml|plantuml)$"), "diagram").when(low.rlike(r"\.(ya?ml)$"), "config").when(low.rlike(r"\.py$"), "code").when(low.rlike(r"\.(md|rst|txt)$"), "prose")
    return F.when(source_type == "metamodel", "model").when(source_type.isin("confluence_page", "local_doc"), F.coalesce(F.when(by_path == "diagram", by_path), F.lit("prose"))).when(source_type == "github_file", by_path)


def domain_claims(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Records of all claims that the rules find in documents (doc_id, source_type, title, path, text), each read as its
    kind. Predicates of code, configuration and diagrams carry a prefix; what is neither of these, nor prose, gives none.
    Claims that a line's rules and its table row both give count once."""
    docs = docs.withColumn("kind", document_kind(F.col("source_type"), F.col("path")))
    of = lambda kind: docs.where(F.col("kind") == kind)
    prose = sectioned_lines(of("prose"))
    code = of("code").select("doc_id", "title", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "raw")).select("doc_id", (F.col("at") + 1).alias("line_no"), F.trim("raw").alias("line"), F.concat_ws(":", "title", (F.col("at") + 1).cast("string")).alias("section_path")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    config = config_lines(of("config"))
    every = rule_claims(prose, v).unionByName(table_claims(prose, v))
    for kind, lines in (("code", code), ("config", config.drop("section", "raw")), ("diagram", diagram_lines(of("diagram")).drop("partition", "block", "previous"))):
        own = rule_claims(lines, v, PREFIXES[kind].rstrip("_"))
        every = every.unionByName(own.withColumn("predicate", F.when(F.col("family") == "path", F.col("predicate")).otherwise(F.concat(F.lit(PREFIXES[kind]), "predicate"))))
    every = every.unionByName(allowed_writes(config.where(F.contains(F.lower("section_path"), F.lit("allow"))), v))
    once = every.dropDuplicates(["doc_id", "line_no", "subject_key", "predicate", "value"])
    return claim_records(once, docs)
