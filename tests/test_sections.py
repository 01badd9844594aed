"""Page trees, review sections, claim metadata and text segments against brute force and hand-made cases."""

import random
import re

from klarspan.operators import graph, metadata, retrieval, sections

CODE = re.compile(r"(?m)^(class\s+\w+|async\s+def\s+\w+|def\s+\w+|interface\s+\w+|function\s+\w+|const\s+\w+\s*=)")
HEADING = re.compile(r"(?m)^(#{1,6}\s+.+)$")


def review_parts(kind, title, text, least):
    text = (text or "").strip()
    found = list(CODE.finditer(text)) if kind == "github_file" else []
    if found:
        ends = [m.start() for m in found[1:]] + [len(text)]
        return [(m.group(1), text[m.start() : e].strip()) for m, e in zip(found, ends)]
    found = list(HEADING.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    parts = [(m.group(1).lstrip("#").strip(), text[m.end() : e].strip()) for m, e in zip(found, ends)]
    parts = [(h, b) for h, b in parts if b]
    if parts:
        return parts
    out, held = [], []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if p:
            held.append(p)
            if sum(map(len, held)) >= least:
                out, held = [*out, (title, "\n\n".join(held))], []
    return out + ([(title, "\n\n".join(held))] if held else [])


def test_review_parts(spark):
    rng = random.Random(3)
    bits = ["some words here", "def read_it(x):", "class Reader", "## Part one", "# Top", "", "", "more text with words", "    indented", "const a = 1"]
    docs = [(i, rng.choice(["github_file", "local_doc"]), f"T{i}", "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, "local_doc", "N", None)]
    got = {}
    for r in sections.review_parts(spark.createDataFrame(docs, "doc_id long, source_type string, title string, text string"), 60).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.heading, r.body))
    squeeze = lambda b: re.sub(r"\s+", " ", b).strip()
    for i, kind, title, text in docs:
        want = [(h, squeeze(b)) for h, b in review_parts(kind, title, text, 60)]
        assert [(h, squeeze(b)) for _, h, b in sorted(got.get(i, []))] == [x for x in want if x[1]], (kind, text)


def test_depths_of_chains_cycles_and_missing_parents(spark):
    rows = [(0, None), *((i, i - 1) for i in range(1, 40)), (100, 101), (101, 102), (102, 100), (200, 999), (201, 200), (300, 300)]
    parent = dict(rows)

    def depth(n):
        level = 0
        while parent.get(n) is not None and level <= 20:
            n, level = parent[n], level + 1
        return level

    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {n: depth(n) for n, _ in rows}


def test_depths_of_many_pages(spark):
    tree = spark.range(400_000).selectExpr("id AS node", "CASE WHEN id > 0 THEN id DIV 5 END AS parent")
    found = graph.depths(tree)
    assert found.count() == 400_000 and found.agg({"depth": "max"}).first()[0] == 9


def test_claim_metadata_cases(spark):
    rows = [
        (1, "Thing.policy", "approval_policy", "no approval needed", "x", "Guardrail notes", "docs/a.md", "local_doc", "S"),
        (2, "Thing", "phase_count", "[a]: 7 phases", "y", "As_is", "wiki", "confluence_page", "S"),
        (3, "Thing.write_path", "implemented_write", "Value: save it now", "legacy code", "t", "src/a.py", "github_file", "S"),
        (4, "Thing.x", "documented_read", "v", "only a fallback", "Target", "b", "local_doc", "S"),
    ]
    docs = spark.createDataFrame(rows, "n int, subject_key string, predicate string, normalized_value string, matched_text string, title string, path_hint string, source_type string, section_path string")
    got = {r.n: r for r in metadata.claim_metadata(docs).collect()}
    assert (got[1].operator, got[1].governance_level, got[1].derived_authority, got[1].value_kind, got[1].property) == ("forbids", "governed", "governed", "constraint", "policy")
    assert (got[2].operator, got[2].focus_value, got[2].temporal_status, got[2].derived_authority, got[2].property) == ("count_equals", "7 phases", "historical", "historical", "phase_count")
    assert (got[3].focus_value, got[3].derived_status, got[3].derived_authority, got[3].path_role) == ("Value: save it now"[7:], "deprecated", "implementation", "legacy")
    assert (got[4].path_role, got[4].governance_level, got[4].temporal_status, got[4].value_constraint) == ("fallback", "ssot", "target", "v")


def test_segments(spark):
    rng = random.Random(9)
    bits = ["## Heading here", "", "word " * 30, "short", "other words follow " * 9]
    docs = [(i, "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(80)]

    def segments(text):
        done, buffer = [], ""
        flushed = lambda: [*done, buffer.strip(" ")] if len(buffer.strip(" ")) >= 16 else done
        for line in text.split("\n"):
            if re.match("#{1,6} ", line):
                done, buffer = flushed(), line
            elif not line.strip(" ") and len(buffer) >= 700:
                done, buffer = flushed(), ""
            else:
                buffer = line if buffer == "" else f"{buffer}\n{line}"
        return flushed()

    got = {}
    for r in retrieval.segments(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.content))
    for i, text in docs:
        assert [c for _, c in sorted(got.get(i, []))] == segments(text)
