"""Dialogs replayed step by step, overviews by hand, and paths matched as a greedy loop matches them."""

import random

from klarspan.operators import context as X
from klarspan.operators import decisions as D
from klarspan.operators import packages as P
from klarspan.operators import pages as G
from klarspan.operators import relations as R


def test_truths_are_replayed(spark):
    rng = random.Random(1)
    steps = [(i, i % 5, rng.choice(["confirm", "supersede", "answer"]), rng.choice(["a", "b", "c", None]), str(i)) for i in range(60)]
    steps += [(100, 1, "supersede", "new", "x"), (101, 1, "confirm", "new", "y"), (102, 1, "confirm", "new", "z")]
    held, want, made = {"a"}, {}, {}
    for ord_, _, kind, key, _ in steps:
        if kind == "answer" or key is None:
            continue
        want[ord_] = ("conflict" if key in held else "created") if kind == "confirm" else ("superseded" if key in held else "rejected")
        if want[ord_] in ("created", "superseded"):
            held.add(key)
            made[key] = ord_
    truths = spark.createDataFrame([("a", "v", "active"), ("b", "v", "superseded"), ("a", "w", "active")], "canonical_key string, normalized_value string, truth_status string")
    got = {r.ord: r for r in D.dialog_truths(truths, spark.createDataFrame(steps, "ord long, thread_id long, kind string, canonical_key string, value string")).collect()}
    assert {o: r.outcome for o, r in got.items()} == want
    assert {r.canonical_key: o for o, r in got.items() if r.truth_status == "active"} == made


def test_captures(spark):
    rows = [(1, 1, "capture", "x"), (1, 2, "answer", "first"), (1, 3, "answer", " "), (1, 4, "capture", None), (1, 5, "capture", " own "), (2, 6, "capture", ""), (None, 7, "capture", "y")]
    got = D.captured_indications(spark.createDataFrame(rows, "thread_id long, ord long, kind string, content string")).collect()
    assert {(r.ord, r.value, r.confidence) for r in got} == {(1, "x", 0.8), (4, "first", 0.8), (5, "own", 0.8), (7, "y", 0.8)}


def test_registry_summary(spark):
    rows = [("f1", 1, "open", "new"), ("f1", 2, "resolved", "reopened"), ("f2", 2, "open", None)]
    entries = spark.createDataFrame(rows, "fact_key string, run int, status string, mode string")
    got = {(r.section, r.key): r.n for r in P.registry_summary(entries, 1).collect()}
    assert got == {("total", "entries"): 3, ("total", "facts"): 2, ("total", "recurring"): 1, ("total", "reopened"): 1, ("status", "resolved"): 1, ("status", "open"): 1, ("latest", "f1"): 2}
    assert {r.n for r in P.registry_summary(entries.limit(0)).collect()} == {0}


def test_matched_paths_are_greedy(spark):
    rng = random.Random(2)
    rows = [(s, side, [rng.choice("ab") for _ in range(rng.randrange(4))]) for s in ("s", "t") for side in ("documented", "implemented") for _ in range(7)]
    ends = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = []
    for s in ("s", "t"):
        left, right = ([p for t, side, p in rows if (t, side) == (s, name)] for name in ("documented", "implemented"))
        rank = lambda p: (-ends(left[p[0]], right[p[1]]) - ends(left[p[0]][::-1], right[p[1]][::-1]), len(set(left[p[0]]) ^ set(right[p[1]])), ">".join(left[p[0]]), ">".join(right[p[1]]))  # noqa: B023, E731
        used = set()
        for i, j in sorted(((i, j) for i in range(7) for j in range(7)), key=rank):
            if not used & {("l", i), ("r", j)}:
                used |= {("l", i), ("r", j)}
                want.append((s, *rank((i, j))[2:], -rank((i, j))[0]))
    got = R.matched_paths(spark.createDataFrame(rows, "subject_key string, side string, path array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_overviews(spark):
    code = "class A:\n    @api.router.post(\"/x\")\n    def b(self): pass\n    def _c(self): pass\nLIMIT = MY_KEY + MY_KEY\ndef free(): pass\n"
    files = spark.createDataFrame([("src/a.py", code), ("src/a.py", code), ("top.py", None), ("src/x/bad.py", "def ("), (None, "")], "source_id string, text string")
    assert {(r.section, r.place, r.line) for r in X.repository_overview(files).collect()} == {("folder", 1, "src/ (2 files)"), ("folder", 2, "src/x/ (1 files)"), ("service", 1, "A (src/a.py): b"), ("route", 1, "POST /x"), ("setting", 1, "MY_KEY")}
    assert X.repository_overview(files.limit(0)).count() == 0
    pages = spark.createDataFrame([(i, "s" if i < 30 else None, None if i == 3 else f"t{i}", "x\n# Head\n" if i == 2 else None) for i in range(33)], "page_id long, space string, title string, text string")
    got = {(r.space, r.place): (r.n_pages, r.line) for r in X.wiki_map(pages).collect()}
    assert len(got) == 28 and got["s", 3] == (30, "t2: Head") and got["s", 4] == (30, "3") and got["default", 1] == (3, "t30")


def test_scores_of_pages(spark):
    pages = spark.createDataFrame([(1, None, "User guide"), (2, 1, "User guide"), (3, None, None), (4, None, "x")], "node long, parent long, title string")
    none = spark.createDataFrame([], "n int")
    got = G.scores(pages, G.page_issues(pages), pages.limit(3)).first()
    assert (got.pages, got.subject, got.unclear, got.orphans, got.coverage, got.cross_references) == (4, 2, 2, 2, 50, 15)  # a page without a title is unclear
    assert (got.structure, got.readability) == (100 - 2 * 15 - 2 * 3, 95)
    empty = G.scores(pages.limit(0), G.page_issues(pages.limit(0)), none).first()
    assert (empty.pages, empty.coverage, empty.issues, empty.avg_depth, empty.structure, empty.cross_references) == (0, 0, 0, 0.0, 100, 0)


def test_conflicts_come_first(spark):
    rows = [(1, "architecture_observation", "critical"), (2, "implementation_drift", "high"), (3, "contradiction", "low")]
    findings = spark.createDataFrame([(o, "b", s, c, False, "k", "t") for o, c, s in rows], "finding_ord int, bucket string, severity string, category string, delta boolean, object_key string, title string")
    assert [r.finding_ord for r in P.ranked(findings).orderBy("place").collect()] == [3, 2, 1]
    assert [r.finding_ord for r in P.top_findings(findings, 2).collect()] == [3, 2]
