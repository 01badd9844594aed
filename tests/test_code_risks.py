"""Breaks of paths against plain lists, best-first matching against a greedy loop, risks of code by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from klarspan.operators import breaks as B
from klarspan.operators import code_risks as R
from klarspan.operators import scan

ARRAYS = "a array<string>, b array<string>"


def ends(a, b):
    same = lambda x, y: len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))))
    return same(a, b), same(a[::-1], b[::-1])


def test_modes_by_hand(spark):
    cases = {
        "aligned": ("xyz", "xyz"), "implemented_internal_gap": ("xyz", "xz"), "implemented_tail_gap": ("xyz", "xy"), "implemented_prefix_gap": ("xyz", "yz"), "implemented_full_gap": ("x", ""),
        "documented_internal_gap": ("xz", "xyz"), "documented_tail_gap": ("xy", "xyz"), "documented_prefix_gap": ("yz", "xyz"), "documented_full_gap": ("", "x"),
        "internal_substitution": ("xyz", "xwz"), "tail_substitution": ("xy", "xw"), "prefix_substitution": ("yz", "wz"), "full_substitution": ("xy", "vw"),
    }
    rows = [(mode, list(a), list(b)) for mode, (a, b) in cases.items()]
    got = spark.createDataFrame(rows, "want string, " + ARRAYS).select("want", B.divergence(F.col("a"), F.col("b"))["mode"].alias("mode")).collect()
    assert len(got) == 13 and all(r.want == r.mode for r in got)


def test_breaks_against_lists(spark):
    words = [list(w) for n in range(4) for w in itertools.product("xy", repeat=n)]
    rows = [(a, b) for a in words for b in words]
    got = {(tuple(r.a), tuple(r.b)): r.x for r in spark.createDataFrame(rows, ARRAYS).select("a", "b", B.path_break(F.col("a"), F.col("b")).alias("x")).collect()}
    for seen, want in rows:
        x, (pre, suf) = got[tuple(seen), tuple(want)], ends(seen, want)
        missing = want[pre : len(want) - suf]
        if not seen or not want or not missing:
            assert x is None
            continue
        assert (x.prefix, x.suffix, x.missing) == (pre, suf, " -> ".join(missing))
        assert x.mode == {(True, True): "internal_gap", (True, False): "tail_gap", (False, True): "prefix_gap", (False, False): "full_gap"}[pre > 0, suf > 0]
        assert x.remaining == " -> ".join(want[x["index"] :]) and x.rejoin_at == (want[len(want) - suf] if suf else None)


def test_a_missing_path_has_no_break(spark):
    rows = [(None, ["x"]), (["x"], None), (None, None)]
    assert spark.createDataFrame(rows, ARRAYS).where(B.path_break(F.col("a"), F.col("b")).isNotNull()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(g, f"l{i}", f"r{j}", rng.randrange(3)) for g in (1, 2, None) for i in range(6) for j in range(5) if rng.random() < 0.7]
    want, used = set(), set()
    for g, left, right, cost in sorted(rows, key=lambda r: (str(r[0]), r[3], r[1], r[2])):
        if (g, left) not in used and (g, right) not in used:
            used |= {(g, left), (g, right)}
            want.add((g, left, right, cost))
    got = B.matched(spark.createDataFrame(rows, "g int, l string, r string, cost int"), ["g"], "l", "r", [F.col("cost")]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_matched_breaks_take_the_nearest(spark):
    frame = lambda *paths: spark.createDataFrame([(1, p) for p in paths] * 2, "g int, path string")
    seen, want = frame("o -> a -> h", "o->b->h", "z", None), frame("o -> a -> h -> t", "o -> b -> h -> t", "o -> c -> h -> t")
    got = {(r.observed, r.expected, r.mode, r.missing) for r in B.matched_breaks(seen, want, ["g"]).collect()}
    assert got == {("o -> a -> h", "o -> a -> h -> t", "tail_gap", "t"), ("o->b->h", "o -> b -> h -> t", "tail_gap", "t")}
    assert B.matched_breaks(seen.limit(0), want, ["g"]).count() == 0


def test_whole_chains_are_no_findings(spark):
    steps = [(1, "f", "H", "FROM", "S"), (1, "f", "H", "TO", "T"), (2, "f", "H", "FROM", "S"), (3, "f", "X", "FROM", "S"), (4, "f", "H", "TO", "Y"), (5, "f", "H", "TO", "T")]
    paths = spark.createDataFrame([(2, "O -> S -> H"), (1, "O -> S -> H")], "g int, path string")
    got = {r.g: r for r in B.broken_chains(spark.createDataFrame(steps, "g int, source_id string, src string, type string, dst string"), paths, ["g"], "H", "FROM", "TO", "T", "O").collect()}
    assert set(got) == {2, 5}
    assert (got[2].break_at, got[2].missing, got[2].before, got[2].after, got[2].n_pairs) == ("H.TO", "T", "H", "T", 1)
    assert (got[5].break_at, got[5].missing, got[5].rejoin_at) == ("H.FROM", "O -> <source>", "H")


CODE = """class Flow:
    def enter(self, x):
        save_item(x)
        enqueue_job(x)
    def answer(self, x):
        manual = x
        store_row(item)
        upsert_all()
"""


def test_risks_of_code(spark):
    files = spark.createDataFrame([("inventory/a", CODE), ("inventory/b", CODE), ("other/c", CODE), ("e", ""), (None, None)], "source_id string, text string")
    claims = R.risk_claims(scan.code_events(files, {"item": "Item"}, r"\b(trace_id)\b\s*=", {"write": "store_row"}), "trace_id").cache()
    records = R.risk_records(claims, (("stock", ("inventory",), ()),), ("Item.field_propagation",))
    found = {(r.predicate, r.kind): r for r in R.code_risks(records, claims, ("stock",)).collect()}
    stock, alone, entry = found["code_eventual_consistency_risk", "stock"], found["code_eventual_consistency_risk", "generic"], found["code_field_propagation_gap", "entry_point"]
    assert len(found) == 3
    assert (stock.n_sources, stock.path_count, stock.severity, stock.break_mode, stock.missing, stock.lines) == (2, 2, "high", "async_gap", "protected_reaggregation", "L3-L4")
    assert alone.finding_key == "code_eventual_consistency_risk|other/c|TemporalConsistency.persist_then_enqueue"
    assert (entry.category, entry.severity, entry.n_sources, entry.missing_field, entry.legacy_path_gap, entry.function_name) == ("legacy_path_gap", "medium", 3, "trace_id", True, "Flow.answer")
    plain = {r.kind: r for r in R.code_risks(R.risk_records(claims), claims).where("predicate = 'code_field_propagation_gap'").collect()}
    assert set(plain) == {None} and plain[None].category == "implementation_drift"
    members = R.risk_members(records, claims, ("stock",))
    assert members.where(F.col("finding_key") == stock.finding_key).count() == 2


def test_no_claims_no_risks(spark):
    empty = spark.createDataFrame([], "source_id string, subject_key string, predicate string, value string, function_name string, first_line int, last_line int")
    assert R.code_risks(R.risk_records(empty), empty).count() == 0
