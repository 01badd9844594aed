import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from klarspan.llm import common as C
from klarspan.llm.components import connected
from klarspan.llm.simhash import keep_one, signature, simhash_dedup
from klarspan.llm.substring_dedup import substring_dedup
from klarspan.llm.suffix_dedup import deep_shallow, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).withColumn("block", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)


@pytest.mark.parametrize("length", [1, 5, 35])
def test_substring_against_brute_force(docs, rows, length):
    got = substring_dedup(docs, length, keep_text=True).collect()
    assert brute.plain((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.plain(brute.substring(rows, length))
    for r in got:
        assert brute.hexed(r.kept_text.encode()) == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("options", [{}, {"hot_slices": 1}, {"block_bytes": 5000}, {"hot_slices": 0, "block_bytes": 3000}])
def test_suffix_against_brute_force(docs, rows, options):
    for length in (60, 400, 403):
        got = suffix_dedup(docs, length, keep_text=True, **options).collect()
        assert brute.plain((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute.plain(brute.suffix(rows, length))


@pytest.mark.parametrize("options", [{}, {"hot_slices": 1, "block_bytes": 5000}, {"hot_slices": 0}])
@pytest.mark.parametrize("length, passage", [(400, 256), (403, 60), (400, 400)])
def test_suffix_passages_against_brute_force(docs, rows, options, length, passage):
    got = suffix_dedup(docs, length, passage=passage, keep_text=True, **options).collect()
    assert brute.plain((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute.plain(brute.suffix(rows, length))
    assert brute.plain((r.doc_id, r.n_repeated, len(r.repeated)) for r in got) == brute.plain((i, n, runs) for i, _, n, runs, _ in brute.suffix(rows, passage))


def test_query_tells_short_passages(spark, tmp_path):
    """A passage of 55 words and under 400 bytes that stands in two documents is told, and not removed."""
    rng = np.random.default_rng(6)
    line = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    passage = line(55)
    assert 256 <= len(passage) < 390
    rows = [(1, f"{line(80)} {passage} {line(70)}"), (2, f"{line(20)}\t{passage}\t{line(90)}"), (3, line(200)), (4, passage[:200]), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_repeated) for r in entry.queries()["op6_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, len(passage)), 2: (0, len(passage)), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_deep_shallow_against_dictionary():
    rng = np.random.default_rng(4)
    data = np.concatenate([np.tile(rng.integers(97, 99, 50), 30), rng.integers(97, 99, 500)]).astype(np.uint8)
    at = np.arange(len(data) - 40)
    group = at % 3
    weight = np.where(at % 401 == 0, 2, 1)
    seen = {}
    for i in at:
        key = (group[i], data[i : i + 37].tobytes())
        seen[key] = seen.get(key, 0) + weight[i]
    want = [seen[group[i], data[i : i + 37].tobytes()] > 1 for i in at]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for shallow in (0, 8, 16):
        assert deep_shallow(padded, at, group, weight, 37, shallow).tolist() == want


@pytest.mark.parametrize("options", [{}, {"first_bits": 8, "most_rows": 3}, {"first_bits": 16, "most_rows": 1}])
def test_simhash_against_brute_force(docs, rows, options):
    got = simhash_dedup(docs, **options).collect()
    assert brute.plain((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute.plain(brute.simhash(rows))


def test_simhash_keeps_chains(spark):
    """Fingerprints in a chain of small steps are one component."""
    from klarspan.llm.simhash import ball_links

    base = 0x1234_5678_9ABC_DEF0
    steps = [base]
    for i in range(12):
        steps.append(steps[-1] ^ (0b1111 << (4 * i)))
    far = [base ^ (0b11111 << 40) ^ (1 << 60), 0x0FFF_FFFF_0000_0000]
    prints = np.array(steps + far, np.uint64).view(np.int64).tolist()
    links = ball_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4)
    roots = {r.node: r.root for r in connected(links).collect()}
    assert len({roots[p] for p in prints[:13]}) == 1
    assert len(roots) in (13, 14)


def test_keep_one(spark):
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(3000)]
    text = [words[i] for i in rng.integers(0, 3000, 400)]
    near, far = list(text), list(text)
    for i in rng.choice(400, 6, replace=False):
        near[i] = "changed"
    for i in rng.choice(400, 60, replace=False):
        far[i] = "other"
    rows = [(5, " ".join(text)), (3, " ".join(near)), (9, " ".join(far)), (7, " ".join(text)), (7, " ".join(text)), (None, " ".join(text)), (11, None), (12, ""), (13, "short one"), (None, "alone without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(0)).withColumn("first", F.lit("x"))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert brute.plain((r.doc_id,) for r in kept.collect()) == brute.plain([(3,), (9,), (11,), (13,), (None,)])
    assert (signature(b"a b") == signature(b"A  b")).all()


def test_components_against_search(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = C.components(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), 200)
    for a, b in pairs:
        if a != b:
            assert got[a] == got[b]
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(int(label[node]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({label[n] for n in got})


def test_empty_tables(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    assert substring_dedup(none).count() == suffix_dedup(none).count() == simhash_dedup(none).count() == keep_one(none).count() == 0
