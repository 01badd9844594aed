"""Near-dedup by five-word shingles and a similarity of 0.8 against brute force."""

import numpy as np

from klarspan.llm import common as C
from klarspan.llm import simhash as S
from klarspan.llm.simhash import keep_one


def survivors(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {root(i) for i in range(len(texts))}


def check(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == survivors(texts)


def test_dense_group_of_unlike_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for n in range(400):
        own = list(base)
        for k, at in enumerate(rng.choice(100, int(rng.integers(1, 6)), replace=False)):
            own[at] = f"n{n}k{k}"
        texts.append(" ".join(own))
    check(spark, texts)


def test_repeated_shingles_count_once(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    line = words("line", 14)
    texts = [" ".join(words("a", 150) + line * k) for k in (1, 20)]  # the same line once and many times
    texts += [" ".join(words(f"own{n}x", 100) + line * 40) for n in range(12)]  # unlike texts that repeat one line
    check(spark, texts)


def test_short_copies(spark):
    rng = np.random.default_rng(7)
    texts = []
    for n in range(150):
        size = (8, 10, 16)[n % 3]  # 4, 6 and 12 shingles
        base = [f"s{n}w{i}" for i in range(size)]
        texts += [" ".join(base), " ".join([*base, *(f"t{n}w{i}" for i in range((1, 1, 3)[n % 3]))])]
    check(spark, [texts[i] for i in rng.permutation(len(texts))])


def test_chains_and_base_with_remote_copies(spark):
    """A chain whose ends are unlike, and copies that are like their base but hardly like one another."""
    rng = np.random.default_rng(11)
    own = [f"c{i}" for i in range(120)]
    texts = []
    for n in range(60):
        own = list(own)
        own[int(rng.integers(0, 120))] = f"n{n}"
        texts.append(" ".join(own))
    base = [f"b{i}" for i in range(200)]
    texts.append(" ".join(base))
    for n in range(200):
        own = list(base)
        for k, at in enumerate(rng.choice(200, 4, replace=False)):
            own[at] = f"m{n}k{k}"
        texts.append(" ".join(own))
    check(spark, texts)


def test_clashing_columns_nulls_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (None, "a b c d e f g", "z"), (None, None, "n"), (7, "", "e"), (8, "p q r s t u", "k")]
    docs = spark.createDataFrame([(*r, 5, r[1], "o") for r in rows], "doc_id long, text string, simhash_md5 string, node int, row string, own string")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.simhash_md5, r.node, r.row, r.own) for r in got.collect()) == [(1, "a b c d e f g", "x", 5, "a b c d e f g", "o"), (7, "", "e", 5, "", "o"), (8, "p q r s t u", "k", 5, "p q r s t u", "o")]


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (blocks.apply(i).toString() for i in range(blocks.size())) if b.startswith("shuffle_")}


def test_a_written_table_releases_its_shuffle(spark):
    before = _shuffle_files(spark)
    table = C.written(spark.range(1000).repartition(3, "id"), "released")
    assert _shuffle_files(spark) <= before
    assert table.count() == 1000 and spark.conf.get(C.RELEASED) == "false"


def test_more_keys_than_a_broadcast_takes(spark, monkeypatch):
    """Only rows that may match enter the shuffle, and no row is lost or gained."""
    docs = spark.range(4000).selectExpr("id", "md5(cast(id as string)) AS own")
    keys = docs.where("id % 40 = 0").select("own")
    want = {how: {r.id for r in docs.join(keys, "own", how).collect()} for how in ("inner", "left_semi", "left_anti")}
    monkeypatch.setattr(S, "MOST_KEYS", 5)
    for how, ids in want.items():
        got = S._by_own(docs, keys, how)
        assert set(got.columns) == set(docs.columns)
        assert sorted(r.id for r in got.collect()) == sorted(ids)
    assert 100 <= S._may_match(docs, keys, 100).where("_may").count() <= 100 + 3900 // 8


def test_tables_in_rounds(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + f" x{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id for r in S.keep_one(docs).collect()}
    assert want == set(range(0, 30, 3))
    monkeypatch.setattr(S, "MOST_TOGETHER", 30)
    monkeypatch.setattr(S, "MOST_KEYS", 5)
    assert {r.doc_id for r in S.keep_one(docs).collect()} == want
    dealt = []
    ball_links = S.ball_links
    monkeypatch.setattr(S, "ball_links", lambda prints, *a: dealt.append(prints.count()) or ball_links(prints, *a))
    S.keep_one(docs).count()
    assert len(dealt) > 1 and sum(dealt) > max(dealt)


def test_sketches_refuse_unlike_sets_only():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (1.0, 0.95, 0.85):
            b = np.unique(np.concatenate([a[: max(1, int(n * share))], rng.integers(0, 1 << 63, n // 40).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                assert S.may_be_similar(S.sketch(a), S.sketch(b), len(a) + len(b), 0.8)
    long = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (4000, 4600)]
    assert not S.may_be_similar(*map(S.sketch, long), sum(map(len, long)), 0.8)
