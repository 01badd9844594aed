"""The pipeline's stages against brute force on a small table."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def stage(spark):
    return {name: (lambda docs, sf_dir, f=f: f(spark, docs, sf_dir)) for name, f in P.STAGES}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_language_keeps_all_with_letters(stage, documents, sf_dir, spark):
    odd = spark.createDataFrame([(-1, None, "en", "x", 0), (-2, "", "en", "x", 0), (-3, "12 !?", "en", "x", 5), (-4, "é", "fr", "x", 1)], documents.schema)
    kept = {r.doc_id for r in stage["language_id"](documents.union(odd), sf_dir).collect()}
    assert kept == {r.doc_id for r in documents.collect()} | {-4}


def test_near_dedup_keeps_one_of_each_group(stage, documents, sf_dir):
    rows = documents.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {r.doc_id for r in stage["near_dedup"](documents, sf_dir).collect()} == {root(i) for i in ids}


def test_decontamination_drops_hit_documents(stage, documents, sf_dir, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in documents.collect()]
    clean = {r[0] for r in brute.windows(rows, items) if not r[-1]}
    got = [r.doc_id for r in stage["decontamination"](documents, sf_dir).collect()]
    assert sorted(got) == sorted(clean) and len(got) < len(rows)


def test_redaction_replaces_every_base_span(stage, documents, sf_dir):
    before = {r.doc_id: r.text for r in documents.collect()}
    changed = 0
    for r in stage["redaction"](documents, sf_dir).collect():
        text, spans = before[r.doc_id], brute.base_spans(before[r.doc_id])
        if not spans:
            assert r.text == text or any(t in r.text for t in ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>"))
            continue
        changed += 1
        assert not [s for s in brute.base_spans(r.text) if s[0] in ("email", "phone")] and r.n_chars == len(r.text)
        outside = text[: min(a for _, a, _ in spans)]
        assert r.text.startswith(outside) or "<" in r.text[: len(outside) + 8]
    assert changed > 0


def test_mixture_counts_follow_the_weights(stage, documents, sf_dir):
    mixed = stage["mixture"](documents, sf_dir)
    draws = mixed.groupBy("doc_id").agg(F.max("mix_copy").alias("top"), F.count("*").alias("n")).collect()
    assert all(r.top == r.n for r in draws)
    assert mixed.columns == [*documents.columns, "mix_copy"]
    assert 0.7 < mixed.count() / documents.count() < 1.3
