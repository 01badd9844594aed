import hashlib

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = ("op1_license_scan", "op2_top_k", "op7_decontaminate", "op8_url_filter", "op9_mix_sources", "op13_fill_in_middle")


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    text = lambda r: hashlib.md5(repr([round(v, 9) if isinstance(v, float) else v for v in r]).encode()).hexdigest()
    assert sorted(map(text, map(tuple, got.select(*columns).collect()))) == sorted(map(text, rows))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "redaction", "mixture"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        n = out.count()
        assert 0 < n <= before and (name != "redaction" or n == before)
        docs, before = out, n
    mixed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.columns == [*columns, "mix_copy"] and mixed.count() > 0
    assert all(f(spark, docs.limit(0), sf_dir).count() == 0 for _, f in P.STAGES)
