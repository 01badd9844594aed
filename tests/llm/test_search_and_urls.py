import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from klarspan.llm import topk, url_filter


def want_topk(rows, k):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in vectors if c != q)[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(found, 1)]
    return brute.plain(out)


@pytest.mark.parametrize("scale,queries", [(1.0, 4096), (1.0, 3), (1e5, 4096), (1e7, 2)])
def test_topk_against_brute_force(spark, scale, queries):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-scale, scale) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [scale] * 8), (404, [scale]), (420, []), (440, [0.0] * 12), (21, rows[40][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20, queries)
    assert brute.plain(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want_topk(rows, 20)


def test_topk_of_few(spark):
    vectors = spark.createDataFrame([(20, [1.0]), (40, [2.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 4
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(vectors, F.col("vec_id") == 7).count() == 0


def test_url_rules_and_reputation(spark):
    urls = ["http://WWW.Example.com/en/a?x", "http://example.com/en/1", "http://a.example.com/en", "http://b.com/", "http://b.com", "https://x.net/es/1#f", "http://net/fr/", "ftp://spam.org/p?q", None, "no scheme", "http://", "http://spam.org?x://y", "http://u@h.co.uk:80/p", "http://example.com.evil/en/"]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(7, 1)] * 30 + [(11, 1)] * 5 + [(13, 0)] * 30 + [(None, 1), (1, None)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.url_filter(pages, outcomes).collect()}
    assert url_filter.url_filter(pages, outcomes).count() == len(urls) + 1
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("example.com/en/", "block") and (got[2].rule, got[2].path) == ("com/", "/en")
    assert got[3].rule == "com/" and got[4].rule is None and got[4].path == ""
    assert got[5].rule == "net/es/" and got[6].rule == "net/fr/" and got[6].verdict == "block"
    assert (got[7].host, got[7].rule, got[7].verdict) == ("spam.org", None, "block")
    assert all((got[i].host, got[i].path) == ("", "") for i in (8, 9, 10))
    assert got[11].host == "spam.org" and got[11].path == "" and got[12].host == "u@h.co.uk:80"
    assert got[13].rule is None and got[13].verdict == "allow"
    assert url_filter.url_filter(pages, outcomes.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.url_filter(pages.limit(0), outcomes).count() == 0
