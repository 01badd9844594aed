import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from klarspan.llm import language, licenses, mixing, pii
from klarspan.llm.decontaminate import contamination, decontaminate


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).withColumn("words", F.lit("clash")).withColumn("row", F.lit(7))


def test_contamination_against_brute_force(spark, docs, rows):
    line = rows[30][1].split()
    items = [(1, " ".join(line[3:30])), (2, " ".join(line[5:17]).upper()), (3, "w1 w2"), (4, None), (5, "..."), (None, rows[2][1]), (2, rows[4][1]), (6, "größe")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.plain(brute.windows(rows, items))
    for most in (10**6, 0):  # broadcast and shuffled
        got = contamination(docs, bench, most_windows=most).collect()
        assert brute.plain((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(w[-1] == "False" for w in want)


def test_items_with_one_template(spark):
    """Many items, some of them repeated, share their first words; documents show different sets of them."""
    template = " ".join(f"t{i}" for i in range(12))
    items = [(i % 150, f"{template} own{i % 150} " + " ".join(f"w{i % 150}x{j}" for j in range(10))) for i in range(300)]
    rows = [(i, f"a b {template} own{i} " + " ".join(f"w{i}x{j}" for j in range(10 if i % 2 else 3))) for i in range(20)] + [(i, "a clean text") for i in range(20, 40)]
    want = brute.plain(brute.windows(rows, items))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 0):
        got = contamination(docs, bench, most_windows=most).collect()
        assert brute.plain((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_contamination_of_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).where("contaminated").count() == 0
    assert contamination(docs.limit(0), none).count() == 0
    assert decontaminate(docs, none).count() == len(rows)


TEXTS = [None, "", "mail a.b@c.de, x@y and 1.2.3.4.5.6.7.8 or 256.1.1.1", "4465758382889437 4465758382889437 then 4465 7583 8288 9437", "+1 (743) 555-3824 and +123", "é" * 9 + " a@b.c@d.e_f@g.h", "card 4111-1111-1111-1111, call (212) 555-0123", "order (212) 555-0123", "1 " * 3000, "1" * 5000, "a" * 20000 + "@b.c", "anna (at) mail (dot) com", "00255.1.1.1 +12-3 (4)5.6 7890 0", "😀 10.0.0.1 😀 x@y.zz", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"]


def test_pii_base_spans_against_brute_force(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[2]), (2, TEXTS[2])], "doc_id long, text string").withColumn("pii_base", F.lit(1))
    for r in pii.find_pii(docs).collect():
        text = TEXTS[2 if r.doc_id is None else r.doc_id]
        want = brute.base_spans(text)
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == brute.hexed(digest.encode()), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]
        every = [s for s in r.spans.split(",") if s]
        assert set(digest.split(",")) - {""} <= set(every)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_adds_and_redacts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert spans[3].count("card") == 2 or spans[3].count("card") == 3
    assert "phone:" in spans[6] and "phone" not in spans[7]
    assert "email" in spans[11]
    out = {r.doc_id: r.text for r in pii.redact(docs.withColumn("kind", F.lit(1))).collect()}
    assert out[0] is None and out[1] == ""
    assert out[2] == "mail <EMAIL>, x@y and <IP>.<IP> or 256.1.1.1" or out[2].startswith("mail <EMAIL>, x@y and <IP>")
    assert "555" not in out[4] and "+123" in out[4]


def test_pii_trees_match_their_columns(spark):
    trees, _, limits = pii.model(spark)
    assert len(limits) == 4 and all(0 < t < 1 for t in limits)
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (50, len(pii.FEATURES))).astype(float)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in pii.FEATURES))
    got = [r.s for r in frame.select(trees.column(F.struct(*pii.FEATURES)).alias("s")).collect()]
    assert np.allclose(got, trees.score(x))


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    texts = [None, "", "x", "hello\nReleased under the MIT License.\nbye", mit, "intro\n\n" + mit.replace(". ", ".\n") + "\n \nmore words here", mit.upper().replace("SOFTWARE", "PROGRAM", 1), "This is not about licences at all", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License", mit + "".join(f" word{i}" for i in range(400))]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3])], "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[i].license for i in range(10)] == [None, None, None, "MIT", "MIT", "MIT", "MIT", None, "Apache-2.0", None]
    assert got[3].dice == 1.0 and got[4].dice == 1.0 and 0.8 < got[6].dice < 1
    assert got[8].licenses == "Apache-2.0,MIT" and got[None].license == "MIT"
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_at_the_threshold(spark):
    body = [f"w{i}" for i in range(13)]  # 12 bigrams
    texts = ["Released under the MIT License by Acme", "Released under the MIT License by Acme Inc", " ".join([*body, *(f"x{i}" for i in range(6))]), " ".join(body[:9]), " ".join(body[:8])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.dice) for r in licenses.scan_licenses(docs, (*licenses.TEMPLATES, ("own", " ".join(body)))).collect()}
    assert got == {0: ("MIT", 0.8), 1: (None, None), 2: ("own", 0.8), 3: ("own", 0.8), 4: (None, None)}


def test_language(spark):
    rows = []
    samples = {"en": "the house and the water over there with thing", "de": "das schöne haus und der fluss über nicht straße", "fr": "la maison été où garçon être les élèves dans"}
    for i in range(240):
        lang = list(samples)[i % 3]
        words = samples[lang].split()
        rows.append((i, " ".join(words[(i * k) % len(words)] for k in range(1, 3 + i % 20)), lang, i))
    rows += [(500, None, "en", 1), (501, "12 34 !?", "en", 1), (502, "", "en", 1), (None, "the house", "en", 1), (503, "haus und fluss", None, 1), (503, "haus und fluss", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = language.identify(docs, landmarks=20).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[500].score == 0
    assert by[503].lang_pred == "de" and by[None].lang_pred == "en" and not by[None].held_out
    held = [(r[2], by[r[0]].lang_pred) for r in rows[:240] if by[r[0]].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.reject_unknown(docs, landmarks=20)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, f"t{i}", "a" if i % 10 else "b") for i in range(4000)] + [(None, None, None), (None, "x", None), (9, "t9", "a"), (9, "t9", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("k", F.lit(1))
    mixed = mixing.mix_sources(docs, {"b": 0.5}, seed=1)
    assert mixed.columns == [*docs.columns, "mix_copy"]
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["b"] - 2000) < 200 and abs(counts["a"] - 2000) < 200
    again = mixing.mix_sources(docs.repartition(7), {"b": 0.5}, seed=1)
    key = lambda df: brute.plain((r.doc_id, r.text, r.mix_copy) for r in df.collect())
    assert key(again) == key(mixed) != key(mixing.mix_sources(docs, {"b": 0.5}, seed=2))
    many = mixing.mix_sources(docs, {"b": 1.0}, size=60.0)
    n = many.count()
    assert abs(n - 60 * 4000) < 6000 and {r["source"] for r in many.select("source").distinct().collect()} == {"b"}
    assert mixing.mix_sources(docs.limit(0), {"b": 1.0}).count() == 0
    assert abs(mixing.mix_sources(docs, {"none": 1.0}).count() - 4000) < 300  # a weight without documents is ignored


#: Texts as people write them, none of which the examples' makers can give: what the added spans should be, by kind.
WRITTEN = [
    ("Sie erreichen Frau Lenz unter 030 1234567 oder per Fax 030/7654321.", {"phone": 2}),
    ("Appelez-nous au 06 12 34 56 78 avant midi.", {"phone": 1}),
    ("Tel.: (0221) 998 4410, Handy 0171-5558812", {"phone": 2}),
    ("From abroad dial 0049 89 4455667.", {"phone": 1}),
    ("Call me on 415-555-2671 or text (212) 555-0187!", {"phone": 2}),
    ("write to jane.doe at example dot org please", {"email": 1}),
    ("my mail is SUPPORT [AT] ACME [DOT] COM", {"email": 1}),
    ("contact: li.wei(at)uni-koeln.de", {"email": 1}),
    ("The server 2001:db8::8a2e:370:7334 did not answer, gateway fe80::1 did.", {"ip": 2}),
    ("blocked host 185[.]220[.]101[.]4 again", {"ip": 1}),
    ("paid with amex 3782 822463 10005 yesterday", {"card": 1}),
    ("He arrived on 03.04.2021 and left on 05/06/1999.", {}),
    ("The ratio was 0.123456789 and the order 00012345678.", {}),
    ("std::vector and a::b are C++; see chapter 3::4", {}),
    ("invoice 4532 1143 8765 3211 0, batch 000123456", {}),
    ("We meet at noon. Look at dot plots at home.", {}),
    ("Version 10.2.3 build 0099-12345 of item 012-34567", {}),
]


def test_pii_on_texts_as_people_write_them(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRITTEN)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    hit = extra = wanted = 0
    for i, (text, kinds) in enumerate(WRITTEN):
        base = sum((found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone))
        spans = [s.split(":")[0] for s in found[i].spans.split(",") if s]
        n = sum(min(spans.count(k), v) for k, v in kinds.items())
        wanted, hit, extra = wanted + sum(kinds.values()), hit + n, extra + len(spans) - n - (base if not kinds else 0)
    print(f"recall {hit}/{wanted}, false {extra}")
    assert hit >= 0.8 * wanted and extra <= 0.15 * hit


def test_licence_of_several_paragraphs_between_other_text(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    grant, rest = mit.split("The above copyright", 1)
    notice, disclaimer = rest.split("THE SOFTWARE IS", 1)
    code = "\n\n".join("def f%d(x): return x * %d" % (i, i) for i in range(40))
    texts = [f"{code}\n\n{grant}\n\nThe above copyright{notice}\n\n \n---\n\nTHE SOFTWARE IS{disclaimer}\n\n{code}", "Some words first. This project is licensed under the MIT License. And more words follow here", f"{code}\n\n{grant}\n\n{code}"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(3)] == ["MIT", "MIT", None] and got[0].dice > 0.95


def test_language_against_dense_ridge(spark):
    """With every text a landmark, the model is the ridge regression on all n-grams' presence, computed here with sets."""
    import random

    import numpy as np

    rng = random.Random(4)
    kinds = {"aa": "banana abba cab", "bb": "lorem dolor ipsum", "cc": "über straße öl", "dd": "zig zag zoo"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(1, 9))), k) for i, k in enumerate(sorted(kinds) * 12)]
    rows += [(900 + i, t, None) for i, t in enumerate(["", None, "123", "banana lorem", "Zig ZAG " * 4000, "straße"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, landmarks=1000)
    assert model.languages == sorted(kinds)
    gram_set = lambda t: {g[i : i + n] for g in [t.encode().lower()] for n in (1, 2, 3) for i in range(len(g) - n + 1)}
    labelled = [(gram_set(t), k) for _, t, k in rows if k]
    every = sorted(set().union(*(g for g, _ in labelled)))
    vector = lambda grams: np.array([g in grams for g in every], float) / np.sqrt(max(1, sum(g in grams for g in every)))
    x = np.hstack([np.array([vector(g) for g, _ in labelled]), np.ones((len(labelled), 1))])
    y = np.array([[2.0 * (k == name) - 1 for name in sorted(kinds)] for _, k in labelled])
    w = np.linalg.solve(x.T @ x + language.RIDGE * len(labelled) / 4 * 0.01 * np.eye(x.shape[1]), x.T @ y)  # all languages alike
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        s = np.append(vector(gram_set(t)), 1) @ w
        p = np.exp(language.STEEP * (s - s.max()))
        assert got[i].lang_pred == sorted(kinds)[int(s.argmax())] and abs(got[i].score - 1 / p.sum()) < 2e-3


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, "mail a@b.org now", "s", "p", 7, "r", 3), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, pii_text string, mix_count int, row string, mix_copy int")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, "mail <EMAIL> now", "s", "p", 7, "r", 3), rows[1]]
    mixed = mixing.mix_sources(docs, {}, size=3.0)
    assert mixed.columns == docs.columns and {(r.pii_text, r.mix_count, r.row) for r in mixed.collect()} <= {("p", 7, "r"), (None, None, None)}
    assert {r.mix_copy for r in mixed.collect()} <= set(range(1, 30))


def test_pii_of_long_texts_of_spans(spark):
    text = "call 212-555-0123 or a@b.co " * 36_000
    docs = spark.createDataFrame([(1, text), (2, "1-" * 500_000), (3, None), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(text) > 1_000_000 and found[1].n_email == 36_000 and found[1].spans.count("phone:") == 36_000
    assert found[1].base_sha256 == hashlib.sha256(",".join(f"email:{28 * i + 21}:{28 * i + 27}" for i in range(36_000)).encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[1] == "call <PHONE> or <EMAIL> " * 36_000 and out[3] is None and out[4] == ""


def test_language_stage_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"the quick brown fox number {i}", "en", "a", i) for i in range(40)] + [(90, "12 34", "en", "b", 1), (91, None, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language_told string, language_told_score int")
    out = language.reject_unknown(docs)
    assert out.columns == docs.columns and sorted(r.language_told_score for r in out.collect()) == list(range(40))
