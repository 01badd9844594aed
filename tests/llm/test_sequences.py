"""Packing, periodic runs and fill-in-middle against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict
from itertools import product

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from klarspan.llm import infill, packing, periods

EDGE = [(1, None), (2, ""), (None, "a b a b a b a b a b"), (None, None), (3, "one"), (4, "x " * 40), (5, "Été größe ab \n\n cd"), (6, "<P> mark"), (7, "b" * 3000), (8, " \t\n"), (8, " \t\n")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n long, key string")


# periodic runs


def plain_runs(word, least, exponent):
    found = {}
    for q in range(1, len(word) // exponent + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, length, q) for (i, length), q in found.items())


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 3), (2, 7)])
def test_runs_of_all_short_words(exponent, least):
    for n in range(11):
        for word in product((0, 1), repeat=n):
            assert periods.runs(list(word), least, exponent) == plain_runs(word, least, exponent), word


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=8), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_of_repeated_parts(parts, bounds):
    word = [x for part, times in parts for x in part * times]
    assert periods.runs(word, *bounds) == plain_runs(word, *bounds)


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(1)
    for _ in range(100):
        word = [rng.randint(0, 2) for _ in range(rng.randint(1, 60))]
        at = 0
        for start, length, earlier in periods.factors(word):
            assert start == at
            at += length
            occurs = lambda k: any(word[e : e + k] == word[start : start + k] for e in range(start))
            if earlier < 0:
                assert length == 1 and not occurs(1)
            else:
                assert earlier < start and word[earlier : earlier + length] == word[start : start + length]
                assert at == len(word) or not occurs(length + 1)
        assert at == len(word)


def periodic_rows(rows):
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        if i is not None and w:
            h = zlib.crc32(str(i).encode())
            g, n = h // 10, len(w)
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w, 6, 4)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
        out.append((i, len(runs), *first, brute.hexed(lines.encode()), brute.hexed(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_periodic_runs_query(spark, sf_dir, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += EDGE + [(400, "la la la " * 2000), (401, "\n".join(["the same line again"] * 9 + ["another one"] * 5) + " end")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert brute.plain(got.collect()) == brute.plain(periodic_rows(rows))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op12_periodic_runs"](spark, sf_dir)
    assert brute.plain(got.collect()) == brute.plain(periodic_rows([tuple(r) for r in docs]))


def test_periodic_runs_of_a_long_text_and_an_empty_table(spark):
    text = "a b a c " * 50_000 + "d"
    (row,) = periods.periodic_runs(table(spark, [(1, text)])).collect()
    assert row.n_words == 200_001 and [tuple(r) for r in row.runs] == [(0, 200_000, 4)] and row.collapsed == "a b a c d"
    assert periods.periodic_runs(table(spark, [])).collect() == []


# fill-in-middle


def plain_infill(rows):
    import re

    out = []
    for i, text in rows:
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        made = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        cut = form != "plain"
        out.append((i, n, form, len(p) if cut else None, len(m) if cut else None, brute.hexed(made.encode()), brute.hexed(text.encode())))
    return out


def test_fill_in_middle_query(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab é<PSM>🙂\n") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += EDGE + [(500 + i, "the very same text, again and again") for i in range(60)] + [(None, "the very same text, again and again")] * 20 + [(900, "long text " * 30_000)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(infill, "LEAST_HOT", 16)
    got = entry.queries()["op13_fill_in_middle"](spark, str(tmp_path))
    want = plain_infill(rows)
    assert brute.plain(got.collect()) == brute.plain(want)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(table(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=80))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    assert infill.select(infill.encode(values), len(values), list(range(len(values)))) == values.tolist()


# packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(tokenizer):

    rng = random.Random(4)
    parts = ["a", "It's", " ", "  ", "\n", "\r\n", "\t", " ", " ", "　", "\x85", "\x1c", "\x7f", "é", "größe", "12", "!?", "<|endoftext|>", "日本", "'ll", "🙂", " ", "word", "\x00", "À"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * 5000, "\n" * 500, ""]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    data = [t.encode() for t in texts]
    ids, at = encoder(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_is_kept_and_encodes_a_string_once(tokenizer, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing._encoder.cache_clear()
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abé\x00") * rng.randint(1, 20) + rng.choice(("", "x", "\x00")) for _ in range(50)) for _ in range(40)]
    texts += [f" {'w' * k}{i}" for k in range(1, 20) for i in range(400)]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def encoded():
        ids, at = packing.encoder(path)(raw, offsets)  # as each task of a worker does
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        return packing.encoder(path)

    learned = []
    monkeypatch.setattr(packing.Encoder, "_learn", lambda self, new, f=packing.Encoder._learn: (learned.extend(new), f(self, new))[1])
    first = encoded()
    n = len(learned)
    assert n == len(set(learned)) == first.count > 1_000
    assert encoded() is first and len(learned) == n
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    assert encoded() is first and len(learned) == 2 * n and first.count == n
    first.forget()
    first._table(16)  # grows
    encoded()
    assert len(first.number) >= 2 * first.count - len(first.known) > 1_000
    monkeypatch.setattr(packing.Encoder, "_slots", lambda self, low, high: np.zeros(len(low), np.int64))  # all keys meet
    encoded()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_holds_and_bins_fit(lengths):
    size = 12
    bins, offset = packing.best_fit(np.array(lengths), size)
    taken = defaultdict(list)
    for n, b, o in zip(lengths, bins.tolist(), offset.tolist()):
        taken[b] += range(o, o + n)
    assert all(sorted(t) == list(range(len(t))) and len(t) <= size for t in taken.values())

    def fewest(rest, free):
        if not rest:
            return len(free)
        options = {f: k for k, f in enumerate(free) if f >= rest[0]}
        return min([fewest(rest[1:], free[:k] + [f - rest[0]] + free[k + 1 :]) for f, k in options.items()] + [fewest(rest[1:], [*free, size - rest[0]])])

    assert packing.lower_bound(np.array(lengths), size) <= fewest(sorted(lengths, reverse=True), []) <= len(taken)


def test_bounds_beyond_the_sum():
    assert packing.lower_bound(np.full(10, 600), 1024) == 10
    assert packing.lower_bound(np.full(12, 350), 1024) == 6
    assert packing.lower_bound(np.array([], np.int64), 1024) == 0


def check_packing(rows, spark, tokenizer, path):
    got = entry.queries()["op11_best_fit_packing"](spark, path).collect()
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert brute.plain(r[:5] for r in got) == brute.plain(want)
    taken = defaultdict(list)
    for r in got:
        taken[r.sequence_id].append((r.offset, r.length))
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array([w[3] for w in want])
    return len(taken), packing.lower_bound(lengths, 1024)


def test_packing_query(spark, sf_dir, tmp_path, tokenizer):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("one", "two", "größe")) for _ in range(rng.choice((3, 40, 500, 900, 2500))))) for i in range(200)] + EDGE + [(1000, "w " * 1023), (1001, "w" + " w" * 2046)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found, bound = check_packing(rows, spark, tokenizer, str(tmp_path))
    assert found <= 1.03 * bound + 1
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found, bound = check_packing(docs, spark, tokenizer, sf_dir)
    assert found <= bound + 1


def test_exchange_and_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION", 60)
    rng = random.Random(6)
    sizes = [rng.choice((30, 34, 35, 51, 52, 17, 100)) for _ in range(2000)]
    pieces = spark.createDataFrame([(k, n, struct.pack(f"<{n}I", *[k] * n)) for k, n in enumerate(sizes)], "bin long, length long, ids binary")
    packed = packing.pack(pieces, size=100).cache()
    assert packed.columns == ["bin", "length", "ids", "sequence_id", "offset", "certified"] and packed.count() == 2000
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(sizes) and all(len(r.ids) == 4 * r.length <= 400 for r in whole)
    bound = packing.lower_bound(np.array(sizes), 100)
    assert bound <= len(whole) <= 1.03 * bound
    assert packing.pack(pieces.limit(0), size=100).collect() == []
    assert packing.token_pieces(table(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
