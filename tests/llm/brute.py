"""Plain Python versions of the operators, for small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hexed(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def corpus(seed: int = 3) -> list[tuple]:
    """Documents with null and empty texts, null ids, repeated rows, copies, shared passages and a long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "größe", "nıño"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = line(90)
    rows = [(i, f"{line(rng.randint(1, 120))}\n{line(30)}", "en", "src0" if i % 3 else "src1") for i in range(30)]
    rows += [(100 + i, f"{line(rng.randint(0, 40))} {shared}\t{line(20)}", "de", "src0") for i in range(8)]
    rows += [(200, rows[0][1], None, None), (0, rows[0][1], "en", "src1"), (None, rows[3][1], "en", "src0"), (None, None, None, None)]
    rows += [(300, None, "en", "src2"), (301, "", "en", "src2"), (302, " \n\t ", "en", "src2"), (303, "a" * 1500, "en", "src0"), (304, "ab " * 400, "en", "src0"), (305, "one two", "en", "src0"), (306, "ONE two", "en", "src0"), (307, line(9000), "en", "src0")]
    rows += [(307, rows[-1][1], "en", "src0")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def substring(rows, length):
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + length]) for _, w in docs for i in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hexed(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix(rows, length):
    docs = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(w[i : i + length] for _, w in docs for i in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[w[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(w), sum(gone), runs, hexed(bytes(x for x, g in zip(w, gone) if not g))))
    return out


def simhash(rows, size=4, radius=4):
    prints = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        parts = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints.append((r[0], sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)].append(doc)
    return [(doc, f"{fp:016x}", min(least[root(i)], default=None)) for i, (doc, fp) in enumerate(prints)]


def windows(rows, items, length=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    known = defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(length, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            known[tuple(w[i : i + k])].add("null" if item is None else str(item))
    sizes = {len(k) for k in known}
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit |= set(range(i, i + k))
                    found |= known[tuple(w[i : i + k])]
        out.append((r[0], len(w), len(hit), len(found), hexed(",".join(sorted(found)).encode()), bool(hit)))
    return out


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def valid(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) % 10 + int(c) // 5 for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PII for m in re.finditer(p, text or "") if valid(k, m.group())]


def plain(rows):
    """Comparable rows: nulls first, as text."""
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
