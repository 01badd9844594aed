"""PII by candidate gradient boosting, with DataFrame functions alone.

Base spans are the written patterns' matches that pass their checks; they always stay. Beside them, high-recall
generators propose spans in other forms: numbers that the base patterns swallow in longer runs, cards in any groups,
national phone numbers, shortened IPv6, and addresses with `at` and `dot` in brackets or in words. Boosted trees score each proposal by features of its format and of the words around it; a
proposal is kept if its calibrated probability reaches its kind's threshold and it overlaps no base span and no better
proposal. The trees are fitted here, on labelled sentences made from a fixed seed (N_EXAMPLES of them), and are
compiled to SQL expressions.

Null text counts as empty. Offsets count code points, ends are exclusive. Repeated rows each give a row. Patterns use
possessive forms of the same language, so that very long runs neither overflow a stack nor take quadratic time.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_AFTER = r"(?:\G|(?<![{0}]))"  # a match starts where a run of these starts, or right after another match
BASE = {
    "email": _AFTER.format(r"A-Za-z0-9._%+\-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _AFTER.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"[(\[{]dot[)\]}]"
PROPOSED = {
    # local[at]host.tld with any brackets, or `local at host dot tld` in words
    "email": r"(?i)(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|" + _DOT + r")\x20?[A-Za-z0-9-]{1,63}){1,5}|\x20at\x20[A-Za-z0-9-]{1,63}(?:(?:\x20dot\x20|\x20?" + _DOT + r"\x20?)[A-Za-z0-9-]{1,63}){1,5})",
    # dots in brackets, eight groups of hexadecimal digits, or fewer with one `::`
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,35}::)(?=:{0,2}[0-9A-Fa-f])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Za-z:])",
    # 13 to 19 digits in any groups
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    # 3-3-4, or a leading zero (national, or 00 and a country's code) and seven to sixteen digits in any groups
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+.,])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})(?:[\x20./-]{0,2}[0-9]){5,11}(?![0-9])",
}
#: A text without any of these cannot match; looked for before the pattern is tried.
_NEEDS = {("base", "email"): ("@",), ("base", "phone"): ("+",), ("proposed", "email"): ("at)", "at]", "at}", " dot ", "dot)", "dot]", "dot}"), ("proposed", "ip"): ("[.]", "(.)", "[dot]", ":")}
#: Words near a span; fixed values.
CUES = {
    "cue_email": "mail|contact|write|reach|address|schreib|adresse|correo|courriel",
    "cue_ip": "ip|host|server|address|client|node|gateway|dns",
    "cue_card": "card|visa|master|amex|credit|debit|pay|paid|charge|karte|carte|tarjeta",
    "cue_phone": "phone|tel|call|fax|mobil|cell|dial|contact|handy|ruf|appel|llam|portable|sms|whatsapp",
    "cue_other": "order|invoice|version|isbn|sku|part|serial|tracking|batch|model|ticket|release|build|item|date|datum|born|page|ratio|id|bestell|rechnung|commande|factura|kunde",
}
FEATURES = ("kind", "length", "n_digits", "luhn", "n_separators", "lead", "same", "octets", "tld", "date", "groups", "left_joined", "right_joined", *CUES)
CONTEXT = 24
N_EXAMPLES = 4800
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _needed(text: Column, key: tuple[str, str]) -> Column:
    text = F.lower(text) if key == ("proposed", "email") else text
    parts = [F.contains(text, F.lit(x)) for x in _NEEDS.get(key, ())]
    return functools.reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise((2 * c.try_cast("int")) % 10 + F.floor(c.try_cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(x: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {"email": F.lit(True), "ip": _octets(x), "card": (n >= 16) & (n <= 19) & luhn(_digits(x)), "phone": (n >= 8) & (n <= 15)}[kind]


#: Elements that a fold handles at once, and characters of a block of text: folds and cuts cost this much at most for
#: each element, so that the work grows with the text.
FOLD = 256
BLOCK = 256


def _chunks(values: Column) -> Column:
    """An array in chunks of FOLD elements. To be a column of its own: inside a function of each element, Spark would
    compute it again."""
    return F.transform(F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int"))).otherwise(F.array().cast("array<int>")), lambda c: F.slice(values, c * FOLD + 1, FOLD))


def _running(chunks: Column, kind: str) -> Column:
    """Running sums or maxima of the integers in chunks, as one array."""
    join = {"sum": lambda a, b: a + b, "max": F.greatest}[kind]

    def fold(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(join(s["at"], x))).alias("out")), lambda s: s["out"])

    whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: join(a, x)))
    before = F.concat(F.array(F.lit(0)), fold(whole, F.lit(0)))
    return F.flatten(F.zip_with(chunks, F.slice(before, 1, F.size(chunks)), fold))


def _blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points, for ``_cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to before ``end``, without reading what stands before it."""
    first = F.floor(start / BLOCK).cast("int")
    part = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(part, start - first * BLOCK + 1, end - start)).otherwise("")


def _matches(df: DataFrame, which: str, patterns: dict[str, str]) -> DataFrame:
    """Adds ``pii_<which>_<kind>`` columns with the matches of ``pii_text``. The text between matches tells where each one
    starts."""
    text = F.col("pii_text")
    names = [f"pii_{which}_{k}" for k in patterns]
    empty = F.array().cast("array<string>")
    found = {f"{n}_m": F.when(_needed(text, (which, k)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(empty) for n, (k, p) in zip(names, patterns.items())}
    df = df.withColumns(found)
    df = df.withColumns({f"{n}_p": F.when(F.size(f"{n}_m") > 0, F.slice(F.split(text, p, -1), 1, F.size(f"{n}_m"))).otherwise(empty) for n, p in zip(names, patterns.values())})
    df = df.withColumns({f"{n}_l": F.zip_with(f"{n}_p", f"{n}_m", lambda p, m: F.length(p) + F.length(m)) for n in names})
    df = df.withColumns({f"{n}_c": _chunks(F.col(f"{n}_l")) for n in names})
    one = lambda kind: lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))
    df = df.withColumns({n: F.zip_with(f"{n}_m", _running(F.col(f"{n}_c"), "sum"), one(KINDS.index(k))) for n, k in zip(names, patterns)})
    return df.drop(*(f"{n}_{x}" for n in names for x in "mplc"))


def _clusters(df: DataFrame, spans: str, out: str) -> DataFrame:
    """Adds ``out``: the spans of a column, sorted by start, in groups whose members overlap each other in a chain. Functions
    of elements use no array but those of several uses, since Spark moves an array used once into them."""
    df = df.withColumn("pii_e", F.transform(spans, lambda x: x["end"]))
    df = df.withColumn("pii_c", _chunks(F.col("pii_e")))
    before = F.concat(F.array(F.lit(-1)), _running(F.col("pii_c"), "max"))  # the greatest end of those that stand before
    begins = F.zip_with(spans, F.slice(before, 1, F.size(spans)), lambda x, m: x["start"] >= m)
    df = df.withColumn("pii_i", F.array_compact(F.transform(begins, lambda b, i: F.when(b, i))))
    until = F.concat(F.slice("pii_i", 2, F.size("pii_i")), F.array(F.size(spans)))
    df = df.withColumn("pii_r", F.when(F.size("pii_i") > 0, F.zip_with("pii_i", until, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    return df.withColumn(out, F.transform("pii_r", lambda x: F.slice(spans, x["a"] + 1, x["b"] - x["a"]))).drop("pii_e", "pii_c", "pii_i", "pii_r")


def _features(blocks: Column, p: Column) -> Column:
    """The features of a proposal, beside its span."""
    start, end, value = p["start"], p["end"], p["value"]
    digits = _digits(value)
    before = F.lower(_cut(blocks, F.greatest(F.lit(0), start - CONTEXT), start))
    after = F.lower(_cut(blocks, end, end + CONTEXT))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    plain = F.regexp_replace(value, r"\[\.\]|\(\.\)|\[dot\]", ".")
    cols = {
        "kind": p["kind"].cast("double"),
        "length": F.length(value).cast("double"),
        "n_digits": F.length(digits).cast("double"),
        "luhn": flag((F.length(digits) >= 13) & luhn(digits)),
        "n_separators": F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")).cast("double"),
        "lead": F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
        "same": flag(F.length(F.translate(digits, "0123456789", "")) + F.size(F.array_distinct(F.split(digits, ""))) <= 2),
        "octets": flag(_octets(plain) | F.contains(value, F.lit(":"))),
        "tld": F.length(F.regexp_extract(value, "[A-Za-z]*$", 0)).cast("double"),
        "date": flag(value.rlike(r"^[0-9]{1,2}[\x20./-]{1,2}[0-9]{1,2}[\x20./-]{1,2}(?:[0-9]{2}|[0-9]{4})$")),
        "groups": F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"),
        "left_joined": flag(F.right(before, F.lit(1)).rlike(r"[\p{L}0-9#$._/-]") & (start > 0)),
        "right_joined": flag(F.left(after, F.lit(1)).rlike(r"[\p{L}0-9#%_/-]")),
    } | {name: flag(before.rlike(rf"\b(?:{words})") | after.rlike(rf"^\W*(?:{words})")) for name, words in CUES.items()}
    return F.struct(start.alias("start"), end.alias("end"), F.struct(*(cols[f].alias(f) for f in FEATURES)).alias("x"))


def _proposals(df: DataFrame) -> DataFrame:
    """Adds ``pii_proposed``: all proposals with their features."""
    df = _matches(df, "proposed", PROPOSED)
    names = [f"pii_proposed_{k}" for k in PROPOSED]
    every = F.concat(*names)
    df = df.withColumn("pii_every", every).withColumn("pii_blocks", F.when(F.size("pii_every") > 0, _blocks(F.col("pii_text"))))
    return df.withColumn("pii_proposed", F.transform("pii_every", lambda p: _features(F.col("pii_blocks"), p))).drop(*names, "pii_every", "pii_blocks")


# The model


def _examples(n: int = N_EXAMPLES) -> list[tuple[str, int]]:
    """Labelled sentences, each with proposals of one label."""
    rng = random.Random(5)
    words = "the of and report team later found about under street winter market paper along from which with place".split()
    cues = {k: [w for w in CUES[f"cue_{k}"].split("|")] for k in KINDS}
    other = CUES["cue_other"].split("|")
    d = lambda k, lo=0: "".join(str(rng.randint(lo if i == 0 else 0, 9)) for i in range(k))

    def check_digit(x: str) -> str:
        total = sum(int(c) if i % 2 else (2 * int(c)) % 10 + int(c) // 5 for i, c in enumerate(reversed(x)))
        return str(-total % 10)

    def card(good: bool) -> str:
        groups = rng.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 3, 3, 3), (4, 4, 4, 4, 3)])
        x = rng.choice("3456") + d(sum(groups) - 2)
        last = check_digit(x)
        x += last if good else str((int(last) + rng.randint(1, 9)) % 10)
        sep, at, parts = rng.choice(["", "", " ", "-"]), 0, []
        for g in groups:
            parts.append(x[at : at + g])
            at += g
        x = sep.join(parts)
        return f"{x} {x}" if rng.random() < 0.2 and len(x) < 17 else x

    def phone(good: bool) -> str:
        if not good:
            return rng.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(1, 1)}.{rng.choice(['0', '1'])}{d(1)}.20{d(2)}", f"0{d(1, 1)}/0{d(1, 1)}/19{d(2)}", f"000{d(6)}", f"00{d(8)}", f"0{d(9, 1)}", f"0{d(2, 1)}-{d(5)}"])
        pairs = " ".join([f"0{rng.randint(1, 9)}", *(d(2) for _ in range(4))])
        return rng.choice([f"({d(3, 2)}) {d(3, 2)}-{d(4)}", f"{d(3, 2)}-{d(3, 2)}-{d(4)}", f"{d(3, 2)}.{d(3, 2)}.{d(4)}", f"0{d(2, 2)} {d(7, 1)}", f"0{d(3, 1)}/{d(6, 1)}", f"0{d(3, 1)} {d(3, 1)} {d(4)}", pairs, pairs.replace(" ", "."), f"00{d(2, 3)} {d(2, 1)} {d(7, 1)}", f"(0{d(2, 2)}) {d(3, 1)} {d(4)}", f"0{d(3, 1)}-{d(7, 1)}", f"0{d(10, 1)}"])

    def ip(good: bool) -> str:
        group = lambda: f"{rng.randint(0, 65535):x}"
        if rng.random() < 0.5:
            if not good:
                return rng.choice([f"{d(1)}::{d(1)}", f"{d(2)}::{d(2)}", f"{d(1)}::"])
            if rng.random() < 0.4:
                return ":".join(group() for _ in range(8))
            left = [f"{rng.choice(['2001', 'fe80', '2a02', 'fd00', group()])}", *(group() for _ in range(rng.randint(0, 2)))]
            return ":".join(left) + "::" + ":".join(group() for _ in range(rng.randint(1, 4))) if rng.random() < 0.9 else f"::{group()}:{group()}"
        dot = rng.choice(["[.]", "(.)", "[dot]"])
        return dot.join(str(rng.randint(0, 255 if good else 999) if i or good else rng.randint(256, 999)) for i in range(4))

    def email(good: bool) -> str:
        a, b, c = rng.sample(words, 3)
        local = rng.choice([a, f"{a}.{d(2)}", f"{a}_{c}", f"{a}.{c}"])
        end = rng.choice(["com", "org", "net", "de", "fr", "io", "edu", "es"]) if good else rng.choice(["1", "22", "x", "7"])
        o, e = rng.choice(["()", "[]", "{}"])
        s = rng.choice(["", " "])
        if rng.random() < 0.4:
            made = f"{local} at {b} dot {end}" if good or rng.random() < 0.7 else f"{a} at {b} dot {c} dot {end}"
        else:
            made = f"{local}{s}{o}at{e}{s}{b}{s}{rng.choice([f'{o}dot{e}', '.'])}{s}{end}" if good else f"{local}{s}{o}at{e}{s}{c}.{end}"
        return made.upper() if rng.random() < 0.2 else made

    make = lambda kind, good: {"card": card, "phone": phone, "ip": ip, "email": email}[kind](good)

    out = []
    for i in range(n):
        kind, good = KINDS[i % 4], i // 4 % 2 == 0
        cue = rng.choice(cues[kind]) if good and rng.random() < 0.6 else rng.choice(other) if not good and rng.random() < 0.7 else rng.choice(words)
        number = make(kind, good)
        if kind == "card" and not good and rng.random() < 0.2:  # a number that passes the check, but is named as another thing
            cue, number = rng.choice(other), card(True)
        fill = lambda k: " ".join(rng.choice(words) for _ in range(k))
        out.append((f"{fill(rng.randint(0, 5))} {cue}{rng.choice([':', '', ' is'])} {number}{rng.choice([' ', '. ', ', '])}{fill(rng.randint(0, 5))}", int(good)))
    return out


class Trees:
    """Boosted regression trees of depth 2 for the logistic loss."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, least: int = 8):
        self.rounds, self.rate, self.least = rounds, rate, least
        self.base, self.trees = 0.0, []

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray):
        best, gain = None, 1e-6
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1])[np.linspace(0, len(values) - 2, min(16, len(values) - 1)).astype(int)] / 2 if len(values) > 1 else ():
                left = rows[x[rows, f] <= cut]
                if self.least <= len(left) <= len(rows) - self.least:
                    gl, hl = g[left].sum(), h[left].sum()
                    now = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - total
                    if now > gain:
                        best, gain = (f, float(cut)), now
        return best

    def _grow(self, x, g, h, rows, depth):
        at = self._split(x, g, h, rows) if depth else None
        if at is None:
            return float(self.rate * g[rows].sum() / (h[rows].sum() + 1))
        left = x[rows, at[0]] <= at[1]
        return (*at, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._value(a, x), self._value(b, x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(x, y - p, p * (1 - p), np.arange(len(y)), 2))
            score += self._value(self.trees[-1], x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, x: Column) -> Column:
        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, a, b = tree
            return F.when(x[FEATURES[f]] <= cut, value(a)).otherwise(value(b))

        return functools.reduce(lambda a, b: a + b, map(value, self.trees))


PRECISION = 0.98


def _fitted(rows: tuple) -> tuple[Trees, tuple[float, float], tuple[float, ...]]:
    """Trees, their calibration (probability = sigmoid(a * score + b)) and each kind's threshold of probability, the
    lowest of at least one half that keeps PRECISION on the examples held out from the trees."""
    data = np.array(rows)
    x, y, fold = data[:, 2:], data[:, 1], data[:, 0]
    trees = Trees().fit(x[fold != 0], y[fold != 0])
    score, truth = trees.score(x[fold == 0]), y[fold == 0]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic regression on one score
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        s = np.stack([score, np.ones_like(score)], 1)
        step = np.linalg.solve((s * w[:, None]).T @ s + 1e-3 * np.eye(2), s.T @ (truth - p) - 1e-3 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
    p = 1 / (1 + np.exp(-(a * score + b)))
    limits = []
    for kind in range(len(KINDS)):
        mine = x[fold == 0][:, 0] == kind
        good = [t for t in np.unique(p[mine]) if truth[mine & (p >= t)].mean() >= PRECISION]
        limits.append(max(0.5, float(min(good))) if good else 2.0)
    return trees, (float(a), float(b)), tuple(limits)


_MODEL: list = []


def model(spark: SparkSession):
    """The fitted trees; their examples pass through the same generators and features as documents, once a driver."""
    if not _MODEL:
        rows = json.dumps([{"fold": i // 8 % 4, "text": t, "y": y} for i, (t, y) in enumerate(_examples())])
        texts = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<fold:int,text:string,y:int>>")).alias("e")).select("e.fold", "e.y", F.col("e.text").alias("pii_text"))
        # no explode: Spark would filter by the array's size first, and for that compute all its steps many times over
        found = _proposals(texts).select("fold", "y", F.transform("pii_proposed", lambda p: F.array(*(p["x"][f] for f in FEATURES))).alias("x")).collect()
        _MODEL.append(_fitted(tuple(sorted((float(r.fold), float(r.y), *x) for r in found for x in r.x))))  # of N_EXAMPLES sentences
    return _MODEL[0]


# The operator


def with_spans(docs: DataFrame) -> DataFrame:
    """The documents with ``pii_base`` (base spans) and ``pii_spans`` (all spans), by kind and start."""
    trees, (a, b), limits = model(docs.sparkSession)
    df = docs.withColumn("pii_text", F.coalesce("text", F.lit("")))
    df = _matches(df, "base", BASE)
    names = {k: f"pii_base_{k}" for k in KINDS}
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    df = df.withColumn("pii_base", F.concat(*(F.transform(F.filter(n, _keep(k)), slim) for k, n in names.items()))).drop(*names.values())
    df = _proposals(df)
    limit = F.array(*(F.lit(t) for t in limits))

    def scored(p: Column) -> Column:
        return F.struct((1 / (1 + F.exp(-(F.lit(a) * trees.column(p["x"]) + F.lit(b))))).alias("p"), p["start"].alias("start"), p["end"].alias("end"), p["x"]["kind"].cast("int").alias("kind"))

    df = df.withColumn("pii_scored", F.filter(F.transform("pii_proposed", scored), lambda s: s["p"] >= F.get(limit, s["kind"])))
    # base spans first, then proposals by probability, each if it is clear of what was taken; only within a group of overlaps
    base = F.transform("pii_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(2.0).alias("p")))
    df = df.withColumn("pii_sorted", F.array_sort(F.concat(base, F.transform("pii_scored", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"))))))
    df = _clusters(df, "pii_sorted", "pii_groups")
    clear = lambda spans, s: ~F.exists(spans, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    best = lambda g: F.reverse(F.array_sort(F.transform(F.filter(g, lambda s: s["p"] < 2.0), lambda s: F.struct(s["p"].alias("p"), (-s["start"]).alias("first"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    taken = lambda g: F.aggregate(best(g), F.transform(F.filter(g, lambda s: s["p"] == 2.0), slim), lambda out, s: F.when(clear(out, s), F.concat(out, F.array(slim(s)))).otherwise(out))
    return df.withColumn("pii_spans", F.array_sort(F.flatten(F.transform("pii_groups", taken)))).drop("pii_text", "pii_proposed", "pii_scored", "pii_sorted", "pii_groups")


def _keep(kind: str):
    return lambda s: _valid(kind, s["value"])


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind:start:end)."""
    df = with_spans(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("pii_base", lambda s: s["kind"] == i)).cast("long")
    return df.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_digest(F.col("pii_base")), 256).alias("base_sha256"), _digest(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, each span of their text replaced by its kind in angle brackets; null stays null.
    Overlapping spans become one, named by the first."""
    df = with_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"))  # so that no column's name clashes
    by_start = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = _clusters(df.withColumn("pii_by_start", by_start), "pii_by_start", "pii_groups")
    whole = F.transform("pii_groups", lambda g: F.struct(g[0]["start"].alias("start"), F.array_max(F.transform(g, lambda s: s["end"])).alias("end"), g[0]["kind"].alias("kind")))
    df = df.withColumn("pii_whole", whole).withColumn("pii_blocks", F.when(F.size("pii_whole") > 0, _blocks(F.col("text"))))
    df = df.withColumn("pii_from", F.concat(F.array(F.lit(0)), F.transform("pii_whole", lambda s: s["end"])))
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    parts = F.zip_with("pii_whole", F.slice("pii_from", 1, F.size("pii_whole")), lambda s, at: F.concat(_cut(F.col("pii_blocks"), at, s["start"]), F.get(tags, s["kind"])))
    rest = _cut(F.col("pii_blocks"), F.element_at("pii_from", -1), F.length("text"))
    new = F.when(F.size("pii_whole") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text"))
    return df.select(*(new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
