"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant within half the radius of each. Every distinct
fingerprint emits all its variants within half the radius, factored by their leading bits: one pair (prefix variant,
fingerprint), packed with others of its prefix, stands for all variants with that prefix, and the task that receives a
prefix expands them, sorts them and links the fingerprints that share one (each with one of them; all lie within the
radius of one another). Prefixes with too many fingerprints are dealt again by longer ones, without loss, so a large group of near
copies spreads over tasks. Links are contracted to components in Spark.

Null or empty text: fingerprint zero, linked like any other. Null ids take part but are never a component's smallest,
unless all are null; then the component's id is null. Repeated rows each give a row.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C
from klarspan.llm.components import connected

SEED = 42
STEP = 8
#: Fingerprints of one prefix that a task expands; larger prefixes are dealt again by STEP more bits.
MOST_ROWS = 1_000_000
#: Which links are given.
FOREST, BEST = "forest", "best"
#: Fingerprints dealt at once in a task.
DEAL = 50_000
#: Variants expanded at once in a task.
CHUNK = 4_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, size: int = 4) -> int:
    """Bit b is set if it is set in over half of the XXH64 hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(2048, np.int64)
    for at in range(0, n, 1_000_000):
        lanes = hashes[at : at + 1_000_000].view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            prints = np.array([fingerprint((x.as_buffer() or b"") and x.as_buffer().to_pybytes(), size) for x in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _flips(bits: int, lowest: int, most: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, ... most set bits among ``bits`` bits from bit ``lowest`` on."""
    return [np.array([sum(1 << (lowest + i) for i in c) for c in combinations(range(bits), k)], np.uint64) for k in range(most + 1)]


def _above(x: np.ndarray, bits: int) -> np.ndarray:
    """x without all but its ``bits`` highest bits."""
    return x & np.uint64((((1 << bits) - 1) << (64 - bits)) & 0xFFFFFFFFFFFFFFFF)


DEALT = "prefix long, n long, first long, width int, data binary"
_DEALT = pa.schema([("prefix", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])


def _copies(prefix: np.ndarray, fp: np.ndarray, old: int, new: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix of ``old`` bits, fp) pairs become one for each prefix of ``new`` bits within the flips left to them. A
    prefix fills the highest bits of a number; the others are zero."""
    left = most - np.bitwise_count(_above(fp, old) ^ prefix).astype(np.int64)
    own = prefix | (_above(fp, new) ^ _above(fp, old))
    prefixes, prints = [], []
    for k, mask in enumerate(_flips(new - old, 64 - new, most)):
        mine = np.flatnonzero(left >= k)
        prefixes.append((own[mine][:, None] ^ mask[None, :]).ravel())
        prints.append(np.repeat(fp[mine], len(mask)))
    return np.concatenate(prefixes), np.concatenate(prints)


def _sorted_pairs(prefix: np.ndarray, fp: np.ndarray):
    """Each prefix with its fingerprints, sorted."""
    order = np.argsort(fp)
    order = order[np.argsort(prefix[order], kind="stable")]
    prefix, fp = prefix[order], fp[order]
    edge = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(prefix))):
        yield prefix[a], fp[a:b]


def _blobs(prefix: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    rows = []
    for p, own in _sorted_pairs(prefix, fp):
        width, data = C.packed(own)
        rows.append((int(p.view(np.int64)), len(own), int(own[:1].view(np.int64)[0]), width, data))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DEALT)], schema=_DEALT)


def _read_blobs(batch: pa.RecordBatch):
    for r in batch.to_pylist():
        yield np.array([r["prefix"]], np.int64).view(np.uint64)[0], C.unpacked(r["first"], r["width"], r["data"])


def _dealt_first(prints: DataFrame, bits: int, most: int) -> DataFrame:
    """Fingerprints by prefix, packed: a row for each prefix and task (or part of a large task)."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b["fp"].to_numpy(zero_copy_only=False).view(np.uint64))
            n += b.num_rows
            if n >= DEAL:
                fp = np.concatenate(held)
                yield _blobs(*_copies(np.zeros(len(fp), np.uint64), fp, 0, bits, most))
                held, n = [], 0
        if n:
            fp = np.concatenate(held)
            yield _blobs(*_copies(np.zeros(len(fp), np.uint64), fp, 0, bits, most))

    return prints.select("fp").mapInArrow(run, DEALT)


def _dealt_again(rows: DataFrame, old: int, new: int, most: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for prefix, fp in _read_blobs(b):
                for lo in range(0, len(fp), DEAL):
                    part = fp[lo : lo + DEAL]
                    yield _blobs(*_copies(np.full(len(part), prefix), part, old, new, most))

    return rows.mapInArrow(run, DEALT)


def _shared(prefix: np.ndarray, fp: np.ndarray, bits: int, masks: list[np.ndarray], how: str) -> tuple[np.ndarray, np.ndarray]:
    """Links that the variants of some whole prefixes show. In each variant's group, every fingerprint is linked to the
    one that shares most variants overall, the hub; of these links,
    FOREST: a forest that connects as much as all of them;
    BEST: one for each fingerprint, with the neighbour that shares most variants overall."""
    fp, name = np.unique(fp, return_inverse=True)  # a fingerprint may stand under several prefixes
    left = len(masks) - 1 - np.bitwise_count(_above(fp[name], bits) ^ prefix).astype(np.int64)
    low = np.uint64((1 << (64 - bits)) - 1)
    own = prefix | (fp[name] & low)
    parts, who = [], []
    for k, mask in enumerate(masks):
        mine = np.flatnonzero(left >= k)
        parts.append((own[mine][:, None] ^ mask[None, :]).ravel())
        who.append((mine, len(mask)))
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return fp[:0], fp[:0]
    del every
    variants, owners = [], []
    for part, (mine, n) in zip(parts, who):
        at = np.minimum(np.searchsorted(twice, part), len(twice) - 1)
        hit = np.flatnonzero(twice[at] == part)
        variants.append(at[hit])
        owners.append(name[mine[hit // n]])
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    by_rank = np.lexsort((np.arange(len(fp)), -np.bincount(owner, minlength=len(fp))))
    rank = np.empty(len(fp), np.int64)
    rank[by_rank] = np.arange(len(fp))
    first = np.full(len(twice), len(fp), np.int64)
    np.minimum.at(first, variant, rank[owner])
    other = by_rank[first[variant]]
    if how == FOREST:
        label = C.components(owner, other, len(fp))
        node = np.flatnonzero(label != np.arange(len(fp)))
        return fp[node], fp[label[node]]
    best = np.full(len(fp), len(fp), np.int64)
    np.minimum.at(best, owner, first[variant])
    node = np.flatnonzero(best < rank)
    return fp[node], fp[by_rank[best[node]]]


def _links(rows: DataFrame, bits: int, most: int, width: int, how: str) -> DataFrame:
    """Links (a, b) among the fingerprints of each prefix. A prefix with more variants than CHUNK is expanded in
    pieces, by a few more bits at a time."""
    sizes = lambda b: np.cumsum([len(m) for m in _flips(width - b, 0, most)])

    def pieces(prefix: np.ndarray, fp: np.ndarray, at: int):
        cost = np.maximum(0, sizes(at)[np.clip(most - np.bitwise_count(_above(fp, at) ^ prefix).astype(np.int64), 0, most)]).sum()
        if cost <= CHUNK or at + 4 > width:
            yield prefix, fp, at, cost
            return
        for p, own in _sorted_pairs(*_copies(prefix, fp, at, at + 4, most)):
            if len(own) > 1:
                yield from pieces(np.full(len(own), p), own, at + 4)

    def linked(todo, at: int):
        masks = _flips(width - at, 64 - width, most)
        a, b = _shared(np.concatenate([p for p, _ in todo]), np.concatenate([f for _, f in todo]), at, masks, how)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        todo, total, now = [], 0, None
        held: list[np.ndarray] = []
        last = None

        def whole(prefix, prints):
            nonlocal todo, total, now
            fp = np.concatenate(prints)
            for p, f, at, cost in pieces(np.full(len(fp), prefix), fp, bits):
                if todo and (at != now or total + cost > CHUNK):
                    yield from linked(todo, now)
                    todo, total = [], 0
                todo.append((p, f))
                total, now = total + cost, at

        for batch in batches:
            for prefix, fp in _read_blobs(batch):
                if held and prefix != last:
                    yield from whole(last, held)
                    held = []
                held.append(fp)
                last = prefix
        if held:
            yield from whole(last, held)
        if todo:
            yield from linked(todo, now)

    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "a long, b long")


def ball_links(prints: DataFrame, radius: int = 4, width: int = 64, how: str = FOREST, first_bits: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp`` that differ in at most ``radius`` (even) of their ``width``
    highest bits and in none below; which of them, ``how`` says (see _shared)."""
    most = radius // 2
    n = prints.count()
    balls = lambda b: sum(map(len, _flips(b, 0, most)))
    bits = first_bits or next(b for b in range(6, width + 1) if n * balls(b) <= (1 << b) * most_rows * 2 // 3 or b + STEP > width)
    rows = _dealt_first(prints, bits, most)
    found = []
    while True:
        large = C.written(rows.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most_rows).select("prefix"), "prefixes") if bits + STEP <= width and n > most_rows else None
        if large is None or large.isEmpty():
            found.append(_links(rows, bits, most, width, how))
            break
        found.append(_links(rows.join(large, "prefix", "left_anti"), bits, most, width, how))
        rows = _dealt_again(rows.join(large, "prefix", "left_semi"), bits, bits + STEP, most)
        bits += STEP
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def simhash_dedup(docs: DataFrame, size: int = 4, radius: int = 4, first_bits: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links)."""
    prints = C.written(fingerprints(docs, size), "fingerprints")
    distinct = C.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected(ball_links(distinct, radius, first_bits=first_bits, most_rows=most_rows))
    linked = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = C.written(linked.join(ids, "root").select("fp", "root", "component_id"), "classes")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("class_id"))


# Near copies of a given similarity, which one fingerprint's few bits would miss

#: A signature's fingerprints, each by another hash of the shingles, and how many of their bits are a table's key.
TABLES, WIDTH = 8, 48
#: Standard deviations over a similarity's expected distance up to which a pair that met in a table is tested at once;
#: the exact round judges the others.
SLACK = 2.6
#: Keys of all tables that are dealt together; of more, some tables at a time, and one by one from eight times as many on.
MOST_TOGETHER = 2_000_000
#: Keys of texts that are broadcast; more meet in a shuffled join.
MOST_KEYS = 200_000
#: Words of a set's parity.
PARITY = 8
_SIGNED = [f"s{i}" for i in range(TABLES)]
_PARITY = [f"p{i}" for i in range(PARITY)]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes; fewer words than ``size`` are one shingle."""
    words = text.lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """An even 64-bit name of a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) & ~1


def signature(text: bytes, size: int = 5) -> np.ndarray:
    """TABLES fingerprints of the text, each by another hash of its distinct shingles."""
    return _signed(shingle_hashes(text, size))


def _signed(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(TABLES, np.uint64)
    for lane in range(TABLES):
        counts = np.zeros(2048, np.int64)
        for at in range(0, len(hashes), 1_000_000):
            mixed = C.mix(hashes[at : at + 1_000_000] + np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            counts += np.bincount((mixed.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
        out[lane] = np.packbits(2 * (counts.reshape(8, 256) @ _BITS).ravel() > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _parity(hashes: np.ndarray) -> np.ndarray:
    """64 * PARITY bits, each whether an odd number of the hashes falls on it. Two sets' parities differ in at most as
    many bits as the sets in members."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)


def expected_bits(similarity: float, slack: float, bits: int = 64 * TABLES) -> int:
    """Bits in which signatures of texts of a Jaccard similarity differ, plus slack standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + slack * np.sqrt(bits * share * (1 - share)))


def near_pairs(nodes: DataFrame, most_bits: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, s0, s1, ...) whose signatures differ in at most ``most_bits`` bits, of those that meet
    in a table: each table is dealt by ball hashing (radius 4), and a fingerprint is paired with one neighbour."""
    mask = F.lit(-1 << (64 - WIDTH)).cast("long")
    keys = [F.col(c).bitwiseAND(mask).bitwiseOR(F.lit(t).cast("long")) for t, c in enumerate(_SIGNED)]  # the table's number never flips
    prints = nodes.select("node", F.explode(F.array(*keys)).alias("fp"))
    firsts = C.written(prints.groupBy("fp").agg(F.min("node").alias("node")), "tables")
    per = max(1, min(TABLES, TABLES * MOST_TOGETHER // max(1, firsts.count())))
    table = F.col("fp").bitwiseAND(F.lit((1 << (64 - WIDTH)) - 1).cast("long"))
    if per == TABLES:
        found = ball_links(firsts, 4, WIDTH, BEST)
    else:  # the copies that a round deals are released with it
        found = reduce(DataFrame.union, [C.written(ball_links(firsts.where(table.between(t, t + per - 1)), 4, WIDTH, BEST), "balls") for t in range(0, TABLES, per)])
    balls = found.groupBy("a").agg(F.min("b").alias("b"))  # tasks that hold one fingerprint agree
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    near = balls.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = prints.join(firsts.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    pairs = near.union(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sig = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}{c}") for x in _SIGNED))
    unlike = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in _SIGNED), F.lit(0))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").where(unlike <= most_bits).select("a", "b")


def sketch(hashes: np.ndarray) -> bytes:
    """Like _parity, of as many bits as a power of two from twice the set's size on."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, similarity: float) -> bool:
    """Whether two sets of n members together, as far as their sketches tell, may have the similarity. The longer sketch is
    folded to the shorter one's length, which gives the sketch of that length."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    words = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, words), axis=0) for v in (a, b))
    spare = 1 - 2 * similarity / (1 + similarity)
    return int(np.bitwise_count(a ^ b).sum()) <= spare * n + 1e-6


def likely_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that may have the similarity as far as sketches tell; they are a small part of the texts, which so
    need not meet for pairs that share a few shingles only."""
    pairs = C.written(pairs, "candidates")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    keys = C.written(nodes.select("node", "own").join(ends, "node").select("own"), "ends")
    n_keys = keys.count()
    found = _by_own(texts, keys, "left_semi") if n_keys <= MOST_KEYS else _may_match(texts, keys, n_keys).where("_may")

    def drawn(batches):
        for b in batches:
            own = [shingle_hashes(x.as_buffer().to_pybytes(), size) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(map(node_of, own)), np.uint64).view(np.int64)), pa.array([len(x) for x in own], pa.int32()), pa.array(list(map(sketch, own)), pa.binary())], ["node", "n", "sketch"])

    def run(batches):
        for b in batches:
            alike = pa.array([may_be_similar(x.as_py(), y.as_py(), n.as_py(), similarity) for x, y, n in zip(b["sketch_a"], b["sketch_b"], b["n"])], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(alike), b["b"].filter(alike)], ["a", "b"])

    drawings = C.written(found.select("text").mapInArrow(drawn, "node long, n int, sketch binary").dropDuplicates(["node"]), "sketches")
    of = lambda c: drawings.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def similar_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the Jaccard similarity of distinct shingles."""
    pairs = C.written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    keys = C.written(nodes.select("node", "own").join(ends, "node"), "keys")
    of_texts = _by_own(texts, keys, "inner").select("node", "text").dropDuplicates(["node"])
    of = lambda c: of_texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches):
        for batch in batches:
            alike = []
            for x, y in zip(batch["text_a"], batch["text_b"]):
                a, b = (shingle_hashes(t.as_buffer().to_pybytes(), size) for t in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(alike)), batch["b"].filter(pa.array(alike))], ["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


# The exact round: pairs that no table brought together

#: Texts whose shingles are counted for the order of shingles, in expectation, and the most counts that are kept. They
#: bear on the cost alone: prefixes find every pair under any order.
SAMPLE, MOST_COMMON = 20_000, 200_000
#: Rows of whole shingles handled at once in a task.
GROUPED = 200_000


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that several texts of a sample have, and how many."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")

    def run(batches):
        for b in batches:
            found = [shingle_hashes(x.as_buffer().to_pybytes(), size) for x in b["text"]]
            unlike = {node_of(x): x for x in found}.values()  # copies in one batch count once
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *unlike]).view(np.int64))], ["s"])

    counts = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n >= 3")
    rows = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()
    hashes = np.array([r["s"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in rows], np.int64)[order]


def prefix_of(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, int]:
    """The set's first hashes, rare ones first, and how many of them are early. The first hash that two sets of at least
    the similarity share is among these of both sets, and among the early ones of the smaller set."""
    known, counts = common
    n = len(hashes)
    count = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        count = np.where(known[at] == hashes, counts[at], 0)
    # a little less than the bounds, so that rounding never shortens the prefix
    first = lambda share: n - int(np.ceil(share * n - 1e-6)) + 1
    return hashes[np.argsort(count, kind="stable")[: first(similarity)]], first(2 * similarity / (1 + similarity))


def _whole_groups(batches, names: list[str]):
    """The batches' columns as arrays, cut where the sorted ``shingle`` (the first of them) changes."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([b[x].to_numpy(zero_copy_only=False) for x in names])
        n += b.num_rows
        if n >= GROUPED and held[-1][0][-1] != held[0][0][0]:
            columns = [np.concatenate(x) for x in zip(*held)]
            cut = np.searchsorted(columns[0], columns[0][-1])
            if cut:
                yield [x[:cut] for x in columns]
            held = [[x[cut:] for x in columns]]
            n = len(held[0][0])
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _edges(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _shared_shingles(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int, similarity: float) -> DataFrame:
    """(shingle, node, early) of the prefixes' shingles that several nodes have and that are early in one of them."""
    columns = ["shingle", "tagged"]  # a node's name is even; its last bit says whether the shingle is early

    def prefixes(batches):
        for b in batches:
            found = {}
            for x in b["text"]:
                own = shingle_hashes(x.as_buffer().to_pybytes(), size)
                node = node_of(own)
                if node not in found:
                    found[node] = prefix_of(own, common, similarity)
            shingle = np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in found.values())])
            tagged = np.concatenate([np.zeros(0, np.uint64), *((np.arange(len(p)) < early).astype(np.uint64) | np.uint64(node) for node, (p, early) in found.items())])
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(tagged.view(np.int64))], columns)

    def shared(batches):
        for shingle, tagged in _whole_groups(batches, columns):
            order = np.lexsort((tagged, shingle))
            shingle, tagged = shingle[order], tagged[order]
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (tagged[1:] != tagged[:-1])])  # copies that other tasks sent
            shingle, tagged = shingle[new], tagged[new]
            edge = _edges(shingle)
            n = np.diff(np.append(edge, len(shingle)))
            keep = np.repeat((n > 1) & (np.add.reduceat(tagged & 1, edge) > 0), n)
            shingle, tagged = shingle[keep], tagged[keep]
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(tagged & ~1), pa.array((tagged & 1).astype(bool))], ["shingle", "node", "early"])

    rows = texts.select("text").mapInArrow(prefixes, "shingle long, tagged long")
    return rows.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(shared, "shingle long, node long, early boolean")


def _candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes and may have the similarity, as far
    as their sizes and parities tell."""
    spare = 1 - 2 * similarity / (1 + similarity)  # of both sizes' sum, members that only one set has
    columns = ["shingle", "n", "node", "comp", "early", *_PARITY]

    def run(batches):
        for shingle, n, node, comp, early, *parity in _whole_groups(batches, columns):
            n, parity = n.astype(np.int64), np.stack(parity, 1).view(np.uint64)
            edge = _edges(shingle)
            mixed = np.minimum.reduceat(comp, edge) != np.maximum.reduceat(comp, edge)
            left = np.flatnonzero(np.repeat(mixed, np.diff(np.append(edge, len(shingle)))) & early.astype(bool))
            found, total, d = [], 0, 0
            while True:
                d += 1
                left = left[left + d < len(shingle)]
                # sizes rise within a shingle: a row too small for the one d further is too small for all beyond
                left = left[(shingle[left + d] == shingle[left]) & (n[left] >= similarity * n[left + d] - 1e-6)]
                if not len(left):
                    break
                a = left[comp[left] != comp[left + d]]
                unlike = np.bitwise_count(parity[a] ^ parity[a + d]).sum(axis=1, dtype=np.int64)
                a = a[unlike <= spare * (n[a] + n[a + d]) + 1e-6]
                if len(a):
                    found.append(np.stack([np.minimum(node[a], node[a + d]), np.maximum(node[a], node[a + d])]))
                    total += len(a)
                if total > GROUPED:
                    found, total = [np.unique(np.concatenate(found, axis=1), axis=1)], 0
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    # equal sizes in one order everywhere, so that a pair has the same smaller set under all its shingles
    return rows.select(*columns).repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(run, "a long, b long").distinct()


def missed_pairs(texts: DataFrame, nodes: DataFrame, roots: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that may have the similarity and that the roots (node, root) do not join yet. Every such pair
    of at least the similarity is among them."""
    of = nodes.select("node", "n", *_PARITY).join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    return _candidates(_shared_shingles(texts, common, size, similarity).join(of, "node"), similarity)


def _own(doc_id, text_md5):
    """A row's name: rows of one id and text share it."""
    return F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), text_md5))


def _may_match(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows with ``_may``: true for all whose ``own`` is one of the n keys, and for one in sixteen others at most. The
    keys are a broadcast bitmap of 16 to 32 bits each, in pieces of 4 kB."""
    size = 1 << max(15, (16 * n - 1).bit_length())
    at = F.pmod(F.xxhash64("own"), F.lit(size))
    piece, place = F.floor(at / 32768).cast("long"), at % 32768
    bits = keys.select(piece.alias("_piece"), place.alias("_place")).groupBy("_piece").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return docs.withColumn("_piece", piece).join(F.broadcast(bits), "_piece", "left").withColumn("_may", F.coalesce(may, F.lit(False))).drop("_piece", "_bits")


def _by_own(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows joined by ``own``. More than MOST_KEYS keys meet the rows in a shuffle, which only rows enter that may match."""
    n = keys.count()
    if n <= MOST_KEYS:
        return docs.join(F.broadcast(keys), "own", how)
    marked = _may_match(docs, keys, n)
    met = marked.where("_may").drop("_may").join(keys, "own", how)
    return marked.where("NOT _may").drop("_may").unionByName(met) if how == "left_anti" else met


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, but of each group of near copies only the one of the smallest id (null ids last,
    then the smallest md5 of text); of repeated rows one stays. Texts of the same distinct shingles are one node; ball
    hashing of signatures brings most near copies together, prefixes of shingles all others, and every link is
    confirmed. Null text counts as empty, and empty texts are copies of one another."""
    row = F.struct(*docs.columns).alias("row")  # so that no column's name clashes
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(_own(docs["doc_id"], F.md5(text)).alias("own"), row)
    texts = docs.select(_own(docs["doc_id"], F.md5(text)).alias("own"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["node", *_SIGNED, *_PARITY]

    def run(batches):
        for b in batches:
            n, out = [], []
            for x in b["text"]:
                own = shingle_hashes(x.as_buffer().to_pybytes(), size)
                n.append(len(own))
                out.append(np.concatenate([np.array([node_of(own)], np.uint64), _signed(own), _parity(own)]))
            table = np.array(out, np.uint64).reshape(len(out), len(numbers)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_md5"], pa.array(n, pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], ["doc_id", "text_md5", "n", *numbers])

    signed = docs.select("doc_id", F.md5(text).alias("text_md5"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_md5 string, n int, " + ", ".join(f"{c} long" for c in numbers))
    prints = C.written(signed.groupBy("doc_id", "text_md5", "node").agg(F.count("*").alias("n_rows"), *(F.first(c).alias(c) for c in ("n", *numbers[1:]))), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    nodes = prints.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", *numbers[1:])), F.min(order).alias("first"))
    nodes = C.written(nodes.withColumn("own", _own(F.col("first.doc_id"), F.col("first.text_md5"))), "nodes")
    met = C.written(similar_links(near_pairs(nodes, expected_bits(similarity, SLACK)), nodes, texts, size, similarity), "met")
    likely = likely_pairs(missed_pairs(texts, nodes, connected(met), common_shingles(texts, size), size, similarity), nodes, texts, size, similarity)
    missed = similar_links(likely, nodes, texts, size, similarity)
    roots = connected(met.union(missed))
    rooted = nodes.select("node", "first").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    winners = rooted.groupBy("root").agg(F.min("first").alias("won"))
    winner_of = rooted.join(winners, "root").select("node", _own(F.col("won.doc_id"), F.col("won.text_md5")).alias("won"))
    judged = C.written(prints.select("node", "n_rows", _own(F.col("doc_id"), F.col("text_md5")).alias("own")).join(winner_of, "node"), "judged")
    kept = _by_own(rows, judged.where("own <> won").select("own"), "left_anti")
    again = judged.where("own = won AND n_rows > 1").select("own")
    if not again.isEmpty():
        kept = _by_own(kept, again, "left_anti").union(_by_own(kept, again, "left_semi").dropDuplicates(["own"]))
    return kept.select("row.*")
