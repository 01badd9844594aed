"""Suffix-array dedup of bytes: deep-shallow sorting of the suffixes that may be repeated.

Every string of ``length`` bytes has an anchor: the leftmost smallest hash among its ``GRAM``-byte grams. Equal strings
have equal anchors at equal offsets, so only suffixes of one anchor need to be sorted together. Consecutive starts
with one anchor make a slice of the text.

1. Blocks of documents send anchor and slice hashes (a few for each thousand bytes), by ranges of the anchor's hash.
2. Anchors that occur once anywhere are done. For the others, the first block that holds a slice sends its bytes;
   further copies of it are only counted.
3. For each anchor, the suffixes of its slices are sorted deep-shallow: multikey quicksort by 8-byte characters to a
   shallow depth, then blind tries: the rest of a group is compared with one suffix, and each leaves that suffix's path
   where it first differs, so that only branching characters are sorted. Suffixes that end on one leaf after ``length``
   bytes are repeated.
4. The blocks take the repeated starts of their slices and remove every byte they cover.

An anchor with more than ``HOT_SLICES`` unlike slices would fill one task; the strings of such slices are dealt out by
their own 128-bit hashes instead and counted, without loss.

If shorter repeats are asked for (``passage``), anchors and slices are those of strings of ``passage`` bytes, and a slice
reaches on to the end of its last string of ``length`` bytes or of its document. Its suffixes are sorted to ``passage``
bytes, and those found repeated, with enough text behind them, once more to ``length``. Only the latter are removed.

Null text counts as empty. Texts shorter than ``length`` lose nothing. Repeated rows count as separate documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C

GRAM = 32
SHALLOW = 16
BLOCK_BYTES = 8_000_000
HOT_SLICES = 20_000
#: Bytes of documents whose slices are found at once (some 150 bytes of memory each).
CHUNK = 1_000_000
#: Suffixes sorted at once.
SUFFIXES = 500_000
_GRAM_POWERS = C.Powers(0x9E3779B97F4A7C15 | 1)
_SLICE_POWERS = C.Powers(0xC2B2AE3D27D4EB4F)
_SECOND_POWERS = C.Powers(0x165667B19E3779F9)


class Slices:
    """The slices of some documents, of the starts of strings of ``short`` bytes: first and last start, end of the bytes
    that strings of ``length`` bytes from these starts reach, anchor and two hashes, in the order of the text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, short: int, length: int):
        self.raw = raw
        self.value = C.BYTE_VALUE[raw]
        none = np.zeros(0, np.int64)
        self.first = self.last = self.end = self.anchor = none
        self.key = self.own = np.zeros(0, np.uint64)
        starts = np.concatenate([np.arange(a, b - short + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= short] or [none])
        if not len(starts):
            return
        at = np.arange(len(raw) - GRAM + 1)
        grams = C.mix(C.spans_hash(self.value, at, at + GRAM, _GRAM_POWERS))
        width = short - GRAM + 1
        low = np.full(-(-(len(grams) + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        low[: len(grams)] = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        table = low.reshape(-1, width)
        upto = np.minimum.accumulate(table, axis=1).ravel()
        since = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(since[starts], upto[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.first, self.anchor = starts[new], anchor[new]
        self.last = starts[np.append(new[1:], len(starts)) - 1]
        self.end = np.minimum(self.last + length, offsets[np.searchsorted(offsets, self.first, "right")])
        self.key = C.mix(grams[self.anchor])
        whole = C.spans_hash(self.value, self.first, self.end, _SLICE_POWERS)
        self.own = C.mix(C.mix(whole + (self.last - self.first).astype(np.uint64)) + (self.anchor - self.first).astype(np.uint64))

    def strings(self, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings of ``size`` bytes of some slices, and two hashes of each."""
        n = np.maximum(np.minimum(self.last[which], self.end[which] - size) - self.first[which] + 1, 0)
        at = np.repeat(self.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at, *(C.mix(C.spans_hash(self.value, at, at + size, p)) for p in (_SLICE_POWERS, _SECOND_POWERS))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the first counts most), and the number of each row's group in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def _found(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where each key of a stands in b (whose keys are unlike), or -1."""
    n = len(a[0])
    order, group = _groups(*(np.concatenate([x, y]) for x, y in zip(a, b)))
    place = np.full(int(group[-1]) + 1 if len(group) else 0, -1, np.int64)
    of = np.empty(len(order), np.int64)
    of[order] = group
    place[of[n:]] = np.arange(len(b[0]))
    return place[of[:n]]


def deep_shallow(data: np.ndarray, at: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Which of the suffixes of ``data`` at ``at`` share their first ``length`` bytes with another of their group, or
    have a weight over 1. ``data`` reaches 8 bytes beyond the last suffix's end."""
    repeated = weight > 1
    wide = data.astype(np.uint64)
    for half in (1, 2, 4):
        wide = (wide[:-half] << np.uint64(8 * half)) | wide[half:]
    steps = -(-length // 8)
    tail = np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 * steps - length))) & 0xFFFFFFFFFFFFFFFF)

    def crowded(row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of groups with at least two; groups stand together."""
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        size = np.diff(np.append(edge, len(of)))
        keep = np.repeat(size > 1, size)
        return row[keep], np.repeat(np.arange(len(size)), size)[keep]

    order = np.argsort(group, kind="stable")
    row, of = crowded(order, group[order])
    depth = 0
    while depth < min(shallow // 8, steps - 1) and len(row):  # multikey quicksort
        order, new = _groups(of, wide[at[row] + 8 * depth])
        row, of = crowded(row[order], new)
        depth += 1
    character = np.arange(depth, steps) * 8
    while len(row):  # blind tries
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        head = np.repeat(row[edge], np.diff(np.append(edge, len(row))))
        differs, branch = np.empty(len(row), np.int64), np.zeros(len(row), np.uint64)
        for lo in range(0, len(row), 16_384):
            mine, path = (wide[at[r[lo : lo + 16_384]][:, None] + character] for r in (row, head))
            if length % 8:
                mine[:, -1] &= tail
                path[:, -1] &= tail
            unlike = mine != path
            where = np.where(unlike.any(axis=1), unlike.argmax(axis=1), len(character))
            differs[lo : lo + 16_384] = where
            inside = where < len(character)
            branch[lo : lo + 16_384][inside] = mine[inside, where[inside]]
        leaf = differs == len(character)
        of_leaf = of[leaf]
        full = np.bincount(of_leaf, minlength=of[-1] + 1)[of_leaf] > 1
        repeated[row[leaf][full]] = True
        row, of, differs, branch = (x[~leaf] for x in (row, of, differs, branch))
        order, new = _groups(of, differs, branch)
        row, of = crowded(row[order], new)
    return repeated


ANCHORS = "part int, block int, keys binary, owns binary, twice binary, hot int"
SLICES = "part int, key long, own long, twice boolean, offset int, starts int, data binary"
FOUND = "block int, kind int, keys binary, owns binary, counts binary, spans binary"
#: Kinds of rows in FOUND: slices to send, anchors that are hot, slices repeated throughout, slices with starts of repeated
#: strings of ``length`` bytes, the same of ``passage`` bytes, strings.
SEND, HOT, ALL, SOME, SHORT, STRINGS = range(6)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names.split(", ")])
    return pa.Table.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)


def _numbers(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(data, kind)


def _by_part(block: int, key: np.ndarray, own: np.ndarray, parts: int, hot: int) -> list[tuple]:
    """Unlike (key, own) pairs as one row for each part, with whether a pair stands twice in the block."""
    order, group = _groups(key, own)
    if not len(order):
        return []
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    twice = np.diff(np.append(edge, len(group))) > 1
    key, own = key[order][edge], own[order][edge]
    cut = np.searchsorted(_part(key, parts), np.arange(parts + 1))
    return [(p, block, key[a:b].tobytes(), own[a:b].tobytes(), twice[a:b].tobytes(), hot) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


def _per_block(block: np.ndarray, kind: int, key: np.ndarray, own: np.ndarray, count: np.ndarray | None = None, spans: np.ndarray | None = None) -> list[tuple]:
    """FOUND rows, one for each block."""
    order = np.argsort(block, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])) if len(order) else order
    out = []
    first = np.cumsum(count) - count if count is not None else None
    for mine in np.split(order, edge[1:]) if len(order) else []:
        own_spans = b""
        if count is not None:
            n = count[mine]
            own_spans = spans[np.repeat(first[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype("<i4").tobytes()
        out.append((int(block[mine[0]]), kind, key[mine].tobytes(), own[mine].tobytes(), count[mine].astype("<i4").tobytes() if count is not None else b"", own_spans))
    return out


class _Told:
    """FOUND rows of one block."""

    def __init__(self, table: pa.Table):
        self.rows: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            self.rows.setdefault(r["kind"], []).append(r)

    def pairs(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.zeros(0, np.uint64), *(_numbers(r[c]) for r in self.rows.get(kind, ()))]) for c in ("keys", "owns"))

    def twice(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(_numbers(r["counts"], "<i4") for r in self.rows.get(kind, ()))])

    def spans(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros((0, 2), np.int32), *(_numbers(r["spans"], "<i4").reshape(-1, 2) for r in self.rows.get(kind, ()))])


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def suffix_dedup(docs: DataFrame, length: int = 400, keep_text: bool = False, hot_slices: int = HOT_SLICES, block_bytes: int = BLOCK_BYTES, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (lowercase hex of the remaining bytes),
    spans ([start, end) in bytes) and, if asked for, kept_text (bytes cut inside a character drop out).

    With ``passage`` (from GRAM to ``length``) also n_repeated and repeated: bytes and runs covered by strings of
    ``passage`` bytes that also start anywhere else. They are told, not removed."""
    short = length if passage is None else passage
    if not GRAM <= short <= length:
        raise ValueError(f"strings have {GRAM} bytes at least, passages {length} at most")
    sizes = sorted({short, length})
    docs = docs.select("doc_id", "text")
    n_bytes = C.text_bytes(docs)
    n_blocks, parts = max(8, -(-n_bytes // block_bytes)), max(8, -(-n_bytes // (2 * block_bytes)))
    blocks = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))

    def slices_of(table: pa.Table):
        raw, offsets = C.buffer_of(table["text"])
        for lo, hi in C.chunks(offsets, CHUNK):
            yield lo, hi, Slices(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], short, length)

    def send_anchors(table: pa.Table) -> pa.Table:
        found = [(s.key, s.own) for _, _, s in slices_of(table)]
        key, own = (np.concatenate(x) for x in zip(*found))
        return _rows(_by_part(table["block"][0].as_py(), key, own, parts, 0), ANCHORS)

    def gathered(table: pa.Table):
        """All anchors of one part: key, own, twice, block; their order by key and own, groups of both, groups of key."""
        rows = table.to_pylist()
        key, own = (np.concatenate([_numbers(r[c]) for r in rows]) for c in ("keys", "owns"))
        twice = np.concatenate([_numbers(r["twice"], bool) for r in rows])
        block = np.repeat([r["block"] for r in rows], [len(r["keys"]) // 8 for r in rows])
        order, pair = _groups(key, own)
        key, own, twice, block = key[order], own[order], twice[order], block[order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        total = np.add.reduceat(1 + twice.astype(np.int64), edge)  # occurrences of each slice, or at least two
        anchor = np.cumsum(np.concatenate([[False], key[edge][1:] != key[edge][:-1]]))
        unlike, occurs = np.bincount(anchor), np.bincount(anchor, total)
        return key, own, block, pair, edge, total > 1, unlike[anchor], occurs[anchor] > 1

    def choose(table: pa.Table) -> pa.Table:
        key, own, block, pair, edge, twice, unlike, wanted = gathered(table)
        first = np.minimum.reduceat(block, edge)
        some = np.flatnonzero(wanted & (unlike > 1) & (unlike <= hot_slices))
        out = _per_block(first[some], SEND, key[edge[some]], own[edge[some]], twice[some].astype(np.int64), np.zeros(len(some), np.int64))
        hot = np.flatnonzero((wanted & (unlike > hot_slices))[pair])
        return _rows(out + _per_block(block[hot], HOT, key[hot], own[hot]), FOUND)

    def send_slices(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows:
            return _rows([], SLICES)
        told = _Told(found)
        wanted, twice = told.pairs(SEND), told.twice(SEND)
        sent = np.zeros(len(wanted[0]), bool)
        out = []
        for _, _, s in slices_of(texts):
            which = _found((s.key, s.own), wanted)
            for i in np.flatnonzero(which >= 0):
                w = which[i]
                if not sent[w]:
                    sent[w] = True
                    out.append((int(_part(s.key[i : i + 1], parts)[0]), int(s.key[i : i + 1].view(np.int64)[0]), int(s.own[i : i + 1].view(np.int64)[0]), bool(twice[w]), int(s.anchor[i] - s.first[i]), int(s.last[i] - s.first[i] + 1), s.raw[s.first[i] : s.end[i]].tobytes()))
        return _rows(out, SLICES)

    def sort_slices(slices: pa.Table, anchors: pa.Table) -> pa.Table:
        key, own, block, pair, edge, twice, unlike, wanted = gathered(anchors)
        every = np.flatnonzero((wanted & twice & (unlike == 1))[pair])
        out = _per_block(block[every], ALL, key[every], own[every])
        if slices.num_rows:
            slices = slices.sort_by("key")
            keys, owns = (slices[c].to_numpy().view(np.uint64) for c in ("key", "own"))
            weight = 1 + slices["twice"].to_numpy().astype(np.int64)
            offset = slices["offset"].to_numpy().astype(np.int64)
            raw, at = C.buffer_of(slices["data"])
            raw = np.concatenate([raw, np.zeros(16, np.uint8)])
            n = slices["starts"].to_numpy().astype(np.int64)
            spans, counts = {k: [] for k in sizes}, {k: np.zeros(len(n), np.int64) for k in sizes}
            lo = 0
            while lo < len(n):  # whole anchors, as many as fit
                end = np.searchsorted(np.cumsum(n[lo:]), SUFFIXES) + lo
                hi = int(np.searchsorted(keys, keys[min(end, len(n) - 1)]))
                hi = hi if hi > lo else int(np.searchsorted(keys, keys[lo], "right"))
                m = n[lo:hi]
                repeated = {k: np.zeros(m.sum(), bool) for k in sizes}
                which = np.repeat(np.arange(hi - lo), m)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                left = np.diff(at)[lo:hi][which] - inner  # bytes of the slice from the start
                before = offset[lo:hi][which] - inner  # bytes from the start to the anchor: equal strings agree
                for a in range(0, short, max(1, short * SUFFIXES // max(len(which), 1))) if len(which) > SUFFIXES else (0,):
                    b = a + max(1, short * SUFFIXES // max(len(which), 1)) if len(which) > SUFFIXES else short
                    mine = np.flatnonzero((before >= a) & (before < b))
                    group = np.cumsum(np.concatenate([[0], keys[lo:hi][1:] != keys[lo:hi][:-1]]))[which] * short + before
                    base = int(at[lo])
                    for size in sizes:  # what is repeated for more bytes is repeated for fewer
                        mine = mine[left[mine] >= size]
                        repeated[size][mine] = deep_shallow(raw[base : int(at[hi]) + 16], at[lo:hi][which[mine]] - base + inner[mine], group[mine], weight[lo:hi][which[mine]], size)
                        mine = mine[repeated[size][mine]]
                edge = np.append(np.flatnonzero(inner == 0), len(inner))
                for size in sizes:
                    begin, stop = _runs(repeated[size])
                    cut = edge[1:-1][repeated[size][edge[1:-1]] & repeated[size][edge[1:-1] - 1]]  # runs end with their slice
                    begin, stop = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([stop, cut]))
                    of = which[begin]
                    counts[size][lo:hi] = np.bincount(of, minlength=hi - lo)
                    spans[size].append(np.stack([inner[begin], inner[begin] + stop - begin], 1))
                lo = hi
            mine = _found((key, own), (keys, owns))  # every block that holds the slice is told
            for size in sizes:
                count = counts[size]
                first = np.cumsum(count) - count
                hit = np.flatnonzero(mine >= 0)
                hit = hit[count[mine[hit]] > 0]
                c = count[mine[hit]]
                rows = np.repeat(first[mine[hit]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                out += _per_block(block[hit], SOME if size == length else SHORT, key[hit], own[hit], c, np.concatenate(spans[size])[rows])
        return _rows(out, FOUND)

    def send_strings(texts: pa.Table, found: pa.Table) -> pa.Table:
        hot = _Told(found).pairs(HOT)
        if not len(hot[0]):
            return _rows([], ANCHORS)
        every = []
        for _, _, s in slices_of(texts):
            every += [s.strings(np.flatnonzero(_found((s.key, s.own), hot) >= 0), size)[1:] for size in sizes]
        return _rows(_by_part(texts["block"][0].as_py(), *(np.concatenate(x) for x in zip(*every)), parts, 1), ANCHORS)

    def count_strings(table: pa.Table) -> pa.Table:
        key, own, block, pair, edge, twice, _, _ = gathered(table)
        hit = np.flatnonzero(twice[pair])
        return _rows(_per_block(block[hit], STRINGS, key[hit], own[hit]), FOUND)

    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString(), None), ("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string()), ("spans", "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    if passage is not None:
        fields += [("n_repeated", *fields[2][1:]), ("repeated", *fields[5][1:])]
    if keep_text:
        fields.append(("kept_text", "string", pa.string()))

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        told = _Told(found)
        every, hot, strings = (told.pairs(k) for k in (ALL, HOT, STRINGS))
        some = {}
        for size, kind in ((short, SHORT), (length, SOME)):
            counts = told.twice(kind).astype(np.int64)
            some[size] = told.pairs(kind), counts, np.cumsum(counts) - counts, told.spans(kind).astype(np.int64)
        offsets = C.buffer_of(texts["text"])[1]
        cols = {n: [] for n, _, _ in fields[1:]}

        def covered(s: Slices, size: int) -> np.ndarray:
            """Which bytes stand in repeated strings of this size."""
            pairs, counts, first_span, spans = some[size]
            edge = np.zeros(len(s.raw) + 1, np.int64)
            mine = np.flatnonzero((_found((s.key, s.own), every) >= 0) & (s.end - s.first >= size))
            np.add.at(edge, s.first[mine], 1)
            np.add.at(edge, np.minimum(s.last[mine] + size, s.end[mine]), -1)
            where = _found((s.key, s.own), pairs)
            mine = np.flatnonzero(where >= 0)
            c = counts[where[mine]]
            rows = np.repeat(first_span[where[mine]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            begin = np.repeat(s.first[mine], c)
            np.add.at(edge, begin + spans[rows, 0], 1)
            np.add.at(edge, begin + spans[rows, 1] - 1 + size, -1)
            if len(hot[0]):
                at, a, b = s.strings(np.flatnonzero(_found((s.key, s.own), hot) >= 0), size)
                at = at[_found((a, b), strings) >= 0]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
            return np.cumsum(edge[:-1]) > 0

        def runs_of(inside: np.ndarray) -> list[dict]:
            return [{"start": int(x), "end": int(y)} for x, y in zip(*_runs(inside))] if inside.any() else []

        for lo, hi, s in slices_of(texts):
            gone = covered(s, length)
            again = covered(s, short) if passage is not None else gone
            for i in range(lo, hi):
                a, b = offsets[i] - offsets[lo], offsets[i + 1] - offsets[lo]
                lost = gone[a:b]
                runs = runs_of(lost)
                kept = (s.raw[a:b][~lost] if runs else s.raw[a:b]).tobytes()
                cols["n_bytes"].append(int(b - a))
                cols["n_removed"].append(int(lost.sum()))
                cols["n_spans"].append(len(runs))
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                cols["spans"].append(runs)
                if passage is not None:
                    cols["n_repeated"].append(int(again[a:b].sum()))
                    cols["repeated"].append(runs_of(again[a:b]))
                if keep_text:
                    cols["kept_text"].append(kept.decode(errors="ignore"))
        return pa.table([texts["doc_id"].combine_chunks() if texts.num_rows else texts["doc_id"], *(pa.array(cols[n], t) for n, _, t in fields[1:])], [n for n, _, _ in fields])

    anchors = blocks.groupBy("block").applyInArrow(send_anchors, ANCHORS)
    chosen = anchors.groupBy("part").applyInArrow(choose, FOUND)
    slices = blocks.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(send_slices, SLICES)
    sorted_ = slices.groupBy("part").cogroup(anchors.groupBy("part")).applyInArrow(sort_slices, FOUND)
    hot = chosen.where(F.col("kind") == HOT)
    strings = blocks.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(send_strings, ANCHORS).groupBy("part").applyInArrow(count_strings, FOUND)
    found = sorted_.union(hot).union(strings)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, ", ".join(f"{n} {t}" for n, t, _ in fields))
