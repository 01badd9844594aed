"""Periodic runs of words: Kolpakov and Kucherov's algorithm.

A run is a stretch of words with smallest period q, at least ``exponent`` times as long as q, that no neighbouring word
extends. Each word of a run begins or lies in a triple of words that the document holds several times; other words end
a segment, which leaves most documents without any. In what is left, a suffix automaton gives the Lempel-Ziv factors:
each is the longest stretch that begins earlier, or a new word. Main's algorithm finds the runs that cross or touch a
border between factors, from the longest common extensions on both sides; runs inside a factor are copied from the
factor's earlier occurrence. All steps take time in proportion to the words.

A document is handled in one task, whole, in memory in proportion to it (about 250 bytes for each word of its longest
segment). Null and empty texts have no words and no runs. Repeated rows, null ids and extra columns are handled row by
row; an empty table gives an empty result. Words are compared as bytes, hashes only choose the segments.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C

#: Words in a gram of the pruning step.
GRAM = 3


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start or -1) of the Lempel-Ziv factors, from the suffix automaton of the whole word.

    A state has its first edge in two arrays, as most have one only, and the others in a dictionary."""
    size, link, first, letter, target = (array("i", [x]) for x in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    none: dict[int, int] = {}
    last = 0
    for i, c in enumerate(word):
        new = len(size)
        for column, x in ((size, size[last] + 1), (link, 0), (first, i), (letter, -1), (target, -1)):
            column.append(x)
        p, to = last, -1
        while p >= 0:
            to = target[p] if letter[p] == c else more.get(p, none).get(c, -1)
            if to >= 0:
                break
            if letter[p] < 0:
                letter[p], target[p] = c, new
            else:
                more.setdefault(p, {})[c] = new
            p = link[p]
        if p >= 0 and size[p] + 1 == size[to]:
            link[new] = to
        elif p >= 0:
            clone = len(size)
            for column, x in ((size, size[p] + 1), (link, link[to]), (first, first[to]), (letter, letter[to]), (target, target[to])):
                column.append(x)
            if to in more:
                more[clone] = dict(more[to])
            while p >= 0 and (target[p] if letter[p] == c else more.get(p, none).get(c, -1)) == to:
                if letter[p] == c:
                    target[p] = clone
                else:
                    more[p][c] = clone
                p = link[p]
            link[to] = link[new] = clone
        last = new
    out, begin = [], 0
    while begin < len(word):
        state, end = 0, begin
        while end < len(word):
            c = word[end]
            to = target[state] if letter[state] == c else more.get(state, none).get(c, -1)
            if to < 0 or first[to] >= end:  # this stretch occurs here for the first time
                break
            state, end = to, end + 1
        out.append((begin, max(1, end - begin), first[state] - (end - begin) + 1 if end > begin else -1))
        begin = max(end, begin + 1)
    return out


def _z(s: list[int]) -> list[int]:
    """How long s and its rest from each place agree."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs(word: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` letters and ``exponent`` (2 or more) periods, in order
    of start and period."""
    n = len(word)
    found: dict[tuple[int, int], int] = {}  # by both ends: the smallest period

    def keep(i: int, j: int, q: int, begin: int, end: int) -> None:
        """The stretch from i to before j of period q, seen between begin and end, unless it goes on beyond."""
        if j - i < max(least, exponent * q) or i == begin > 0 and word[i - 1] == word[i - 1 + q] or j == end < n and word[j] == word[j - q]:
            return
        if found.get((i, j), q) >= q:
            found[i, j] = q

    parts = factors(word)
    before = 0
    for p, m, _ in parts:
        end = p + m
        most = (m + before - 1) // (exponent - 1)  # a run that crosses p and ends in this factor begins less than a period before the last factor
        if most > 0:
            width = min(p, before + most)
            begin = p - width
            left, right = word[begin:p], word[p:end]
            back = left[::-1]
            ahead, behind = min(most, m - 1), min(most, width)
            same = _z(right)  # to the right of p and of p + q
            z = _z([*back, -1, *right[:ahead][::-1], *back])  # to the left of p and of p + q
            for q in range(1, ahead + 1):
                keep(p - min(z[width + 1 + ahead - q], width), p + q + same[q], q, begin, end)
            if behind:
                same = _z(back)  # to the left of p and of p - q
                z = _z([*right, -1, *left[width - behind :], *right])  # to the right of p and of p - q
                for q in range(1, behind + 1):
                    if r := min(z[m + 1 + behind - q], m):
                        keep(p - q - (same[q] if q < width else 0), p + r, q, begin, end)
        if m >= least:  # runs that begin inside this factor and touch its end
            same = _z(word[p:end][::-1])
            for q in range(1, m // exponent + 1):
                if q + same[q] < m:
                    keep(end - q - same[q], end, q, p, end)
        before = m
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (i, j), q in found.items():
        by_start.setdefault(i, []).append((j, q))
    for p, m, earlier in parts:
        if earlier < 0 or not by_start:
            continue
        for i in range(1, m - least):  # runs strictly inside the factor: as in its earlier occurrence, from left to right
            for j, q in by_start.get(earlier + i, ()):
                if j < earlier + m:
                    by_start.setdefault(p + i, []).append((j - earlier + p, q))
    return sorted((i, j - i, q) for i, ends in by_start.items() for j, q in ends)


def _repeats(least: int, exponent: int) -> int:
    """How often each gram of a run occurs at least inside it."""
    return min((max(least, exponent * q) - GRAM + 1) // q for q in range(1, max(least, GRAM) + 1))


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches of words [first, last) outside which no run has a word. A segment's own grams are counted again, until
    none is lost."""
    times = _repeats(least, exponent)
    if not len(starts):
        return []
    whole = np.flatnonzero(np.diff(doc, prepend=-1))
    spans = np.column_stack([whole, np.append(whole[1:], len(doc))])
    if times < 2 or least < GRAM:
        return [(int(a), int(b)) for a, b in spans if b - a >= least]
    words = C.word_hashes(raw, starts, ends)
    home = np.zeros(len(words), np.int64)
    while True:
        spans = spans[spans[:, 1] - spans[:, 0] >= least]
        if not len(spans):
            return []
        home[:] = 0
        edge = np.zeros(len(words) + 1, np.int64)
        edge[spans[:, 0]] += np.arange(1, len(spans) + 1)
        edge[spans[:, 1]] -= np.arange(1, len(spans) + 1)
        home = np.cumsum(edge[:-1])
        first = np.flatnonzero((home[GRAM - 1 :] == home[: len(home) - GRAM + 1]) & (home[: len(home) - GRAM + 1] > 0))
        key = C.mix(C.spans_hash(words, first, first + GRAM, C.WINDOW_POWERS) + home[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        often = first[count[group] >= times]
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, often, 1)
        np.add.at(mark, often + GRAM, -1)
        covered = np.cumsum(mark[:-1]) > 0
        step = np.diff(np.concatenate([[0], np.where(covered, home, 0), [0]]))
        held = np.concatenate([[0], np.where(covered, home, 0), [0]])
        cut = np.flatnonzero(step)
        kept = np.column_stack([cut[:-1], cut[1:]])
        kept = kept[held[cut[:-1] + 1] > 0] if len(kept) else kept
        if len(kept) == len(spans) and (kept == spans).all():
            return [(int(a), int(b)) for a, b in kept]
        spans = kept


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed: the words, joined by
    a space, without those that a run repeats (all of a run but its first period)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.buffer_of(batch.column(1))
            for lo, hi in C.chunks(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, doc = C.word_spans(part, at, C.SPACE)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                found: dict[int, list[tuple[int, int, int]]] = {}
                for a, b in segments(part, starts, ends, doc, least, exponent):
                    number: dict[bytes, int] = {}
                    word = [number.setdefault(part[s:e].tobytes(), len(number)) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    if own := runs(word, least, exponent):
                        d = int(doc[a])
                        found.setdefault(d, []).extend((i + a - int(first[d]), length, q) for i, length, q in own)
                lists, texts = [], []
                for d in range(hi - lo):
                    words = part[at[d] : at[d + 1]].tobytes().split()
                    if own := found.get(d):
                        edge = np.zeros(len(words) + 1, np.int64)
                        for i, length, q in own:
                            edge[i + q] += 1
                            edge[i + length] -= 1
                        words = [w for w, gone in zip(words, (np.cumsum(edge) > 0).tolist()) if not gone]
                    lists.append([{"start": i, "length": length, "period": q} for i, length, q in sorted(own or (), key=lambda r: (r[0], r[2]))])
                    texts.append(b" ".join(words).decode())
                counts = pa.array(np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), counts, pa.array(lists, pa.list_(run)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found: Column) -> Column:
    """The run of greatest length, of those the first, of those the one of the smallest period; null if there is none."""
    best = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents; in a tenth of them, by the id's CRC-32, the words from some place on repeat the
    first ones there with a period. Words are then joined by a space."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", (F.col("g") % F.nullif(F.col("n"), F.lit(0))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    periodic = F.concat(F.slice("words", 1, F.col("a")), F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)))
    return rows.select("doc_id", F.when((F.col("n") > 0) & (F.col("h") % 10 == 0), F.array_join(F.slice(periodic, 1, F.col("n")), " ")).otherwise(F.col("text")).alias("text"))
