"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

Documents are dealt into blocks by a hash of id and text. Each block sends its sorted window hashes, split by hash
range and delta coded, to the range's task. That task counts in how many blocks a hash occurs and returns the
repeated ones to the blocks, which hold the texts (Spark reuses that exchange) and merge repeated windows into
maximal removal intervals. A hash has 64 bits and, beside it, 8 bits of a second polynomial.

Null or empty text: no words, nothing removed. Repeated rows count as separate documents, so that windows of a
document that stands twice are repeated. Null ids are allowed. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C

BLOCK_BYTES = 8_000_000
RANGE_BYTES = 16_000_000


def _windows(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Window hashes and checks of some documents; also where each window starts among their words, and words' documents."""
    starts, ends, doc = C.word_spans(raw, offsets, C.SPACE)
    if len(starts) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64), doc
    words = C.word_hashes(raw, starts, ends)
    first = np.flatnonzero(doc[length - 1 :] == doc[: len(doc) - length + 1])
    key = C.mix(C.spans_hash(words, first, first + length, C.WINDOW_POWERS))
    check = (C.mix(C.spans_hash(words, first, first + length, C.CHECK_POWERS)) >> np.uint64(56)).astype(np.uint8)
    return key, check, first, doc


def _sorted(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, check), and whether each differs from the one before it."""
    order = np.argsort(key)
    key, check = key[order], check[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same) and (check[same] != check[same + 1]).any():
        by = np.lexsort((check, key))
        order, key, check = order[by], key[by], check[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    return order, new, key


_BLOBS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary())])
BLOBS = "part int, block int, first long, width int, keys binary, checks binary"


def _blob(part: int, block: int, key: np.ndarray, check: np.ndarray) -> tuple:
    width, data = C.packed(key)
    return part, block, int(key[:1].view(np.int64)[0]), width, data, check.tobytes()


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(_BLOBS)}, _BLOBS)


def substring_dedup(docs: DataFrame, length: int = 35, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (lowercase hex of the kept words joined by a space), spans (the
    maximal removed intervals as [start, end) in words) and, if asked for, kept_text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_bytes = C.text_bytes(docs)
    n_blocks, n_parts = max(8, -(-n_bytes // BLOCK_BYTES)), max(8, -(-n_bytes // RANGE_BYTES))
    blocks = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))

    def send(table: pa.Table) -> pa.Table:
        raw, offsets = C.buffer_of(table["text"])
        keys, checks = [], []
        for lo, hi in C.chunks(offsets):
            k, c, _, _ = _windows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
            keys.append(k)
            checks.append(c)
        key, check = np.concatenate(keys), np.concatenate(checks)
        order, new, key = _sorted(key, check)
        key, check = key[new], check[order][new]
        part = ((key >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(n_parts + 1))
        block = table["block"][0].as_py()
        return _table([_blob(p, block, key[a:b], check[a:b]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a])

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [C.unpacked(r["first"], r["width"], r["keys"]) for r in rows]
        checks = [np.frombuffer(r["checks"], np.uint8) for r in rows]
        order, new, _ = _sorted(np.concatenate(keys), np.concatenate(checks))
        group = np.cumsum(new) - 1
        repeated = np.zeros(len(order), bool)
        repeated[order] = np.bincount(group)[group] > 1
        out, at = [], 0
        for r, key, check in zip(rows, keys, checks):
            mine = repeated[at : at + len(key)]
            at += len(key)
            if mine.any():
                out.append(_blob(r["part"], r["block"], key[mine], check[mine]))
        return _table(out)

    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString(), None), ("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256", "string", pa.string()), ("spans", "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    if keep_text:
        fields.append(("kept_text", "string", pa.string()))

    def remove(texts: pa.Table, flags: pa.Table) -> pa.Table:
        flags = flags.sort_by("part").to_pylist()
        far = np.concatenate([C.unpacked(r["first"], r["width"], r["keys"]) for r in flags]) if flags else np.zeros(0, np.uint64)
        far_check = np.concatenate([np.frombuffer(r["checks"], np.uint8) for r in flags]) if flags else np.zeros(0, np.uint8)
        raw, offsets = C.buffer_of(texts["text"])
        found = [_windows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length) for lo, hi in C.chunks(offsets)]
        keys, checks = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        order, new, _ = _sorted(keys, checks)
        group = np.cumsum(new) - 1
        hit = np.zeros(len(keys), bool)
        hit[order] = np.bincount(group)[group] > 1 if len(group) else False
        at = np.searchsorted(far, keys)
        for step in range(int(np.unique(far, return_counts=True)[1].max()) if len(far) else 0):  # one step, but for equal keys with unlike checks
            there = np.minimum(at + step, len(far) - 1)
            hit |= (far[there] == keys) & (far_check[there] == checks)
        cols = {name: [] for name, _, _ in fields[1:]}
        seen = 0
        for (lo, hi), (k, _, first, doc) in zip(C.chunks(offsets), found):
            chosen = first[hit[seen : seen + len(k)]]
            seen += len(k)
            edge = np.zeros(len(doc) + 1, np.int64)
            np.add.at(edge, chosen, 1)
            np.add.at(edge, chosen + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                words = raw[offsets[lo + i] : offsets[lo + i + 1]].tobytes().split()
                lost = gone[cut[i] : cut[i + 1]]
                spans = []
                if lost.any():
                    step = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(step[::2], step[1::2])]
                kept = b" ".join([w for w, x in zip(words, lost.tolist()) if not x] if spans else words)
                cols["n_words"].append(len(words))
                cols["n_removed"].append(int(lost.sum()))
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                cols["spans"].append(spans)
                if keep_text:
                    cols["kept_text"].append(kept.decode())
        return pa.table([texts["doc_id"].combine_chunks() if texts.num_rows else texts["doc_id"], *(pa.array(cols[n], t) for n, _, t in fields[1:])], [n for n, _, _ in fields])

    sent = blocks.groupBy("block").applyInArrow(send, BLOBS)
    repeated = sent.groupBy("part").applyInArrow(count, BLOBS)
    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(remove, ", ".join(f"{n} {t}" for n, t, _ in fields))
