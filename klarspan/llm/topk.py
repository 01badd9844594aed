"""Exact top-k search by distributed histogram selection.

Stated queries meet all rows in blocks: a block of at most QUERIES queries is sent to the tasks, and each task scores
all its vectors against the block as matrix products. A pass counts scores into one histogram for each query; summed
over all tasks it shows the bin of the kth highest score, which the next pass divides again, until a bin is a single
score. A last pass returns the scores above the kth one and as many ties as are missing, those with the smallest ids.
Counts below a task's own kth highest score cannot matter and are not sent.

Components become floor(64 * x), x as double. Vectors that are null or hold null or non-finite components, and rows
without an id, take no part. Missing components of shorter vectors are zero. A query sees no row of its own id; rows
that repeat a query's id are queries of their own. Scores are exact while they fit 62 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klarspan.llm import common as C

QUERIES = 4096
BINS = 1024
#: Scores held at once in a task.
CELLS = 2_000_000


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as integers in a matrix padded with zeros."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    base = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good &= finite[base[1:]] == finite[base[:-1]]
    rows = np.flatnonzero(good)
    width = int(size[rows].max()) if len(rows) else 0
    out = np.zeros((len(rows), width), np.int64)
    inside = np.arange(width)[None, :] < size[rows][:, None]
    at = (base[rows][:, None] + np.arange(width)[None, :])[inside]
    with np.errstate(invalid="ignore"):
        out[inside] = np.floor(64 * flat[at]).astype(np.int64)
    return rows, out


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    if m.shape[1] >= width:
        return m[:, :width]
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


class _Block:
    """A block of queries, and how their scores are made exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors = ids, vectors
        most = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * longest
        self.kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        self.most = int(min(most * (1 + 1e-9) + 1, 2.0**62 - 2**40))

    def scores(self, batches):
        """(ids, scores as queries x candidates, own: pairs of one id) for pieces of a task's rows."""
        queries = self.vectors.astype(self.kind)
        step = max(1, CELLS // max(1, len(queries)))
        order = np.argsort(self.ids)
        for b in batches:
            ids = b["vec_id"].to_numpy(zero_copy_only=False)
            rows, vectors = quantised(b["embedding"])
            ids = ids[rows].astype(np.int64)
            vectors = _fit(vectors, queries.shape[1]).astype(self.kind)
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                lo, hi = np.searchsorted(self.ids, part, "left", order), np.searchsorted(self.ids, part, "right", order)
                n = hi - lo
                column = np.repeat(np.arange(len(part)), n)
                row = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                yield part, queries @ vectors[at : at + step].T, (row, column)


def _histogram(block: _Block, low: np.ndarray, span: np.ndarray, width: np.ndarray, k: int):
    """mapInArrow function: counts of the scores in [low, low + span) by bins of a width, none below the kth."""

    def run(batches):
        counts = np.zeros((len(block.ids), BINS), np.int64)
        floor = low.astype(block.kind)
        for _, scores, (row, column) in block.scores(batches):
            wanted = scores >= floor[:, None]
            wanted[row, column] = False
            q, c = np.nonzero(wanted)
            over = scores[q, c].astype(np.int64) - low[q]
            inside = over < span[q]
            q, bin_ = q[inside], (over // width[q])[inside]
            counts += np.bincount(q * BINS + bin_, minlength=counts.size).reshape(counts.shape)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            kth = (above >= k).sum(axis=1) - 1  # the bin of this task's kth highest score so far
            floor = np.where(kth > 0, low + kth * width, low).astype(block.kind)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        kth = np.maximum(0, (above >= k).sum(axis=1) - 1)
        q, bin_ = np.nonzero(counts * (np.arange(BINS)[None, :] >= kth[:, None]))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[q, bin_])], ["q", "bin", "n"])

    return run


def _selected(block: _Block, low: np.ndarray, k: int):
    """mapInArrow function: a task's k best of the scores that reach the kth one, ties to the smaller id."""

    def run(batches):
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        floor = low.astype(block.kind)
        for ids, scores, (row, column) in block.scores(batches):
            wanted = scores >= floor[:, None]
            wanted[row, column] = False
            q, c = np.nonzero(wanted)
            if not len(q):
                continue
            q, v, s = (np.concatenate(x) for x in zip(held, (q, ids[c], scores[q, c].astype(np.int64))))
            by = np.lexsort((v, -s, q))
            q, v, s = q[by], v[by], s[by]
            new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            place = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
            held = tuple(x[place < k] for x in (q, v, s))
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[held[0]]), *(pa.array(x) for x in held)], ["query_id", "q", "vec_id", "score"])

    return run


def _kth(block: _Block, rows: DataFrame, k: int) -> np.ndarray:
    """The kth highest score of each query of the block, or less than any score where there are fewer."""
    n = len(block.ids)
    low, width = np.full(n, -block.most, np.int64), np.full(n, 2 * block.most // BINS + 1, np.int64)
    span = width * BINS
    missing = np.full(n, k, np.int64)
    while True:
        found = rows.mapInArrow(_histogram(block, low, span, width, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        need = F.get(F.lit(missing.tolist()), F.col("q"))
        crossed = found.withColumn("upto", F.sum("n").over(down)).where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).select("q", "bin", (F.col("upto") - F.col("n")).alias("above")).collect()
        at = np.full(n, -1)
        for r in crossed:
            at[r["q"]] = r["bin"]
            missing[r["q"]] -= r["above"]
        low = np.where(at >= 0, low + at * width, low)  # a query with fewer than k scores keeps them all
        if not ((at >= 0) & (width > 1)).any():
            return low
        span, width = width, (width + BINS - 1) // BINS


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all other rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    asked = rows.where(is_query)
    lengths = rows.agg(F.max(F.when(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x * 64) + 1, F.lit(2.0))))).alias("longest"), F.count_if(is_query).alias("n")).first()
    blocks = max(1, -(-lengths["n"] // queries))
    longest = float(np.sqrt(lengths["longest"] or 0.0))
    outs = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()  # a bounded block
        at, matrix = quantised(pa.array([r["embedding"] for r in own], pa.list_(pa.float64())))
        if not len(at):
            continue
        block = _Block(np.array([r["vec_id"] for r in own], np.int64)[at], matrix, longest)
        out = rows.mapInArrow(_selected(block, _kth(block, rows, k), k), "query_id long, q long, vec_id long, score long").withColumn("q", F.col("q") + b * (1 << 40))
        outs.append(out if blocks == 1 else C.written(out, "selected"))
    if not outs:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = outs[0]
    for out in outs[1:]:
        found = found.union(out)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
