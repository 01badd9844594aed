"""Helpers that several operators share: scratch tables, text buffers and polynomial hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes handled at once inside a Python worker; longer documents are handled alone.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); tests without one get a folder of the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


#: Whether a query's shuffle files go as soon as it ends, instead of when the driver's memory is next collected.
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lineage cut that survives lost executors. The shuffle files
    that led to it are released at once, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/klarspan/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASED, None)
    spark.conf.set(RELEASED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASED, before) if before is not None else spark.conf.unset(RELEASED)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, modulo 2**64, equal for equal content at any place."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string or binary column as one byte array with offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of documents of at most ``most`` bytes each, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (maximal runs without separators, within one document) and their document's number."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separator[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    cut = np.unique(inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]) if len(inner) else inner
    if len(cut):  # a word touches the next document's first word
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Byte tables: ASCII white space as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random odd-looking value for each byte, from a fixed seed, so that runs of zero bytes also count.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
WORD_POWERS = Powers(0x5851F42D4C957F2D)
WINDOW_POWERS = Powers(0x2545F4914F6CDD1D)
CHECK_POWERS = Powers(0xDA942042E4DD58B5)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(spans_hash(BYTE_VALUE[raw], starts, ends, WORD_POWERS) + (ends - starts).astype(np.uint64))


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a[i]-b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def packed(key: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as little-endian differences of as few bytes as the largest needs."""
    step = np.diff(key, prepend=np.uint64(0))
    step[0] = 0
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return width, step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(first: int, width: int, data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, width)
    step = np.zeros((len(part), 8), np.uint8)
    step[:, :width] = part
    step = step.view("<u8").ravel().astype(np.uint64)
    step[0] = np.uint64(first & 0xFFFFFFFFFFFFFFFF)
    return np.cumsum(step)
