"""Fill-in-middle: documents cut at seeded token boundaries and rearranged, from an index of distinct texts.

Identical texts are grouped by the SHA-256 of their content, and the grouped contents are compared: a group with two
contents ends the job instead of giving a wrong cut. The boundaries of a distinct text's tokens are found once and kept
as an Elias-Fano list. Documents, without their texts, join the index again and select the two boundaries that their
hashes name. Texts that stand very often (more than a ten-thousandth of all rows, so at most MOST_HOT texts) have their
documents dealt into shares, each of which joins its own copy of the index row.

Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points. Null text is empty, and stays plain; so do texts with one of the
marks. A null id is hashed as an empty string. Repeated rows give repeated results, long texts have no limit, an empty
table gives an empty result, and columns other than doc_id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klarspan.llm import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts with more documents than the table's rows over MOST_HOT (and than LEAST_HOT) are dealt into shares.
MOST_HOT = 10_000
LEAST_HOT = 1_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def token_ends(texts: pa.Array) -> list[np.ndarray]:
    """Where each text's tokens end, in code points."""
    raw, offsets = C.buffer_of(texts)
    point = (raw & 0xC0) != 0x80
    starts = point.copy()
    letter = _LETTER[raw]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(point, out=at[1:])  # code points before each byte
    places = np.flatnonzero(starts)
    cut = np.searchsorted(places, offsets)
    return [np.append(at[places[a + 1 : b]], at[end])[: b - a] - at[begin] for a, b, begin, end in zip(cut[:-1], cut[1:], offsets[:-1], offsets[1:])]


def encode(values: np.ndarray) -> bytes:
    """An increasing list as Elias-Fano: a byte with the number of low bits, the low bits, and the high parts in unary."""
    if not len(values):
        return b""
    low = max(0, int(values[-1] // len(values)).bit_length() - 1)
    high = np.zeros(len(values) + int(values[-1] >> low) + 1, np.uint8)
    high[(values >> low) + np.arange(len(values))] = 1
    bits = (values[:, None] >> np.arange(low)) & 1
    return bytes([low]) + np.packbits(bits.astype(np.uint8)).tobytes() + np.packbits(high).tobytes()


def select(data: bytes, n: int, ranks: list[int]) -> list[int]:
    """The values at some ranks (from 0) of a list of n."""
    low = data[0]
    packed = np.frombuffer(data, np.uint8, offset=1)
    lows, high = packed[: -(-n * low // 8)], packed[-(-n * low // 8) :]
    ones = np.cumsum(np.bitwise_count(high))
    out = []
    for rank in ranks:
        byte = int(np.searchsorted(ones, rank + 1))
        before = int(ones[byte - 1]) if byte else 0
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[rank - before])
        value = place - rank
        span = np.unpackbits(lows[rank * low // 8 : (rank + 1) * low // 8 + 1])[rank * low % 8 :][:low]
        out.append(value << low | sum(int(b) << k for k, b in enumerate(span)))
    return out


@F.arrow_udf(T.StructType().add("n", T.LongType()).add("ends", T.BinaryType()))
def _boundaries(texts: pa.Array) -> pa.Array:
    found = token_ends(texts)
    return pa.StructArray.from_arrays([pa.array([len(x) for x in found], pa.int64()), pa.array([encode(x) for x in found], pa.binary())], ["n", "ends"])


@F.arrow_udf(T.StructType().add("prefix", T.IntegerType()).add("until", T.IntegerType()))
def _cut(n: pa.Array, ends: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Code points before the cuts after ``low`` and ``high`` tokens."""
    out = []
    for count, data, *units in zip(*(x.to_pylist() for x in (n, ends, low, high))):
        found = iter(select(data, count, [u - 1 for u in units if u]) if count else ())
        out.append([next(found) if u else 0 for u in units])
    return pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.int32()) for i in (0, 1)], ["prefix", "until"])


def _texts(keyed: DataFrame, *more: Column) -> DataFrame:
    """key, text: one row for each distinct text, its contents compared within the group of its key."""
    grouped = keyed.groupBy("key").agg(F.collect_set("text").alias("texts"), *more)
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts of one SHA-256")).cast("string"))
    return grouped.select(*(c for c in grouped.columns if c != "texts"), one.alias("text"))


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, the rearranged
    text. ``percent`` of the documents are cut, ``suffix_first`` percent of those in the order suffix, prefix, middle."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashed = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"))  # never null, so that no join adds a filter and the texts' exchange is used twice
    most = max(LEAST_HOT, docs.count() // MOST_HOT)
    hot = keyed.groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    hot = C.written(hot.select("key", F.ceil(F.col("copies") / most).cast("int").alias("shares")), "hot-texts")
    flagged = keyed.join(F.broadcast(hot), "key", "left")  # at most MOST_HOT rows, as each has over a MOST_HOT-th of all rows

    few, many = flagged.where("shares IS NULL"), flagged.where("shares IS NOT NULL")
    texts = _texts(few)  # dealt by key once; the boundary lists, not the texts, are dealt to the documents
    parted = few.select("doc_id", "key").join(texts.select("key", _boundaries("text").alias("list")), "key").join(texts, "key")
    share = F.pmod(F.monotonically_increasing_id(), F.col("shares")).cast("int")
    copies = _texts(many, F.first("shares").alias("shares")).withColumn("list", _boundaries("text")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    parted = parted.unionByName(many.select("doc_id", "key", share.alias("share")).join(copies, ["key", "share"]).drop("share"))

    n = F.col("list.n")
    drawn = parted.select("doc_id", "text", "list", *hashed)
    a, b = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
    cut = drawn.withColumn("cut", _cut(n, F.col("list.ends"), F.least(a, b), F.greatest(a, b)))
    plain = (n == 0) | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.col("h3") % 100 >= percent)
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    p, q = F.col("cut.prefix"), F.col("cut.until")
    prefix, middle, suffix = F.left("text", p), F.substr("text", p + 1, q - p), F.substr("text", q + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    is_cut = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(is_cut, spm).otherwise(F.col("text"))
    return cut.select("doc_id", n.alias("n"), "form", F.when(is_cut, p).cast("long").alias("prefix_chars"), F.when(is_cut, q - p).cast("long").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of some form was made of. The marks are unmistakable: the text has none, and none can
    arise where a mark and a part of the text meet."""
    at = lambda mark: F.instr(output, mark)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    middle = F.substr(output, m + 3)
    psm = F.concat(F.substr(output, F.lit(4), s - 4), middle, F.substr(output, s + 3, m - s - 3))
    spm = F.concat(F.substr(output, p + 3, m - p - 3), middle, F.substr(output, F.lit(4), p - 4))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def oracle(seed: int = 1, percent: int = 90, suffix_first: int = 20) -> str:
    """DuckDB SQL for the query's rows."""
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS k FROM t),
f AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR k[3] % 100 >= {percent} THEN 'plain' WHEN k[4] % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c
"""
