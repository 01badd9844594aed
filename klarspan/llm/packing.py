"""Best-fit packing of tokenised documents into sequences, with bounds that certify each partition's number of bins.

Documents become token ids with an end id; longer ones than a sequence are cut into whole sequences behind a first,
shorter piece. Whole sequences stand alone. The other pieces are dealt, at random, into partitions. Each runs best-fit
decreasing and sets its bins against the best of several lower bounds from dual feasible functions; a partition that
meets its bound is certified. The pieces of all partitions with gaps are exchanged: dealt again into fewer, larger
partitions, and packed again, as long as that saves bins. The last, least filled bin of each partition is not kept
either: those bins' pieces are packed together in the end, in the same way.

Only lengths and places are dealt; token ids stay in the table of pieces. Null text is an empty document: one end id.
Repeated rows and null ids are documents of their own. An empty table gives an empty result. Columns other than doc_id
and text play no part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klarspan.llm import common as C

#: Pieces in a partition of the first round, in expectation; each later round's partitions are GROWTH times as large.
PARTITION = 8_000
GROWTH = 4
ROUNDS = 3
#: Partitions of the first round at least, where each then has LEAST_PIECES.
LEAST_PARTITIONS = 16
LEAST_PIECES = 1_000
#: Bytes of text encoded at once, and distinct strings whose ids a worker remembers (some 90 bytes each).
TEXT_BYTES = 1_000_000
REMEMBERED = 800_000
#: Strings that the tokenizer gets as one text.
JOINED = 1_000


def _kinds() -> np.ndarray:
    """Of each byte: 0 beyond ASCII, a control or white space, 1 letter, 2 digit, 3 apostrophe, 4 other visible character."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 4
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
    kind[0x30:0x3A] = 2
    kind[0x27] = 3
    return kind


KIND = _kinds()
#: Masks of the first bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _strings(raw: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Starts of strings that a byte-level tokenizer with the common pattern encodes one by one as it does the whole text.
    A token holds letters, digits, other visible characters or white space only, but for a space before it and for an
    apostrophe before letters. So a text can be cut before a space or line feed that follows a visible character, behind
    a single line feed, and in ASCII where the kind of visible characters changes, but not behind an apostrophe, nor
    inside the special tokens. Texts are cut from each other."""
    n = len(raw)
    kind = KIND[raw]
    visible = (kind > 0) | (raw >= 0x80)
    if n > 1:  # the last bytes of white space beyond ASCII
        a, b = raw[:-1], raw[1:]
        visible[1:] &= ~((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0x80) & ((b <= 0x8A) & (b >= 0x80) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)) | (a == 0x81) & (b == 0x9F) | (a == 0x9A) & (b == 0x80))
    cut = np.zeros(n + 1, bool)
    cut[1:n] = ((raw[1:] == 0x20) | (raw[1:] == 0x0A)) & visible[:-1]
    cut[2:n] |= (raw[1:-1] == 0x0A) & visible[:-2] & (kind[2:] > 0)
    before, after = kind[:-1], kind[1:]
    plain = np.where(after == 3, 4, after)  # an apostrophe is as other characters to what stands before it
    cut[1:n] |= (before > 0) & (before != 3) & (plain > 0) & (before != plain)
    cut[1:n] |= (before == 3) & (after == 2)
    whole = raw.tobytes() if special else b""
    for token in special:
        at = whole.find(token)
        while at >= 0:
            cut[at + 1 : at + len(token)] = False
            at = whole.find(token, at + 1)
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Token ids of many texts at once: each distinct string between two cuts is encoded once and remembered.

    A string of up to 15 bytes is its own key, two numbers of its bytes and length; all keys of a chunk are looked up at
    once in a table with open addressing. Longer strings are told apart by a hash that is compared, and a dictionary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(added[i]) if i in added else len(token)  # a byte-level token has a character for each byte
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # numbers of long strings
        self.count = 0
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # string i has pool[begin[i] : begin[i + 1]]
        self._table(1 << 16)

    def _table(self, slots: int) -> None:
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.number = np.full(slots, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (C.mix(low ^ high * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(len(self.number) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of short strings, or -1."""
        at = self._slots(low, high)
        found = self.number[at]
        odd = np.flatnonzero((found >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at, low, high = at[odd], low[odd], high[odd]
        while len(odd):
            at = (at + 1) & (len(self.number) - 1)
            found[odd] = number = self.number[at]
            more = (number >= 0) & ((self.low[at] != low) | (self.high[at] != high))
            odd, at, low, high = odd[more], at[more], low[more], high[more]
        return found

    def _insert(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Short strings that the table lacks, each once."""
        if 2 * (self.count + len(low)) > len(self.number):
            full = self.number >= 0
            low, high, number = (np.concatenate(x) for x in ((self.low[full], low), (self.high[full], high), (self.number[full], number)))
            self._table(1 << int(4 * max(self.count, len(low)) - 1).bit_length())
        at = self._slots(low, high)
        while len(at):
            free = self.number[at] < 0
            self.number[at[free]] = number[free]
            done = self.number[at] == number
            self.low[at[done]], self.high[at[done]] = low[done], high[done]
            at, low, high, number = (at[~done] + 1) & (len(self.number) - 1), low[~done], high[~done], number[~done]

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers of new strings, whose ids are remembered. Those that begin with a space before and end with a visible
        character can be cut apart again, so they are encoded many at once; the bytes of the tokens tell which are whose."""
        apart = np.array([len(s) > 1 and s[0] == 0x20 and KIND[s[1]] > 0 and KIND[s[-1]] > 0 for s in new], bool)
        joined = [s for s, x in zip(new, apart) if x]
        single = [s for s, x in zip(new, apart) if not x]
        ids = [np.array(x, np.uint32) for x in self._encoded([b"".join(joined[k : k + JOINED]) for k in range(0, len(joined), JOINED)])]
        pool = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.searchsorted(np.cumsum(self.bytes[pool]), np.cumsum([len(s) for s in joined])) + 1 if joined else np.zeros(0, np.int64)
        alone = self._encoded(single)
        ends = np.concatenate([ends, len(pool) + np.cumsum([len(x) for x in alone], dtype=np.int64)])
        pool = np.concatenate([pool, np.fromiter(chain.from_iterable(alone), np.uint32)])
        a, b, used = self.count, self.count + len(new), int(self.begin[self.count])
        self.begin, self.pool = _room(self.begin, b + 1), _room(self.pool, used + len(pool))
        self.begin[a + 1 : b + 1], self.pool[used : used + len(pool)], self.count = used + ends, pool, b
        number = np.empty(len(new), np.int64)
        number[np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])] = np.arange(a, b)
        return number

    def _near(self, data: bytes, eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of strings of up to 15 bytes."""
        low = eight[starts] & FIRST_BYTES[np.minimum(size, 8)]
        high = size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > 8)
        high[long] |= eight[starts[long] + 8] & FIRST_BYTES[size[long] - 8]
        number = self._find(low, high)
        lacks = np.flatnonzero(number < 0)
        if len(lacks):
            order = lacks[np.lexsort((low[lacks], high[lacks]))]
            first = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            chosen = order[first]
            new = self._learn([data[a:b] for a, b in zip(starts[chosen].tolist(), (starts + size)[chosen].tolist())])
            self._insert(low[chosen], high[chosen], new.astype(np.int32))
            number[order] = new[np.cumsum(first) - 1]
        return number

    def _far(self, data: bytes, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of longer strings."""
        _, first, group = np.unique(C.word_hashes(raw, starts, starts + size), return_index=True, return_inverse=True)
        other = first[group]
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = raw[np.repeat(starts, size) + flat] != raw[np.minimum(np.repeat(starts[other], size) + flat, len(raw) - 1)]
        odd = np.flatnonzero((size[other] != size) | (np.add.reduceat(differs, np.cumsum(size) - size) > 0))
        group[odd] = len(first) + np.arange(len(odd))
        chosen = np.concatenate([first, odd])
        strings = [data[a:b] for a, b in zip(starts[chosen].tolist(), (starts + size)[chosen].tolist())]
        if new := list({s for s in strings if s not in self.known}):
            self.known.update(zip(new, self._learn(new).tolist()))
        return np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))[group]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more entry than texts)."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.count > REMEMBERED:
            self.forget()
        starts = _strings(raw, offsets, self.special)
        size = np.diff(starts, append=len(raw))
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(raw) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        number, data = np.empty(len(starts), np.int64), raw.tobytes()
        far = size > 15
        near = np.flatnonzero(~far)
        number[near] = self._near(data, eight, starts[near], size[near])
        if far.any():
            number[far] = self._far(data, raw, starts[far], size[far])
        begin = self.begin[number]
        mine = self.begin[number + 1] - begin
        after = np.cumsum(mine)
        out = self.pool[np.repeat(begin - (after - mine), mine) + np.arange(after[-1])]
        return out, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n entries."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


@lru_cache(maxsize=1)
def _encoder(path: str, changed: int) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """This worker's encoder, which keeps what it remembers from one task to the next."""
    return _encoder(path, os.stat(path).st_mtime_ns)


def token_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers) of all documents' pieces. ``path`` is
    a tokenizer's file that the executors can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            raw, offsets = C.buffer_of(batch.column(1))
            for lo, hi in C.chunks(offsets, TEXT_BYTES):
                ids, at = encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                count = -(-n // size)
                owner = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                short = n - (count - 1) * size  # of the first piece
                start = np.where(piece > 0, short[owner] + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, short[owner])
                begin = (at[:-1][owner] + start) * 4
                # pieces follow each other without gaps, so the buffer of ids serves as it is
                cuts = np.append(begin, len(ids) * 4).astype(np.int64)
                blobs = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]).cast(pa.binary())
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blobs], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tokenize, f"doc_id {kind}, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that pieces of these lengths need at least: the best of three families of dual feasible functions."""
    if not len(lengths):
        return 0
    value, count = np.unique(lengths, return_counts=True)
    best = -(-int((value * count).sum()) // size)
    eps = np.arange(1, size // 2 + 1)[:, None]
    # pieces above size - eps count as a bin, pieces below eps as nothing
    kept = np.where(value > size - eps, size, np.where(value < eps, 0, value))
    best = max(best, int((-(-(kept * count).sum(1) // size)).max(initial=0)))
    for k in range(1, 65):  # multiples of size / (k + 1) keep their size, others are rounded down to multiples of size / k
        for v in (value[None, :], kept[:: max(1, size // 64)]):
            scaled = np.where((k + 1) * v % size == 0, k * v, (k + 1) * v // size * size)
            best = max(best, int((-(-(scaled * count).sum(1) // (k * size))).max(initial=0)))
    # small pieces by how often eps fits in them, large ones by how often it fits beside them
    room = size // eps
    scaled = np.where(2 * value > size, 2 * (room - (size - value) // eps), np.where(2 * value == size, room, 2 * (value // eps)))
    return max(best, int((-(-(scaled * count).sum(1) // (2 * room[:, 0]))).max(initial=0)))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by best-fit decreasing: the fullest bin that still has room."""
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have left
    some, n = 0, 0  # a bit for each room that a bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need << need
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b, n = size, n, n + 1
        bins[i], offset[i] = b, size - room
        if room > need:
            free[room - need].append(b)
            some |= 1 << room - need
    return bins, offset


_PLACED = "row long, length long, part long, bin long, offset long, spare boolean, bins long, bound long"


def _packed(pieces: DataFrame, n_parts: int, salt: int, size: int) -> DataFrame:
    """Pieces (row, length) dealt into partitions and packed: with bin, offset, whether the bin is the partition's least
    filled one, and the partition's bins and lower bound."""

    def pack(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        bins, offset = best_fit(length, size)
        filled = np.bincount(bins, length)
        same = lambda x: np.full(len(length), x, np.int64)
        return pa.table({"row": table["row"], "length": table["length"], "part": table["part"], "bin": bins, "offset": offset, "spare": bins == filled.argmin(), "bins": same(len(filled)), "bound": same(lower_bound(length, size))})

    part = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n_parts)).cast("long")
    return pieces.select("row", "length", part.alias("part")).groupBy("part").applyInArrow(pack, _PLACED)


def _exchanged(todo: DataFrame, size: int, label: str) -> list[DataFrame]:
    """Pieces packed in rounds: the pieces of partitions with gaps are dealt into fewer, larger ones and packed again, as
    long as that saves bins. The tables hold final partitions only."""
    per, out, n = PARTITION, [], todo.count()
    placed = C.written(_packed(todo, max(1, min(LEAST_PARTITIONS, n // LEAST_PIECES), -(-n // per)), 0, size), label)
    bins = lambda df: df.groupBy("part").agg(F.first("bins").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("parts")).first()
    for salt in range(1, ROUNDS + 1):
        gap = placed.where("bins > bound")
        before, pieces = bins(gap), gap.count()
        if before["parts"] < 2:
            break
        per *= GROWTH
        again = C.written(_packed(gap.select("row", "length"), min(before["parts"] - 1, -(-pieces // per)), salt, size), label)
        if bins(again)["n"] >= before["n"]:
            break
        out.append(placed.where("bins = bound"))
        placed = again
    return [*out, placed]


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces, each with sequence_id and offset, its place in a sequence of at most ``size`` tokens, and certified:
    whether its partition had as few bins as any packing of its pieces (always so for whole sequences). Pieces have a
    length from 1 to ``size``; their columns are kept, but for those three names."""
    own = F.struct(*pieces.columns).alias("piece")
    rows = C.written(pieces.select(own, F.col("length").cast("long").alias("length")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = F.col("length") < size
    first = _exchanged(rows.where(short).select("row", "length"), size, "packed")
    spare = reduce(DataFrame.union, [x.where("spare").select("row", "length") for x in first])
    last = _exchanged(C.written(spare, "spare"), size, "spare-packed")
    number = lambda i: F.lit(i << 56) + F.col("part") * (1 << 24) + F.col("bin")  # noqa: E731  a partition has far fewer than 2**24 pieces
    settled = [x.where("NOT spare") for x in first] + last
    placed = reduce(DataFrame.union, [x.select("row", number(i).alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")) for i, x in enumerate(settled)])
    alone = rows.where(~short).select("piece", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    out = alone.union(rows.where(short).join(placed, "row").select("piece", "sequence_id", "offset", "certified"))
    return out.select(*(F.col(f"piece.`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset", "certified")), "sequence_id", "offset", "certified")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the pieces' ids of each sequence, one behind the other. A sequence has a bounded number
    of tokens, and so has its group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", "length", joined.alias("ids"))
