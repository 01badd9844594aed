"""Language identification by string kernels.

The kernel of two texts is the normalised number of byte n-grams (1 to 3, the blended spectrum) that are present in
both. A sample of labelled texts serves as Nystroem landmarks; one-versus-rest kernel ridge regression is fitted in
their space, and batches of texts are scored as products of their presence matrix with the landmarks' n-grams and the
fitted coefficients. Texts are read whole; A-Z is lower-cased.

Bounds, all parameters: PER_LANGUAGE expected sample texts and LANDMARKS expected landmarks for each language, in all at
most SAMPLED texts and MARKED landmarks (chosen by a hash of the row, not by order), GRAMS n-grams kept of the landmarks.
Languages with fewer texts give all they have. Every labelled language is learned; many languages get fewer texts each.

Null text, text without a letter, and every text if nothing is labelled: `und` with score 0. A null id is not held out.
Repeated rows each give a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klarspan.llm import common as C

PER_LANGUAGE, LANDMARKS, GRAMS = 1500, 48, 8192
SAMPLED, MARKED = 200_000, 4_000
#: Texts whose presence matrix is held at once in a task.
TEXTS = 512
#: Ridge, and the softmax's steepness.
RIDGE, STEEP = 1e-2, 4.0
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)
#: Codes of 1-grams, 2-grams and 3-grams lie one after another.
_FROM = (0, 1 << 8, (1 << 8) + (1 << 16))
CODES = (1 << 8) + (1 << 16) + (1 << 24)


def gram_codes(raw: np.ndarray, offsets: np.ndarray):
    """For n = 1, 2, 3: codes of all n-grams inside documents, and the documents' numbers."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    one = _LOWER[raw]
    code = one
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | one[n - 1 :]
        if n == 1:
            yield code, doc
        elif len(code):
            inside = doc[: len(code)] == doc[n - 1 :]
            yield code[inside] + np.uint32(_FROM[n - 1]), doc[: len(code)][inside]


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes, sorted
    weights: np.ndarray  # len(grams) x languages
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """Place of each code among the grams; those of other codes are len(grams)."""
        found = np.full(CODES, len(self.grams), np.uint16)
        found[self.grams] = np.arange(len(self.grams), dtype=np.uint16)
        return found


def presence(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Documents x grams: 1 where a gram is present."""
    m = np.zeros((len(offsets) - 1, width + 1), np.float32)
    for codes, doc in gram_codes(raw, offsets):
        m[doc, table[codes]] = 1
    return m[:, :width]


def _pieces(offsets: np.ndarray):
    """Ranges of texts whose bytes and whose rows of a matrix fit a task."""
    for lo, hi in C.chunks(offsets, 1 << 20):
        for at in range(lo, hi, TEXTS):
            yield at, min(at + TEXTS, hi)


def normalised(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.maximum(1, m.sum(axis=1, keepdims=True)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, grams: int = GRAMS, sampled: int = SAMPLED, marked: int = MARKED, ridge: float = RIDGE) -> Model | None:
    """A model of (doc_id, text, lang), from samples (doc_id only spreads the sample over copies); None if nothing is labelled."""
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return None
    per_language, landmarks = (max(1, min(a, b // len(names))) for a, b in ((per_language, sampled), (landmarks, marked)))
    share = F.element_at(F.create_map(*(F.lit(x) for name in names for x in (name, 1.0 / counts[name]))), F.col("lang"))
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.where(at < share * per_language)

    def codes_of(batches):
        for b in batches:
            raw, offsets = C.buffer_of(b["text"])
            rows = []
            for lo, hi in C.chunks(offsets, 1 << 20):
                found = [np.zeros(0, np.uint64)]
                for codes, doc in gram_codes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    found.append(np.unique((doc.astype(np.uint64) << np.uint64(32)) | codes))
                every = np.concatenate(found)
                which = (every >> np.uint64(32)).astype(np.int64)
                rows += [(every[which == i] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b["lang"], pa.array(rows, pa.binary())], ["lang", "codes"])

    marks = [np.frombuffer(r["codes"], "<u4") for r in labelled.where(at < share * landmarks).mapInArrow(codes_of, "lang string, codes binary").collect()]
    marks.sort(key=lambda m: m.tobytes())
    if not marks:
        return None
    kept, df = np.unique(np.concatenate(marks), return_counts=True)
    kept = np.sort(kept[np.lexsort((kept, -df))[:grams]])
    model = Model(names, kept, np.zeros((0, 0)), np.zeros(0))
    own = np.zeros((len(marks), len(kept)), np.float32)
    for row, codes in zip(own, marks):
        row[np.isin(kept, codes)] = 1
    own = normalised(own)

    def kernel(batches):
        table = model.table()
        for b in batches:
            raw, offsets = C.buffer_of(b["text"])
            rows = [normalised(presence(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table, len(kept))) @ own.T for lo, hi in _pieces(offsets)]
            yield pa.RecordBatch.from_arrays([b["lang"], pa.array([r.astype("<f4").tobytes() for part in rows for r in part], pa.binary())], ["lang", "k"])

    rows = sorted(sample.mapInArrow(kernel, "lang string, k binary").collect())  # of the bounded sample, in an order that repeats
    k = np.array([np.frombuffer(r["k"], "<f4") for r in rows], np.float64).reshape(len(rows), len(marks))
    lang = np.array([names.index(r["lang"]) for r in rows], int)
    value, vector = np.linalg.eigh((own @ own.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = np.hstack([k @ root, np.ones((len(k), 1))])
    target = 2.0 * (lang[:, None] == np.arange(len(names))[None, :]) - 1
    weight = np.sqrt(len(lang) / (len(names) * np.maximum(1, np.bincount(lang, minlength=len(names)))))[lang][:, None]  # languages count alike
    left = (features * weight).T @ (features * weight) + ridge * len(lang) / len(names) * 0.01 * np.eye(features.shape[1])
    beta = np.linalg.solve(left, (features * weight).T @ (target * weight))
    model.weights, model.bias = (own.T @ (root @ beta[:-1])).astype(np.float32), beta[-1].astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score"), steep: float = STEEP) -> DataFrame:
    """The columns ``keep`` of the documents with, named ``out``, the language and its score (the softmax of its regression)."""
    fields = [docs.schema[c] for c in keep]
    if model is None:
        return docs.select(*keep, F.lit("und").alias(out[0]), F.lit(0.0).alias(out[1]))
    whole = F.struct(*keep).alias("whole")
    docs = docs.select(whole, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches):
        table, width = model.table(), len(model.grams)
        names = np.array(model.languages, object)
        for b in batches:
            raw, offsets = C.buffer_of(b["text"])
            best, score = [], []
            for lo, hi in _pieces(offsets):
                x = normalised(presence(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table, width)) @ model.weights + model.bias
                p = np.exp(steep * (x - x.max(axis=1, keepdims=True)).astype(np.float64))
                best.append(names[x.argmax(axis=1)])
                score.append(1 / p.sum(axis=1))
            lettered = b["lettered"].to_numpy(zero_copy_only=False).astype(bool)
            names_of = np.where(lettered, np.concatenate(best), "und") if best else []
            scores = np.where(lettered, np.concatenate(score), 0.0) if score else []
            yield pa.RecordBatch.from_arrays([*b["whole"].flatten(), pa.array(names_of, pa.string()), pa.array(scores, pa.float64())], [*keep, *out])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **bounds)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def reject_unknown(docs: DataFrame, **bounds) -> DataFrame:
    """The documents, all columns, without those whose language cannot be told (`und`)."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **bounds)
    name = "language_told"
    while any(c.lower().startswith(name) for c in docs.columns):  # no input column has this name
        name += "_"
    told = predict(docs, model, keep=tuple(docs.columns), out=(name, f"{name}_score"))
    return told.where(F.col(name) != "und").select(*(F.col(f"`{c}`") for c in docs.columns)) if model else told.select(*docs.columns)
