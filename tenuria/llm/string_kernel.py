"""Language identification by a string kernel.

A text is the set of its character n-grams of one, two and three letters (a blended spectrum with presence counts), each hashed
from its code points to one of BUCKETS numbers, so that letters of all scripts count alike. The kernel of two texts is the share of n-grams they have in common,
|A and B| / sqrt(|A| |B|). Landmarks give the Nyström map phi(x) = k(x, landmarks) W^(-1/2); kernel ridge regression of one
language against the rest is then linear in phi, and all texts of a batch are scored by matrix products.

Fitting takes, as documented bounds, PER_LANGUAGE labelled rows of each language (those of the smallest hashes of their keys) for
the regression, LANDMARKS of them as landmarks. Prediction reads the whole text only.

Defined results: null texts, and texts without a letter, are "und" with score 0; ties go to the first language by name; rows
of a null language are not learned from; without any labelled row all texts are "und". Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tenuria.llm.frames import lanes, mix, slices, trim, utf8
from tenuria.session import stored

PER_LANGUAGE, LANDMARKS, RIDGE = 400, 256, 1e-3
UNKNOWN = "und"
#: Bytes of text that a task works on at a time.
PART = 1 << 20
#: Numbers of n-grams, which bound the size of a set whatever the length and the script of its text; and n-grams hashed at a time.
BUCKETS, PIECE = 1 << 18, 1 << 16
SPACE = 32


def letters(text: Column) -> Column:
    """Lower-cased letters, one space for anything else between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins."""
    data, offsets = utf8(column)
    n = int(offsets[-1])
    lead = (data[:n] & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    word = lanes(data)[at].astype(np.uint32)
    b0, b1, b2, b3 = word & 255, word >> 8 & 63, word >> 16 & 63, word >> 24 & 63
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    return code.astype(np.int64), np.searchsorted(at, offsets)


def grams(code: np.ndarray) -> np.ndarray:
    """Distinct 1-, 2- and 3-grams of one text, as ascending numbers below BUCKETS. A space stands at either end."""
    s = np.full(len(code) + 2, SPACE, np.uint64)
    s[1:-1] = code
    seen = np.zeros(BUCKETS, bool)
    for at in range(0, max(1, len(code)), PIECE):
        part = s[at : at + PIECE + 2]
        pair = part[:-1] << np.uint64(21) | part[1:]
        # Three code points of 21 bits each fit one number; a 1-gram is below all 2-grams and these below all 3-grams.
        whole = np.concatenate([part[1:-1], pair, pair[:-1] << np.uint64(21) | part[2:]])
        seen[(mix(whole, 0x9E3779B97F4A7C15) % np.uint64(BUCKETS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    features: np.ndarray  # n-grams of the landmarks, ascending
    presence: np.ndarray  # features x landmarks
    root: np.ndarray  # square roots of the landmarks' sizes
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, column: pa.Array) -> np.ndarray:
        """Kernel of every text with every landmark."""
        code, start = points(column)
        x = np.zeros((len(column), len(self.features)), np.float32)
        size = np.ones(len(column))
        for i in range(len(column)):
            g = grams(code[start[i] : start[i + 1]])
            size[i] = max(1, len(g))
            at = np.minimum(np.searchsorted(self.features, g), max(0, len(self.features) - 1))
            x[i, at[self.features[at] == g]] = 1
        return (x @ self.presence).astype(np.float64) / np.sqrt(size)[:, None] / self.root

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and its share of all languages' scores, each taken as exp(4 score)."""
        score = self.kernel(column) @ self.weights + self.bias
        share = np.exp(4 * (score - score.max(axis=1, keepdims=True)))
        best = score.argmax(axis=1)
        return best, share[np.arange(len(best)), best] / share.sum(axis=1)


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Model from labelled rows; None if there are none. The driver gets the sample alone."""
    d = rows.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), letters(F.col(text)).alias("text"), F.col(lang).alias("lang"))
    d = d.where("text <> ''")

    # Written first: Spark then sees that these few keys are small.
    picked = stored(sampled(d.select("lang", F.xxhash64("key").alias("h")), per_language))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", PART):
                code, start = points(some.column(2))
                sets = [grams(code[a:b]).astype(np.int32).tobytes() for a, b in zip(start, start[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.binary())], ["lang", "h", "grams"])

    chosen = d.select("lang", F.xxhash64("key").alias("h"), "text").join(picked, ["lang", "h"]).select("lang", "h", "text")
    taken = chosen.mapInArrow(gathered, "lang string, h long, grams binary").groupBy("lang", "h").agg(F.min("grams").alias("grams")).collect()
    sample = sorted((r.h, r.lang, bytes(r.grams)) for r in taken)
    if not sample:
        return None
    names = sorted({x[1] for x in sample})
    spread: dict[str, int] = {}
    rank = []
    for _, name, _ in sample:
        spread[name] = spread.get(name, 0) + 1
        rank.append(spread[name])
    # Landmarks in turn from each language.
    own = [i for _, i in sorted((r, i) for i, r in enumerate(rank))][:landmarks]
    found = [np.frombuffer(x[2], np.int32).astype(np.int64) for x in sample]
    features = np.unique(np.concatenate([found[i] for i in own]))
    presence = np.zeros((len(features), len(own)), np.float32)
    for j, i in enumerate(own):
        presence[np.searchsorted(features, found[i]), j] = 1
    root = np.sqrt(np.array([max(1, len(found[i])) for i in own], float))
    k = np.zeros((len(sample), len(own)))
    for i, g in enumerate(found):
        at = np.minimum(np.searchsorted(features, g), len(features) - 1)
        k[i] = presence[at[features[at] == g]].sum(axis=0) / np.sqrt(max(1, len(g))) / root
    values, vectors = np.linalg.eigh(k[own])
    good = values > 1e-8 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([k @ nystrom, np.ones((len(k), 1))])
    target = np.array([[1.0 if x[1] == n else -1.0 for n in names] for x in sample])
    penalty = ridge * len(phi) * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(phi.T @ phi + penalty + 1e-9 * np.eye(phi.shape[1]), phi.T @ target)
    return Model(names, features, presence, root, nystrom @ w[:-1], w[-1])


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """lang, h: the n smallest h (by value of its bits) of each language, searched among about 2 n that lie below a bound."""
    bits = F.col("h").bitwiseAND(F.lit((1 << 40) - 1))
    counts = rows.groupBy("lang").agg(F.count("*").alias("of"))
    few = rows.join(F.broadcast(counts), "lang").where(bits.cast("double") * F.col("of") < F.lit(2.0 * n * (1 << 40))).select("lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(bits, "h"))
    return few.withColumn("place", place).where(F.col("place") <= n).select("lang", "h")


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """All columns of docs (or those of `keep`, so that others don't pass through Python), and lang_pred and score in place of columns of those names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("letters_", F.coalesce(letters(F.col(text)), F.lit("")))
    own = docs.drop("lang_pred", "score", "letters_") if keep is None else docs.select(*keep)
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    width = len(own.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            parts = (part.slice(at, 256) for part in slices(batch, "letters_", PART) for at in range(0, part.num_rows, 256))
            for some in parts:
                found = some.column(width)
                empty = np.array(pc.equal(pc.binary_length(found), 0))
                best, score = m.predict(found) if m else (np.zeros(len(empty), np.int64), np.zeros(len(empty)))
                lang = [UNKNOWN if e or not m else m.languages[b] for b, e in zip(best, empty, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:width], pa.array(lang, pa.string()), pa.array(np.where(empty, 0.0, score))], names=[*some.schema.names[:width], "lang_pred", "score"])
        trim()

    return docs.select(*own.columns, "letters_").mapInArrow(run, schema)
