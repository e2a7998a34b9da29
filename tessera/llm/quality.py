"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of characters between ASCII white space. A text's features are its words, its word pairs, the words'
shapes (letter case, digits, punctuation), pairs of shapes, and a mark for each word that equals the one before. All are
hashed into one weight table; a feature's value is its share of the text's words, so a score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh, mix, slices, span_hashes, stored, utf8, with_fields, word_spans
from .language import held_out

BITS = 18
#: Labelled documents that training takes of each class, in the mean: those whose hash of doc_id is below a threshold
#: that the class's count gives (all, if there are fewer).
FIT_DOCS = 4000
EPOCHS, RATE, RATE_BASE, L1, L2 = 4, 1.0, 0.1, 1e-4, 1e-4
#: Documents with a lower score are rejected in the pipeline.
LEAST_SCORE = 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight index and row of every feature occurrence, and the words of each row."""
    n = len(off) - 1
    start, end, row = word_spans(data, off, ASCII_SPACE)
    word = span_hashes(data, start, end)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~np.isin(shape[1:], (48, 65, 97))
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = span_hashes(shape[keep], at[start], at[end])
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    same = pair[word[pair] == word[pair - 1]]
    salt = [np.uint64(0x1F3D5B79 * (k + 1)) for k in range(5)]
    parts = [word ^ salt[0], mix(word[pair] * np.uint64(3) + word[pair - 1]) ^ salt[1], shapes ^ salt[2], mix(shapes[pair] * np.uint64(3) + shapes[pair - 1]) ^ salt[3], np.full(len(same), 7, np.uint64) ^ salt[4]]
    rows = [row, row[pair], row, row[pair], row[same]]
    index = (mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int32)
    return index, np.concatenate(rows), np.bincount(row, minlength=n)


class Ftrl:
    """FTRL-proximal for logistic regression; the last weight is the intercept."""

    def __init__(self, size: int = (1 << BITS) + 1) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((RATE_BASE + np.sqrt(self.n[i])) / RATE + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        """One example: distinct indices, their values, 0 or 1, and how much it counts."""
        w, n = self.weights(i), self.n[i]
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * weight * x
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[i] = n + g * g

    def model(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from labelled documents that aren't held out (crc32 of doc_id mod 3 is not 1).

    Null texts are empty. A doc_id with several labels, or several texts, takes part with each; labels that aren't 0 or 1
    and rows without a doc_id don't. Without labelled documents every score is 0.5. The sampled ids (2 * per_class in the
    mean) are the only rows that are broadcast. One task takes their features in the order of (epoch, hash of doc_id, ...),
    a slice at a time, and gives the weights: they alone come to the driver, however long the documents are.
    """
    usable = labels.where(~held_out(3, 1) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    share = {k: min(1.0, per_class / v) for k, v in sizes.items()}
    if not share:
        return Ftrl().model()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(place < F.when(F.col("label") == 0, share.get(0, 1.0)).otherwise(share.get(1, 1.0)))
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def extract(it):
        for batch in slices(it):
            index, row, words = features(*utf8(batch.column(2)))
            order = np.lexsort((index, row))
            cut = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            index, out = index[order], ([], [])
            for k in range(batch.num_rows):
                i, c = np.unique(index[cut[k] : cut[k + 1]], return_counts=True)
                out[0].append(np.append(i, np.int32(1 << BITS)).astype(np.int32).tobytes())
                out[1].append(np.append(c / max(words[k], 1), 1.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["doc_id", "label", "i", "x"])

    weight = {k: 1 / v for k, v in share.items()}
    mean = sum(weight.values()) / len(weight)

    def learn(it):
        ftrl = Ftrl()
        for batch in slices(it):
            for label, i, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ftrl.learn(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), label, weight[label] / mean)
        yield pa.RecordBatch.from_arrays([pa.array([ftrl.model().tobytes()], pa.binary())], names=["weights"])

    found = stored(joined.mapInArrow(extract, "doc_id long, label int, i binary, x binary"), "features")
    turns = found.repartition(1).withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    ordered = turns.sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id", "label", "i", "x").select("label", "i", "x")
    row = ordered.mapInArrow(learn, "weights binary").first()
    return np.frombuffer(row[0], np.float32) if row else Ftrl().model()


def score(docs: DataFrame, weights: np.ndarray, names: Sequence[str] = ("score", "predicted")) -> DataFrame:
    """Add the score and the predicted class to docs, under ``names``; columns of these names are replaced, all others
    stay. Null text counts as empty."""
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in names])
    kept = docs.columns
    text_at = kept.index("text")

    def run(it):
        for batch in slices(it):
            index, row, words = features(*utf8(batch.column(text_at)))
            total = np.bincount(row, weights[index].astype(float), batch.num_rows) / np.maximum(words, 1) + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            arrays = [*(batch.column(i) for i in range(len(kept))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return docs.mapInArrow(run, with_fields(docs.schema, f"{names[0]} double, {names[1]} int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted class of every row of docs (more columns are ignored).

    A null text scores as the empty one; a null doc_id stays null and counts as the empty text for the fold. Repeated rows
    are repeated, an empty table gives an empty one.
    """
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that the classifier doesn't reject, with the columns of docs. Null texts are judged as
    empty ones; equal texts stay or go alike."""
    names = fresh(docs.columns, "_quality_score", "_quality_class")
    judged = score(docs, fit(docs, labels), names=names)
    return judged.where(F.col(names[0]) >= LEAST_SCORE).select([f"`{c}`" for c in docs.columns])
