"""Language identification by multilingual mixture inference.

A document's n-grams are drawn from a mixture of languages; expectation-maximisation estimates the proportions from the
languages' n-gram likelihoods. The language set grows from the likeliest single language, by the language whose
likelihood gradient is largest, for as long as the penalised likelihood rises.

Texts become letters only (ASCII letters in lower case and all other non-ASCII bytes; anything else is one blank), and
the n-grams are three bytes, hashed into a fixed number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, utf8, with_fields

#: The n-gram buckets are 2**BITS; fewer (2**LEAST_BITS at least) where so many languages are learned that the model would
#: have more than MODEL_CELLS probabilities.
BITS, LEAST_BITS, MODEL_CELLS = 15, 8, 1 << 24
BUCKETS = 1 << BITS
#: Documents of each language that the n-gram counts are fitted on, in the mean: those whose hash of doc_id is below a
#: threshold that the language's count gives (all, if there are fewer).
FIT_DOCS = 4000
SMOOTHING = 0.5
#: Of log(n-grams), for each language after the first. Above BIC's 1/2, as overlapping n-grams aren't independent.
PENALTY = 3.0
ROUNDS = 30
UNKNOWN = "und"
#: The pipeline rejects documents in no known language, those whose score is below this, and those whose gain is below
#: LEAST_GAIN. The score compares the learned languages with each other and can't be below 1 / their number; the gain is
#: absolute.
LEAST_SCORE = 0.2
#: Of the mean log-likelihood of an n-gram in the mixture, less that of the background, which draws every bucket alike.
LEAST_GAIN = 0.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # buckets x languages

    @property
    def bits(self) -> int:
        return len(self.probability).bit_length() - 1


def bits_for(languages: int) -> int:
    bits = min(BITS, (MODEL_CELLS // languages).bit_length() - 1)
    if bits < LEAST_BITS:
        raise ValueError(f"{languages} languages are more than a model of {MODEL_CELLS} probabilities can tell apart")
    return bits


def grams(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of the three-byte n-grams of one text's bytes, without those of blanks alone."""
    x = _FOLD[data].astype(np.uint32)
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]  # runs of blanks become one
    code = x[:-2] | x[1:-1] << 8 | x[2:] << 16
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


def mixture(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for the proportions of the columns of p, given counts c: proportions, mixed probabilities, log-likelihood."""
    n, pi = c.sum(), np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds if p.shape[1] > 1 else 0):
        new = pi * ((c / (p @ pi)) @ p) / n
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    mixed = p @ pi
    return pi, mixed, float(c @ np.log(mixed))


def select(p: np.ndarray, c: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, float, np.ndarray]:
    """The language set with its proportions and log-likelihood, and the log-likelihood of each single language.

    From the likeliest single language on, the one with the largest likelihood gradient joins for as long as the
    penalised likelihood rises.
    """
    single = c @ np.log(p)
    n, chosen = c.sum(), [int(single.argmax())]
    pi, mixed, best = mixture(p[:, chosen], c)
    price = penalty * np.log(n + 1)
    while len(chosen) < p.shape[1]:
        gradient = (c / mixed) @ p
        gradient[chosen] = -np.inf
        if gradient.max() - n <= price:  # the likelihood is concave: no mixture gains more than this
            break
        more = [*chosen, int(gradient.argmax())]
        pi2, mixed2, value = mixture(p[:, more], c)
        if value - best <= price:
            break
        chosen, pi, mixed, best = more, pi2, mixed2, value
    return chosen, pi, best, single


def infer(model: Model, data: np.ndarray, penalty: float = PENALTY) -> tuple[dict[int, float], float, float]:
    """Proportions of the chosen languages, the score of the largest (its proportion times its posterior), and the gain:
    by how much an n-gram is likelier in the mixture than in a background of equal buckets (mean of log ratios)."""
    counts = np.bincount(grams(data, model.bits))
    at = np.flatnonzero(counts)
    if not len(at):
        return {}, 0.0, 0.0
    c, p = counts[at].astype(float), model.probability[at]
    chosen, pi, best, single = select(p, c, penalty)
    top = chosen[int(pi.argmax())]
    posterior = 1 / np.exp(np.minimum((single - single[top]) / 3, 50)).sum()
    score = float(min(1.0, pi.max() * posterior)) if len(chosen) == 1 else float(pi.max())
    return dict(zip(chosen, map(float, pi))), score, float(best / c.sum() + np.log(len(model.probability)))


def fit(docs: DataFrame, usable: Column, per_language: int = FIT_DOCS) -> Model | None:
    """n-gram likelihoods of each language from usable rows with a lang. None if there are no such rows.

    Every language is learned; very many of them share fewer buckets, so that the model's size is bounded.
    """
    rows = docs.where(usable & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit((MODEL_CELLS >> LEAST_BITS) + 1).collect()}
    if not sizes:
        return None
    languages, bits = sorted(sizes), bits_for(len(sizes))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_language / sizes[k]))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    index = {k: i for i, k in enumerate(languages)}

    def count(it):
        for batch in slices(it):
            data, off = utf8(batch.column(1))
            cells = [(index[lang] << bits) + grams(data[off[k] : off[k + 1]], bits).astype(np.int64) for k, lang in enumerate(batch.column(0).to_pylist())]
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cell >> bits).astype(np.int32)), pa.array((cell & (1 << bits) - 1).astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((len(languages), 1 << bits), SMOOTHING)
    total[found.lang, found.bucket] += found.n
    return Model(languages, np.ascontiguousarray((total / total.sum(1, keepdims=True)).T))


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY, names: Sequence[str] = ("lang_pred", "score", "lang_mix", "gain")) -> DataFrame:
    """Add the language, its score, the mixture (language -> proportion) and the gain to docs, under ``names``; columns
    of these names are replaced, all others stay.

    A text that is null or has no letter, or any text without a model, gets ``und``, 0, an empty mixture and 0.
    """
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in names])
    kept = docs.columns
    text_at = kept.index("text")

    def run(it):
        for batch in slices(it):
            column = batch.column(text_at)
            data, off = utf8(column)
            best, scores, mixes, gains = [], [], [], []
            for k, text in enumerate(column.to_pylist()):
                found, score, gain = infer(model, data[off[k] : off[k + 1]], penalty) if model and text and _LETTER.search(text) else ({}, 0.0, 0.0)
                best.append(model.languages[max(found, key=found.get)] if found else UNKNOWN)
                scores.append(score)
                mixes.append([(model.languages[i], p) for i, p in found.items()])
                gains.append(gain)
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64())), pa.array(gains, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return docs.mapInArrow(run, with_fields(docs.schema, f"{names[0]} string, {names[1]} double, {names[2]} map<string,double>, {names[3]} double"))


def held_out(modulus: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == fold


def predict_documents(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out, then predict every row of docs (doc_id, lang, text; more columns are ignored)
    from its text alone.

    Null or letterless texts, and all texts if there are no languages to learn, get ``und`` and 0. A null doc_id stays null
    and counts as the empty text for the fold; repeated rows are repeated, an empty table gives an empty one.
    """
    model = fit(docs, ~held_out(5, 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "lang_mix")


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents in a known language, with the columns of docs. A text that the learned languages
    explain no better than equal buckets do is in none of them; nor is one that is null or has no letter. Repeated rows
    are judged alike."""
    names = fresh(docs.columns, "_lang_pred", "_lang_score", "_lang_mix", "_lang_gain")
    judged = identify(docs, fit(docs, ~held_out(5, 0)), names=names)
    return judged.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE) & (F.col(names[3]) >= LEAST_GAIN)).select([f"`{c}`" for c in docs.columns])
