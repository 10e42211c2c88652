"""Toxicity scores of texts by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from tidemark.llm.common import query, staged, table

#: Labelled documents that a model is fitted on at most, by a hash of their id.
MAX_TRAINING_ROWS = 12_000
HASH_BITS = 22
FACTORS = 8
#: Terms need so many documents, and so many standard errors between the classes, to enter the model.
MIN_DOCUMENTS, MIN_Z = 3, 3.0
#: Terms that are neutral alone enter the model with a partner: so many of the most frequent ones, each in so many documents, are held
#: against each other; a pair must part the classes by so many standard errors.
PAIR_TERMS, PAIR_DOCUMENTS, MIN_PAIR_Z = 1_500, 30, 8.0
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.1, 1e-4
PREFIXES = range(3, 8)
#: Words of a task whose terms are remembered.
REMEMBERED = 200_000

WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    names = [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) > k]]
    return [xxhash.xxh32_intdigest(n) >> (32 - HASH_BITS) for n in names]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@F.arrow_udf(ArrayType(IntegerType()))
def hashed_terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct terms of each text, sorted."""
    for batch in batches:
        rows = [sorted({t for w in words_of(text) for t in terms_of(w)}) for text in batch.to_pylist()]
        yield pa.array(rows, pa.list_(pa.int32()))


@dataclass
class Model:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors)"""

    bias: float
    place: dict[int, int]  # term -> row of weights and factors
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[int]) -> float:
        s = self.bias
        if rows:
            v = self.factors[rows]
            s += self.weights[rows].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def paired(labels: np.ndarray, terms: list[np.ndarray], counts: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Terms without an effect of their own that occur together with another such term more in one class than in the other.

    What is compared is the covariance of two terms in each class. Equal sets of terms count once: copies are no evidence.
    """
    flat = np.flatnonzero((counts >= PAIR_DOCUMENTS) & (z < MIN_Z))
    flat = flat[np.argsort(-counts[flat], kind="stable")][:PAIR_TERMS]
    distinct = list({(int(y), t.tobytes()): t for y, t in zip(labels, terms)}.items())
    column = np.full(len(counts), -1, np.int32)
    column[flat] = np.arange(len(flat))
    covariance, error = [], []
    for y in (1, 0):
        docs = [column[t] for (label, _), t in distinct if label == y]
        n = len(docs)
        if not n or not len(flat):
            return flat[:0]
        x = np.zeros((n, len(flat)), np.float32)
        for d, found in enumerate(docs):
            x[d, found[found >= 0]] = 1
        p = x.mean(axis=0, dtype=np.float64)
        both = x.T @ x / n - np.outer(p, p)
        spread, skew = p * (1 - p), 1 - 2 * p
        covariance.append(both)
        error.append((np.outer(spread, spread) + both * np.outer(skew, skew)) / n)
    apart = np.abs(covariance[0] - covariance[1]) / np.sqrt(np.maximum(error[0] + error[1], 1e-9))
    np.fill_diagonal(apart, 0)
    return flat[apart.max(axis=1) >= MIN_PAIR_Z] if len(flat) else flat


def fit(labels: np.ndarray, terms: list[np.ndarray]) -> Model:
    """Terms that part the classes, alone or in pairs, then gradient steps (AdaGrad) on the log loss of small batches."""
    n, positive = len(labels), int(labels.sum())
    rate = (positive + 1) / (n + 3)
    bias = float(np.log(rate / (1 - rate)))
    none = Model(bias, {}, np.zeros(0), np.zeros((0, FACTORS)))
    if positive in (0, n):
        return none
    size = 1 << HASH_BITS
    flat = np.concatenate([t for t, y in zip(terms, labels) if y])
    with_1 = np.bincount(flat, minlength=size)
    with_0 = sum((np.bincount(np.concatenate(part), minlength=size)
                  for part in chunks([t for t, y in zip(terms, labels) if not y])), np.zeros(size, np.int64))
    share = (with_1 + with_0) / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / (n - positive)))
    z = np.abs(with_1 / positive - with_0 / (n - positive)) / error
    chosen = np.flatnonzero((with_1 + with_0 >= MIN_DOCUMENTS) & (z >= MIN_Z))
    chosen = np.union1d(chosen, paired(labels, terms, with_1 + with_0, z))
    if not len(chosen):
        return none
    row = np.full(size, -1, np.int32)
    row[chosen] = np.arange(len(chosen))
    docs = [r[r >= 0] for r in (row[t] for t in terms)]
    rng = np.random.default_rng(6)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS))
    gb, gw, gv = 1e-6, np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            part = order[low:low + BATCH]
            flat = np.concatenate([docs[d] for d in part])
            doc = np.repeat(np.arange(len(part)), [len(docs[d]) for d in part])
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, doc, v[flat])
            s = bias + np.bincount(doc, w[flat], len(part)) \
                + 0.5 * ((sums ** 2).sum(axis=1) - np.bincount(doc, (v[flat] ** 2).sum(axis=1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[part]) / len(part)
            used, where = np.unique(flat, return_inverse=True)
            dw = np.bincount(where, g[doc], len(used)) + DECAY * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, where, g[doc][:, None] * (sums[doc] - v[flat]))
            dv += DECAY * v[used]
            gb += g.sum() ** 2
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            bias -= RATE * g.sum() / np.sqrt(gb)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return Model(float(bias), {int(t): i for i, t in enumerate(chosen)}, w, v)


def chunks(parts: list, size: int = 2_000) -> Iterator[list]:
    for low in range(0, len(parts), size):
        yield parts[low:low + size]


def fit_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task: the bounded sample in, the model out as rows (term, weight, factors); the bias has term -1."""
    labels, terms = [], []
    for frame in frames:
        labels += frame["toxic"].tolist()
        terms += [np.asarray(t, np.int32) for t in frame["terms"]]
    model = fit(np.array(labels, np.int64), terms)
    yield pd.DataFrame({"term": [-1, *model.place], "weight": [model.bias, *model.weights],
                        "factors": [[], *model.factors.tolist()]})


def held_out(doc_id: Column) -> Column:
    """One of five documents, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from the labelled documents that are not held out, `max_rows` of them at most (smallest hashes of the id).

    Rows without id or label are left out; a document with several labels is toxic if one says so; repeated documents
    count once. With no labelled document, or one class only, all scores equal the prior.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = texts.select("doc_id", "toxic", hashed_terms("text").alias("terms")) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))
    rows = staged(rows, "training")
    fitted = rows.select("toxic", "terms").coalesce(1).sortWithinPartitions("terms") \
        .mapInPandas(fit_rows, "term int, weight double, factors array<double>")
    found = fitted.collect()  # bounded by the terms of max_rows documents
    if not found:
        return fit(np.zeros(0, np.int64), [])
    bias = next(r.weight for r in found if r.term == -1)
    found = [r for r in found if r.term >= 0]
    return Model(bias, {r.term: i for i, r in enumerate(found)}, np.array([r.weight for r in found]),
                 np.array([r.factors for r in found]).reshape(-1, FACTORS))


def scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast((model.bias, model.place, model.weights, model.factors))

    @F.arrow_udf(DoubleType())
    def score_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, remembered = Model(*shared.value), {}
        for batch in batches:
            scores = []
            for text in batch.to_pylist():
                rows: set[int] = set()
                for word in words_of(text):
                    known = remembered.get(word)
                    if known is None:
                        if len(remembered) >= REMEMBERED:
                            remembered.clear()
                        known = remembered[word] = [model.place[t] for t in terms_of(word) if t in model.place]
                    rows.update(known)
                scores.append(model.score(sorted(rows)))
            yield pa.array(scores, pa.float64())

    return score_batches


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """`docs` with a column `into`: the probability that a text is toxic.

    Terms are the words of the whole text and their beginnings, present or not. Null and empty texts have no terms
    and get the model's bias. Rows are scored one by one, so repeated rows, ties and other columns, whatever
    their names but `into`, play no part; an empty table gives no rows.
    """
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold by a model fitted on the labelled ones among them, with their columns."""
    return score(docs, train(docs, labels), into="__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
