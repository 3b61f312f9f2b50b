"""Toxicity by logistic regression with FTRL-proximal updates over hashed word n-grams and skip-grams.

The features of a text are the hashes of its words, of their stems (first characters), of neighbouring pairs and of pairs
with one word between, each present or not. Every coordinate has its own learning rate; the L1 penalty keeps most
weights at zero, so the model is a short list of (index, weight), at most 2**BITS whatever the input, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import crc_mod, least_hashed, table
from cloakwork.llm.pieces import chunked
from cloakwork.llm.textgrams import mix, points, word_hashes

BITS = 20
STEM = 5
#: The most labelled documents that the model is fitted on, chosen by a hash of their id.
MAX_SAMPLE = 12_000
CHUNK = 2 << 20


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every occurrence of a feature in the texts; repeats stay."""
    flat, ends = points(texts)
    words, stems, row = word_hashes(flat, ends, STEM)
    out_row, out_hash = [row, row], [words, stems]
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        out_row.append(row[gap:][same])
        out_hash.append(mix(words[:-gap][same] * np.uint64(31) + words[gap:][same] + np.uint64(salt)) if len(row) > gap else words[:0])
    return np.concatenate(out_row), (np.concatenate(out_hash) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal, for logistic loss on sparse binary features; index 2**BITS is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, positive: float = 4.0) -> None:
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[np.arange(1 << BITS, (1 << BITS) + 1) if isinstance(at, slice) else at == 1 << BITS] = 0
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        if label:
            g *= self.positive  # label 1 is the rare one
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(labelled: DataFrame, text: str = "text", label: str = "label", epochs: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) learnt from the rows, which the caller keeps to a bounded number.

    Texts become indices where they lie; one task then reads these and learns in order of their hash. Rows without a
    label are left out; without rows the bias is 0 and there are no weights.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in chunked(batch, 1, CHUNK):
                row, at = features(texts)
                key = np.unique(row << (BITS + 1) | at)
                counts = np.bincount(key >> (BITS + 1), minlength=len(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(int(y), np.array(x.values.to_numpy(), np.int32)) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1))]
        rows.sort(key=lambda r: (xxhash.xxh3_128_digest(r[1].tobytes()), r[0]))  # whatever the order of arrival
        model = Ftrl()
        for _ in range(epochs):
            for y, at in rows:
                model.learn(at, y)
        w = model.weights()
        at = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(index, "label int, at array<int>").repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    at, w = found["at"].to_numpy(np.int64), found["w"].to_numpy(np.float64)
    bias = at == 1 << BITS
    return at[~bias], w[~bias], float(w[bias].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1 for each row's whole text; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            for lo, hi, texts in chunked(batch, 1, CHUNK):
                row, index = features(texts)
                hit = dense[index] != 0
                each = np.unique(row[hit] << BITS | index[hit])
                total = np.bincount(each >> BITS, dense[each & ((1 << BITS) - 1)], minlength=len(texts)) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", limit: int = MAX_SAMPLE) -> DataFrame:
    """(text, label) of at most `limit` labelled documents, those with the least hashes of their id.

    A document with several labels has the greatest; rows with one id share its label; null ids and labels are left out.
    """
    some = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("label"))
    some = least_hashed(some, limit)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(some), F.col("key") == F.col("k")).select("text", "label")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model that saw labels only of documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) != 0)
    model = fit(sample_labelled(docs, labels, "toxic"))
    out = score(docs, model)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
