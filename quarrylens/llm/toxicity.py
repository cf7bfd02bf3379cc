"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model learns from a bounded sample of labelled documents (``max_train`` rows and ``max_bytes``, chosen by a hash of
the id over the whole table). L1 keeps few weights, so what is broadcast is at most 2**bits pairs. Every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, written

_WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")
#: The bias of a model that learnt from no rows, or from rows of one label alone: a score of 0.018.
UNTRAINED = -4.0
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed features of a text: words, pairs of neighbours and pairs with one word between; empty for no words."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    words = np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found)) * _MIX[0]
    parts = [words, words[:-1] * _MIX[1] + words[1:] * _MIX[2], words[:-2] * _MIX[3] + words[2:] * _MIX[4]]
    mixed = np.concatenate(parts)
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX[1] >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Ftrl:
    """Weights by coordinate with their own rates; l1 leaves most at exactly zero."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0

    def __post_init__(self) -> None:
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, max_train: int = 6000, bits: int = 20, epochs: int = 6, max_bytes: int = 256 << 20) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) from at most ``max_train`` labelled rows outside fold 0, and ``max_bytes`` of their features.

    Null labels or ids are not learnt from; an id labelled twice counts as toxic if either says so; of the texts of a
    repeated id the smallest is learnt. Rows are taken in the order of the id's hash until their hashed features (four
    bytes each, whole texts) would exceed ``max_bytes``; so much reaches the driver at most. Without
    labelled rows of both kinds the model has no weights and the bias ``UNTRAINED``: nothing is called toxic.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    sample = known.where(fold(F.col("id"), folds) != 0).orderBy(F.xxhash64("id"), "id").limit(max_train)
    # at most max_train ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.unique(features(t, bits)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label").cast(pa.int32()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.nbytes for x in at], pa.int64())], ["id", "label", "at", "size"])

    told = written(rows.mapInArrow(hashed, f"id {docs.schema[id_col].dataType.simpleString()}, label int, at binary, size long"), "sample")
    # a row per sampled id, without its features
    sizes = told.select("id", F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id")).alias("bytes"))
    fits = F.broadcast(sizes.where(F.col("bytes") <= max_bytes).select("id"))
    found = sorted(told.join(fits, "id", "left_semi").select("id", "label", "at").collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    model = Ftrl(bits)
    toxic = sum(r["label"] for r in found)
    if toxic in (0, len(found)):
        return np.empty(0, np.int64), np.empty(0), UNTRAINED
    up = min(3.0, max(1.0, (len(found) - toxic) / max(1, toxic) / 3))
    bias = np.array([1 << bits])
    for _ in range(epochs):
        for r in found:
            model.learn(np.concatenate([np.frombuffer(r["at"], np.int32), bias]), r["label"], up if r["label"] else 1.0)
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = 20) -> DataFrame:
    """(id, score) of every row, from its whole text alone; null and empty texts get the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[at] = w
        for b in batches:
            out = []
            for text in b.column("text"):
                f = features(text.as_py(), bits)
                hit = f[dense[f] != 0]
                total = bias + float(dense[np.unique(hit)].sum())
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Null and empty texts get the bias's score, texts are scored whole however long, repeated rows and ids each; an
    empty table gives an empty result; extra columns are not read. Without labels to learn from nothing is predicted.
    """
    scored = score(docs, train(docs, labels, id_col, text_col, folds=folds), id_col, text_col)
    return scored.select(id_col, (fold(F.col(id_col), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold.

    Null and empty texts get the bias's score, so they stay unless most of the sample is toxic; repeated rows are
    decided each; an empty table gives an empty result; without labels to learn from every row stays.
    """
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = 20

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[at] = w
        floor = float(np.log(threshold / (1 - threshold)))
        for b in batches:
            keep = []
            for text in b.column(text_col):
                f = features(text.as_py(), bits)
                hit = f[dense[f] != 0]
                keep.append(bias + float(dense[np.unique(hit)].sum()) < floor)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
