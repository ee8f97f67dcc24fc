"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, their stems (first 7 bytes), pairs of neighbouring words and pairs that skip a word, hashed to
2**18 coordinates. Per-coordinate rates and the L1 term leave a few hundred weights, which travel to the executors as
two small arrays. Training: ``epochs`` passes over at most ``most`` labelled documents that are not
held out, the rarer class weighted up. All documents are scored over their whole texts.

Defined results: an empty table gives no rows; a null or empty text has no features and gets the score of the bias; without labels of both
kinds every score is the labels' share of 1 (0 without labels); rows that repeat a doc_id are scored each, by their own text, and of several
labels the least counts. Other columns are not read, doc_id, lang and source least of all. A text is never cut, so an executor needs some
40 bytes of memory for each byte of the longest one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .labelled import held_out, sample
from .shared import table

MOST_DOCUMENTS, BITS, STEM = 10000, 18, 7
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WORDS = K.byte_table(101, lower=True, zero=bytes(i for i in range(256) if not IN_WORD[i]))


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every n-gram and skip-gram of a chunk; pairs never cross texts."""
    starts, ends, first = K.spans(data, off, IN_WORD)
    h = K.word_hashes(data, starts, WORDS)
    text = K.texts_of(first, np.arange(len(h)))
    down = np.uint64(64 - bits)
    stem = data.copy()
    begin = np.zeros(len(data) + 1, np.int32)
    if len(starts):  # a word's first STEM bytes stand for its inflections
        long = ends - starts > STEM
        np.add.at(begin, starts[long] + STEM, 1)
        np.add.at(begin, ends[long], -1)
    stem[np.cumsum(begin[:-1]) > 0] = 32
    s = K.mix(K.word_hashes(stem, starts, WORDS) + np.uint64(1))
    texts, coords = [text, text], [h >> down, s >> down]
    for gap, salt in ((1, K.GRAM_BASE), (2, K.BASE_2)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            pair = K.mix(h[:-gap] * np.uint64(salt) + h[gap:])
            texts.append(text[gap:][same])
            coords.append(pair[same] >> down)
    return np.concatenate(texts), np.concatenate(coords).astype(np.int64)


@dataclass
class Model:
    at: np.ndarray  # coordinates of the weights that aren't 0, ascending
    w: np.ndarray
    bias: float
    bits: int = BITS
    constant: float | None = None

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        dense = np.zeros(1 << self.bits)
        dense[self.at] = self.w
        text, coord = features(data, off, self.bits)
        some = np.flatnonzero(dense[coord])
        both = K.unique((text[some] << self.bits) + coord[some])  # presence: each once
        z = self.bias + np.bincount(both >> self.bits, dense[both & (1 << self.bits) - 1], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 1.0) -> Model:
    """rows: distinct coordinates of each document, in the order of learning."""
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(none, np.zeros(0), 0.0, bits, float(y.mean()) if len(y) else 0.0)
    bias = 1 << bits  # the last coordinate; it isn't penalised
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    up = min(4.0, (1 - y.mean()) / y.mean())

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        w[-1] = -z[bias] / ((beta + np.sqrt(n[bias])) / alpha)
        return w

    for _ in range(epochs):
        for own, label in zip(rows, y):
            at = np.append(own, bias)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -60, 60))) - label) * (up if label else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS, bits: int = BITS) -> Model:
    def run(batches):
        for batch in batches:
            out = []
            for lo, hi, data, off in K.chunks(batch.column(0)):
                text, coord = features(data, off, bits)
                both = K.unique((text << bits) + coord)
                cut = np.searchsorted(both, np.arange(hi - lo + 1) << bits)
                coords = (both & (1 << bits) - 1).astype(np.int32)
                out += [coords[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["at", "y"])

    rows = sample(docs, labels, "toxic", most).mapInArrow(run, "at binary, y int").collect()
    rows = sorted(((bytes(r["at"]), r["y"]) for r in rows), key=lambda r: (hash_of(r[0]), r[0], r[1]))
    return fit([np.frombuffer(a, np.int32).astype(np.int64) for a, _ in rows], np.array([y for _, y in rows], float), bits)


def hash_of(a: bytes) -> int:
    """An order of learning that neither the order of rows nor the class decides."""
    return int(K.mix(np.frombuffer(a, np.int32).astype(np.uint64)).sum(dtype=np.uint64))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            out = [model.scores(data, off) for _, _, data, off in K.chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
