"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, word lengths and repeated words, each
in a few bins, its own and those of the lines before and after. Forward-backward gives each line's
marginal; their mean, weighted by length, is mapped to a probability by a logistic curve. Weights are fitted by
gradient ascent on the chains' conditional likelihood, lines having their document's label, from at most
``most`` labelled documents that are not held out, all of their lines. All documents are scored, over
all of their lines.

Defined results: an empty table gives no rows; a null or empty text is scored as one empty line; without labels of both kinds every score
is the labels' share of 1 (0.5 without labels); rows that repeat a doc_id are scored each, by their own text, and of several labels
the least counts; a column of the name of the new one is replaced, others are left alone, doc_id, lang and source never read. A text is never cut, so
an executor needs some 30 bytes of memory for each byte of the longest one, and the driver some 500 for each line of the sample.
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

MOST_DOCUMENTS = 6000
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
WORDS = K.byte_table(41, lower=True, zero=K.SPACES)


def _kind(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(chars)] = 1
    return t


KINDS = [
    _kind(bytes(range(65, 91))),  # capitals
    _kind(bytes(range(97, 123)) + bytes(range(128, 256))),  # small letters, or other scripts
    _kind(b"0123456789"),
    _kind(b"#$%&*@^~_=+<>{}[]\\/"),  # symbols rare in prose
    _kind(b"|"),
    _kind(b"!?"),
    _kind(b".,;:"),
    _kind(b"\"'()-"),
]
SHARES = np.array([0, 0.005, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6, 0.85])
CUTS = [SHARES] * len(KINDS) + [
    np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 14]),  # mean length of a word
    np.array([0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7]),  # words equal to the word before
    np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97]),  # distinct words
    np.array([0, 1, 2, 4, 8, 12, 16, 24, 32, 64, 128]),  # words
    np.array([0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6]),  # lines of the same words before and after
]
BINS = 12
N = len(CUTS)


def line_bins(data: np.ndarray, off: np.ndarray):
    """(bin of each feature of each line, length of each line, for each text and one more its first line).

    A text without lines has one empty line.
    """
    starts, ends, first = K.spans(data, off, NOT_NEWLINE)
    size = ends - starts
    n = len(starts)
    values = np.zeros((N, n))
    if n:
        for i, t in enumerate(KINDS):
            c = np.append(0, np.cumsum(t[data]))
            values[i] = (c[ends] - c[starts]) / size
        ws, we, _ = K.spans(data, off, K.NOT_SPACE)
        h = K.word_hashes(data, ws, WORDS)
        line = np.searchsorted(starts, ws, "right") - 1
        words = np.bincount(line, minlength=n)
        some = np.maximum(words, 1)
        same = np.zeros(len(ws), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((h, line))
        hs, ls = h[order], line[order]
        new = np.ones(len(ws), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
        distinct = np.bincount(ls[new], minlength=n)
        j = len(KINDS)
        values[j] = np.bincount(line, we - ws, minlength=n) / some
        values[j + 1] = np.bincount(line, same, minlength=n) / some
        values[j + 2] = distinct / some
        values[j + 3] = words
        text = K.texts_of(first, np.arange(n))
        total = np.zeros(n, np.uint64)
        if len(ws):
            has = words > 0
            at = np.append(0, np.cumsum(words))[:-1][has]
            total[has] = np.add.reduceat(h, at)
        twin = np.zeros(n)
        twin[1:] = (total[1:] == total[:-1]) & (text[1:] == text[:-1])
        values[j + 4] = twin * 0.5
        values[j + 4][:-1] += twin[1:] * 0.5
    bins = np.zeros((N, n), np.uint8)
    for i, cut in enumerate(CUTS):
        bins[i] = np.searchsorted(cut, values[i], "left")
    none = np.flatnonzero(np.diff(first) == 0)
    if len(none):
        at = first[none]
        bins, size = np.insert(bins, at, 0, axis=1), np.insert(size, at, 1)
        first = first + np.append(0, np.cumsum(np.diff(first) == 0))
    return bins, size, first


@dataclass
class Model:
    emission: np.ndarray  # for the line before, the line and the line after: weight of each feature's bin
    bias: float
    stay: np.ndarray  # for good and for bad: of the next line being the same
    curve: tuple[float, float]
    constant: float | None = None


def emissions(m: Model, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each line the log-odds of good from its features alone."""
    f = np.arange(N)[:, None]
    out = m.bias + m.emission[1][f, bins].sum(axis=0)
    inner = np.ones(bins.shape[1] + 1, bool)
    inner[first] = False
    inner = inner[1:-1]
    out[1:] += np.where(inner, m.emission[0][f, bins[:, :-1]].sum(axis=0), 0)
    out[:-1] += np.where(inner, m.emission[2][f, bins[:, 1:]].sum(axis=0), 0)
    return out


def _step(x: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Log-odds message to a neighbouring line."""
    return np.logaddexp(x + stay[0], 0) - np.logaddexp(x, stay[1])


def chains(s: np.ndarray, first: np.ndarray, stay: np.ndarray):
    """Messages from before and from after, for each line. Texts go side by side, line by line."""
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    begin, sizes = first[:-1][order], lens[order]
    fore, back = np.zeros(len(s)), np.zeros(len(s))
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    for t in range(1, len(alive)):
        p = begin[: alive[t]] + t
        fore[p] = _step(s[p - 1] + fore[p - 1], stay)
    for t in range(len(alive) - 2, -1, -1):
        p = begin[: alive[t + 1]] + t
        back[p] = _step(s[p + 1] + back[p + 1], stay)
    return fore, back


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def good_share(m: Model, bins, size, first) -> np.ndarray:
    """Each text's mean marginal of good, weighted by length."""
    s = emissions(m, bins, first)
    fore, back = chains(s, first, m.stay)
    p = sigmoid(s + fore + back)
    return np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1])


def log_odds(p):
    return np.log((p + 1e-4) / (1 - p + 1e-4))


def scores(m: Model, bins, size, first) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(first) - 1, m.constant)
    return sigmoid(m.curve[0] * log_odds(good_share(m, bins, size, first)) + m.curve[1])


def gradient(m: Model, bins: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted conditional log-likelihood, by the weights of the emissions, the bias and the two of staying."""
    inner = np.ones(len(label) + 1, bool)
    inner[first] = False
    inner = inner[1:-1]
    pair = weight[1:] * inner
    s = emissions(m, bins, first)
    fore, back = chains(s, first, m.stay)
    r = (label - sigmoid(s + fore + back)) * weight
    left, right = (s + fore)[:-1], (s + back)[1:]
    both = np.stack([left + right + m.stay[0], np.broadcast_to(m.stay[1], left.shape), left, right])
    both = np.exp(both - both.max(axis=0))
    both /= both.sum(axis=0)
    grad = np.empty(3 * N * BINS + 3)
    g = grad[:-3].reshape(3, N * BINS)
    shifted = (np.append(r[1:] * inner, 0), r, np.append(0, r[:-1] * inner))
    for side in range(3):
        for f in range(N):
            g[side, f * BINS : (f + 1) * BINS] = np.bincount(bins[f], shifted[side], minlength=BINS)
    grad[-3] = r.sum()
    one = label[1:] * label[:-1]
    none = (1 - label[1:]) * (1 - label[:-1])
    grad[-2], grad[-1] = (pair * (one - both[0])).sum(), (pair * (none - both[1])).sum()
    return grad


def fit(bins: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.3) -> Model:
    """Adam on the mean conditional log-likelihood of a line, with an L2 penalty."""
    zero = np.zeros((3, N, BINS))
    if not len(y) or y.min() == y.max():
        return Model(zero, 0.0, np.zeros(2), (1.0, 0.0), float(y.mean()) if len(y) else 0.5)
    m = Model(zero, 0.0, np.zeros(2), (1.0, 0.0))
    lens = np.diff(first)
    label = np.repeat(y, lens).astype(float)
    weight = np.repeat(1 / np.sqrt(lens), lens)  # long texts count, though not by all of their lines
    weight /= weight.sum()
    theta = np.zeros(3 * N * BINS + 3)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        m.emission, m.bias, m.stay = theta[:-3].reshape(3, N, BINS), theta[-3], theta[-2:]
        grad = gradient(m, bins, first, label, weight)
        grad -= 2e-5 * theta
        grad[-2:] -= 2e-3 * theta[-2:]
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad**2
        theta = theta + rate * (1 - step / (rounds + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    m.emission, m.bias, m.stay = theta[:-3].reshape(3, N, BINS), float(theta[-3]), theta[-2:]
    x = log_odds(good_share(m, bins, size, first))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method for the curve
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        ga, gb = ((y - p) * x).mean() - 1e-3 * (a - 1), (y - p).mean() - 1e-3 * b
        h = np.array([[(w * x * x).mean() + 1e-3, (w * x).mean()], [(w * x).mean(), w.mean() + 1e-3]])
        da, db = np.linalg.solve(h, [ga, gb])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    m.curve = (float(a), float(b))
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS) -> Model:
    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, off in K.chunks(batch.column(0)):
                bins, size, first = line_bins(data, off)
                for a, b in zip(first[:-1], first[1:]):
                    out.append((bins[:, a:b].tobytes(), size[a:b].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), batch.column(1)], ["bins", "size", "y"])

    rows = sample(docs, labels, "quality", most).mapInArrow(run, "bins binary, size binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r["bins"]), bytes(r["size"]), r["y"]))  # the same model whatever the order of rows
    if not rows:
        return fit(np.zeros((N, 0), np.uint8), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(N, -1) for r in rows], axis=1)
    size = np.concatenate([np.frombuffer(r["size"], np.int32) for r in rows])
    first = np.append(0, np.cumsum([len(r["size"]) // 4 for r in rows]))
    return fit(bins, size, first, np.array([r["y"] for r in rows], float))


def quality(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a score."""
    names = [c for c in docs.columns if c.lower() != into.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def run(batches):
        for batch in batches:
            out = [scores(model, *line_bins(data, off)) for _, _, data, off in K.chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, into])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{into}` double"]))


def op4_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = slim(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def slim(docs: DataFrame, model: Model) -> DataFrame:
    """Only doc_id and score: the texts don't come back from Python."""

    def run(batches):
        for batch in batches:
            out = [scores(model, *line_bins(data, off)) for _, _, data, off in K.chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
