"""Exact search for windows of units (words or bytes) that occur more than once in a corpus.

Every window of ``width`` units has an *anchor*: its k-gram with the least hash, the leftmost of
equals. Equal windows have equal anchors at the same place, so only windows whose anchors' hash occurs
again can repeat. Consecutive windows with one anchor form a *record*; there are about
2 / (width - k + 2) records a unit. From records to exact results:

1. records whose anchor hash occurs once are dropped;
2. records with one anchor hash and equal content (another 64-bit hash, of all their units and the
   anchor's place) form a class: all windows of a class of several records repeat;
3. where an anchor hash has several classes, which happens at the ends of copied stretches, one
   record of each class gives all its windows (128-bit content hashes), and equal ones meet. For wide
   windows, contexts of the anchor of a few lengths are compared first; how far to the left and the right
   any other class agrees bounds the windows that can repeat, and only those are given.

No pair of documents is ever formed: every step is an equi-join or a pre-aggregated group-by on
content hashes, so a passage that a third of the corpus shares costs a row for each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import sized, written

#: Units of a chunk: (hash of each unit, for each text and one more the index of its first unit).
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
RECORD = "fp long, r long, doc_id long, at long"
#: at: first window start times 4096 plus the number of further windows of the record.
WIDE = 12


@dataclass(frozen=True)
class Spec:
    units: Units
    width: int
    k: int
    stride: int = 0  # of the lengths of contexts; 0: they aren't compared
    chunk: int = K.CHUNK


def records_of(h: np.ndarray, off: np.ndarray, spec: Spec, slim: bool = False):
    """(text, anchor hash, first and last window start, content hash) of each record of a chunk."""
    w, k = spec.width, spec.k
    if len(h) < w:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z, z, z.view(np.uint64)
    g = K.ngrams(h, k)
    anchor = K.sliding_argmin(g, w - k + 1)
    lens = np.diff(off)
    fits = np.arange(len(anchor)) + w <= np.repeat(off[1:], lens)[: len(anchor)]
    starts = np.flatnonzero(fits)
    a = anchor[starts]
    new = np.empty(len(a), bool)
    new[:1] = True
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1 if len(first) else first
    s, e, b = starts[first], starts[last], a[first]
    fp = g[b]
    if slim:
        return fp
    r = K.Ranges(K.mix(h), K.BASE_2).of(s, e + w) + (b - s).astype(np.uint64)
    return K.texts_of(off, s), fp, s, e, r


def fingerprints(docs: DataFrame, spec: Spec) -> DataFrame:
    """The anchor hash of each record: rows (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in K.chunks(batch.column(0), spec.chunk):
                fp = records_of(*spec.units(data, off), spec, True)
                if isinstance(fp, np.ndarray) and len(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], ["fp"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "fp long")


def records(docs: DataFrame, spec: Spec) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, off in K.chunks(batch.column(1), spec.chunk):
                h, first = spec.units(data, off)
                t, fp, s, e, r = records_of(h, first, spec)
                if len(t):
                    at = (s - first[t] << WIDE) + (e - s)
                    cols = [fp.view(np.int64), r.view(np.int64), ids[lo + t].astype(np.int64), at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "r", "doc_id", "at"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, RECORD)


def windows(docs: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """All windows of the wanted records (doc_id, at): rows (w1, w2, doc_id, i)."""
    by_doc = written(wanted.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("at")), "wanted")
    docs = with_lists(docs.select("doc_id", "text"), by_doc, "at", "inner")

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            flat = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            fs = flat >> WIDE
            fe = fs + (flat & (1 << WIDE) - 1)
            n_at = np.append(0, np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False)))
            for lo, hi, data, off in K.chunks(batch.column(1), spec.chunk):
                h, first = spec.units(data, off)
                s, e = fs[n_at[lo] : n_at[hi]], fe[n_at[lo] : n_at[hi]]
                text = np.repeat(np.arange(hi - lo), np.diff(n_at[lo : hi + 1]))
                n = e - s + 1
                i = np.repeat(s - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                t = np.repeat(text, n)
                p = first[t] + i
                w1 = K.Ranges(h, K.GRAM_BASE).of(p, p + spec.width)
                w2 = K.Ranges(K.mix(h), K.BASE_2).of(p, p + spec.width)
                cols = [w1.view(np.int64), w2.view(np.int64), ids[lo + t].astype(np.int64), i.astype(np.int32)]
                for a in range(0, len(t), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in cols], ["w1", "w2", "doc_id", "i"])

    return docs.mapInArrow(run, "w1 long, w2 long, doc_id long, i int")


def narrowed(docs: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """The wanted records with only those windows that the contexts of their anchors leave possible."""
    by_doc = written(wanted.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("at")), "wanted")
    rows = with_lists(docs.select("doc_id", "text"), by_doc, "at", "inner")
    lengths = np.arange(spec.stride, spec.width + 1, spec.stride)

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            flat = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n_at = np.append(0, np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False)))
            for lo, hi, data, off in K.chunks(batch.column(1), spec.chunk):
                h, first = spec.units(data, off)
                own = flat[n_at[lo] : n_at[hi]]
                text = np.repeat(np.arange(hi - lo), np.diff(n_at[lo : hi + 1]))
                g = K.ngrams(h, spec.k)
                b = K.sliding_argmin(g, spec.width - spec.k + 1)[first[text] + (own >> WIDE)].astype(np.int64)
                hashes = K.Ranges(h, K.GRAM_BASE)
                for j in lengths:
                    for side in (0, 1):
                        start, stop = (b - j, b) if side == 0 else (b, b + j)
                        ok = np.flatnonzero((start >= first[text]) & (stop <= first[text + 1]))
                        key = K.mix(hashes.of(start[ok], stop[ok]) + g[b[ok]] * np.uint64(K.BASE_2) + np.uint64(2 * j + side))
                        cols = [key.view(np.int64), ids[lo + text[ok]].astype(np.int64), own[ok], b[ok] - first[text[ok]], np.full(len(ok), 2 * j + side, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "doc_id", "at", "b", "side"])

    contexts = written(rows.mapInArrow(run, "h long, doc_id long, at long, b long, side int"), "contexts")
    met = contexts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    most = lambda side: F.coalesce(F.max(F.when(F.col("side") % 2 == side, F.col("side") / 2)), F.lit(0)).cast("int") + spec.stride - 1
    far = contexts.join(met, "h").groupBy("doc_id", "at", "b").agg(most(0).alias("left"), most(1).alias("right"))
    s, e = F.shiftright("at", WIDE), F.shiftright("at", WIDE) + F.col("at").bitwiseAND((1 << WIDE) - 1)
    far = far.withColumn("s", F.greatest(s, F.col("b") - F.col("left"))).withColumn("e", F.least(e, F.col("b") + F.col("right") - spec.width))
    return far.where("s <= e").select("doc_id", F.expr(f"shiftleft(s, {WIDE}) + (e - s) as at"))


#: A class of over this part of all records is hot; there are fewer than HOT of them, so they may be broadcast.
HOT = 4000


def with_classes(seen: DataFrame, classes: DataFrame, records: int) -> DataFrame:
    """seen (fp, r, ...) joined with classes (fp, r, n, ...): hot classes by broadcast, so that none of their rows is shuffled."""
    hot = F.broadcast(classes.where(F.col("n") * HOT > records))
    cold = classes.where(F.col("n") * HOT <= records)
    marks = hot.select("fp", "r", F.lit(True).alias("hot_"))
    rest = seen.join(marks, ["fp", "r"], "left").where("hot_ is null").drop("hot_")
    return seen.join(hot, ["fp", "r"]).unionByName(rest.join(cold, ["fp", "r"]))


def repeated(docs: DataFrame, spec: Spec, matched: DataFrame, later: bool) -> DataFrame:
    """Window starts to remove: rows (doc_id, spans: array of [a, b], first and last start of a run).

    matched: rows (fp), anchor hashes that occur more than once. later: only windows that also start
    earlier, by doc_id and place; else every window that also starts elsewhere.
    """
    seen = written(records(docs, spec).join(matched, "fp"), "records")
    classes = seen.groupBy("fp", "r").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("f"))
    classes = written(classes, "classes")
    mixed = classes.groupBy("fp").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    mixed = mixed.where("c > 1" if later else "c > 1 and least = 1").select("fp")
    edges = classes.join(mixed, "fp").select("f.*")
    if spec.stride:
        edges = narrowed(docs, edges, spec)
    whole = with_classes(seen, classes.where("n > 1"), seen.count())
    if later:  # a class's first record stays: as a null, which no list takes up
        whole = whole.withColumn("at", F.when(F.expr("doc_id <> f.doc_id or at <> f.at"), F.col("at")))
    single = written(windows(docs, edges, spec), "windows")
    met = single.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "i")).alias("f")).where("n > 1")
    parts = single.join(met, ["w1", "w2"])
    if later:
        parts = parts.where("doc_id <> f.doc_id or i <> f.i")
    spans = whole.select("doc_id", "at").union(parts.selectExpr("doc_id", f"shiftleft(cast(i as long), {WIDE}) as at"))
    return written(spans.groupBy("doc_id").agg(F.collect_list("at").alias("at")).where("size(at) > 0").mapInArrow(merged, "doc_id long, spans array<long>"), "spans")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjoining spans of window starts as one: first * 2**32 + last."""
    for batch in batches:
        out = []
        for x in batch.column(1):
            at = np.sort(x.values.to_numpy(zero_copy_only=False))
            a = at >> WIDE
            b = np.maximum.accumulate(a + (at & (1 << WIDE) - 1))
            cut = np.flatnonzero(np.append(True, a[1:] > b[:-1] + 1))
            out.append((a[cut] << 32) + b[np.append(cut[1:], len(b)) - 1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "spans"])


def covered(n: int, spans: np.ndarray, width: int) -> np.ndarray:
    """Which of n units lie in a window whose start is in a span."""
    add = np.zeros(n + 1, np.int32)
    if len(spans):
        np.add.at(add, np.minimum(spans >> 32, n), 1)
        np.add.at(add, np.minimum((spans & 0xFFFFFFFF) + width, n), -1)
    return np.cumsum(add[:-1]) > 0


def with_lists(docs: DataFrame, lists: DataFrame, column: str, how: str = "left") -> DataFrame:
    """docs with their lists of longs; the texts move only where the lists are too many to broadcast."""
    size = lists.agg(F.count("*").alias("n"), F.sum(F.size(F.col(column))).alias("k")).first()
    return docs.join(sized(lists, 1, 96 * size["n"] + 8 * (size["k"] or 0)), "doc_id", how).select(*docs.columns, column)
