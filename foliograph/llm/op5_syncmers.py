"""Document fingerprints from closed syncmers.

A 24-byte string of a text is an anchor if the least hash of its 8-byte strings is that of the first or the last
of them. Whether it is depends on nothing around it, so equal passages have equal anchors wherever they
stand. The fingerprint keeps the 64 least of a text's distinct anchor hashes (48 bits each), ascending, each with the place where
it first stands (in bytes): ``hash@place``, in hexadecimal. Two texts are matched by position: of the anchors that both fingerprints hold,
those count that follow each other in the same order in both (the longest such chain), as a share of the 64 least hashes of
both together. So passages that stand elsewhere, or frequent strings here and there, add little.

Texts of under 512 bytes have few anchors or none, and so have a second sketch, of anchors of 6 bytes (3 inside), in their
fingerprint after a bar. Two such texts are compared by it; if one of the two is longer, both are compared by the anchors of 24
bytes, so never different kinds with each other.

For ``with_next`` documents are dealt by ranges of doc_id, whose bounds are ids found in the table, and sorted in each;
the first document of a range is also sent to the range before as its last neighbour. The number of ranges and the rows of
one grow with the table, each as the square root beyond two million rows; a range is read as it streams by.

Defined results: an empty table gives no rows; a null or empty text has an empty fingerprint, which is like an empty one (1) and unlike
others (0); a text without anchors of a kind has its own hash as the only one; rows that repeat a doc_id follow each other in the order of
their texts' hashes; rows without doc_id come first, and the last document is followed by the first that has one; other columns are not
read. A text is never cut, so an executor needs some 60 bytes of memory for each byte of the longest one.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import table

K_LEN, S_LEN, KEEP = 24, 8, 64
SHORT, SHORT_K, SHORT_S = 512, 6, 3
BYTES = K.mix(K.byte_table(51).copy())
CHAR = (np.arange(256) & 0xC0) != 0x80
RANGE_ROWS, BOUND_SAMPLES = 1500, 8


def anchors(data: np.ndarray, off: np.ndarray, k: int = K_LEN, inner: int = S_LEN) -> tuple[np.ndarray, np.ndarray]:
    """(place in the chunk, hash) of the closed syncmers of its texts."""
    b = BYTES[data]
    v = K.ngrams(b, inner)
    w = k - inner + 1
    least = K.sliding_argmin(v, w)
    i = np.arange(len(least), dtype=np.int32)
    at = np.flatnonzero((least == i) | (least == i + (w - 1)))
    text = K.texts_of(off, at)
    at = at[at + k <= off[text + 1]]
    return at, K.Ranges(b, K.BASE_2).of(at, at + k)


Sketch = tuple[np.ndarray, np.ndarray]  # hashes, ascending; the place of each


def sketches(data: np.ndarray, off: np.ndarray) -> list[tuple[Sketch, Sketch | None]]:
    """The KEEP least distinct anchors of each text; of a short text also its short anchors."""
    at, h = anchors(data, off)
    cut = np.searchsorted(at, off)
    few = np.flatnonzero(np.diff(off) < SHORT)
    more = {}
    if len(few):
        part = np.concatenate([data[off[d] : off[d + 1]] for d in few])
        ends = np.append(0, np.cumsum(off[few + 1] - off[few]))
        at2, h2 = anchors(part, ends, SHORT_K, SHORT_S)
        cut2 = np.searchsorted(at2, ends).tolist()
        more = {d: (at2[a:b] - e, h2[a:b]) for d, e, a, b in zip(few.tolist(), ends.tolist(), cut2[:-1], cut2[1:])}
    whole = K.Ranges(BYTES[data], K.BASE_2).of(off[:-1], off[1:])
    return [(least(at[cut[d] : cut[d + 1]] - off[d], h[cut[d] : cut[d + 1]], whole[d], off[d + 1] - off[d]), least(*more[d], whole[d], off[d + 1] - off[d]) if d in more else None) for d in range(len(off) - 1)]


def least(at: np.ndarray, h: np.ndarray, whole: np.uint64, size: int) -> Sketch:
    """The KEEP least of the hashes with the first place of each; a text without anchors has that of itself."""
    if not len(h):
        at, h = (np.zeros(1, np.int64), np.array([whole], np.uint64)) if size else (at[:0], h[:0])
    h = h >> np.uint64(16)
    if len(h) > 4 * KEEP:  # only these can be among the least distinct ones, unless few are distinct
        near = h <= np.partition(h, 4 * KEEP - 1)[4 * KEEP - 1]
        if len(np.unique(h[near])) >= KEEP:
            at, h = at[near], h[near]
    h, first = np.unique(h, return_index=True)
    return h[:KEEP], at[first[:KEEP]]


def text_of(sketch: tuple[Sketch, Sketch | None]) -> str:
    return "|".join(" ".join(f"{x:012x}@{p:x}" for x, p in zip(part[0].tolist(), part[1].tolist())) for part in sketch if part is not None and len(part[0]))


def chain(places: list[int]) -> int:
    """How many of the places are in ascending order, at most."""
    ends: list[int] = []
    for p in places:
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def likeness(one: tuple, other: tuple) -> float:
    """Of the least KEEP hashes of both together, the share that both have in the same order; anchors of one kind."""
    kind = int(one[1] is not None and other[1] is not None)
    (a, pa_), (b, pb) = one[kind], other[kind]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    last = np.union1d(a, b)[:KEEP]
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = both <= last[-1]
    i, j = i[near], j[near]
    order = np.argsort(pa_[i], kind="stable")
    return chain(pb[j[order]].tolist()) / len(last)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' doc_id with fingerprint."""

    def run(batches):
        for batch in batches:
            out = [text_of(s) for _, _, data, off in K.chunks(batch.column(1)) for s in sketches(data, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def ranged(docs: DataFrame) -> DataFrame:
    """rows (part, guest, doc_id, text), a part's rows together and in order; a guest follows a part's last row."""
    ids = docs.where("doc_id is not null").select("doc_id")
    n = ids.count()
    if not n:
        return docs.where("doc_id is null").select(F.lit(0).alias("part"), F.lit(0).alias("guest"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(n // max(RANGE_ROWS, math.isqrt(n))))
    step = max(1, n // (BOUND_SAMPLES * parts))
    some = sorted({r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(step)) == 0).distinct().collect()})  # about BOUND_SAMPLES * parts
    bounds = np.array(sorted({ids.agg(F.min("doc_id")).first()[0], *(some[BOUND_SAMPLES::BOUND_SAMPLES])}), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    @F.pandas_udf("boolean")
    def is_bound(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.to_numpy(np.int64), bounds))

    known, some_id = F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long"))
    low, n = int(bounds[0]), len(bounds)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", F.when(known, range_of(some_id)).otherwise(0)).withColumn("first", known & is_bound(some_id))
    to = f"concat(array(struct(own as part, 0 as guest)), if(first, array(struct(own - 1 as part, 1 as guest)), array()), if(doc_id = {low}L, array(struct({n} as part, 2 as guest)), array()))"
    rows = rows.withColumn("to", F.explode(F.expr(to))).select("to.part", "to.guest", "doc_id", "text")
    return rows.repartition("part").sortWithinPartitions("part", "guest", "doc_id", F.xxhash64("text")).select("part", "guest", "doc_id", "text")


NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document."""

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns)], batch.schema.names)
            # Copies, as the batch before must not be kept alive by a slice of it.
            held = [pa.array(c.slice(len(c) - 1).to_pylist(), c.type) for c in batch.columns]
            lo = 0
            _, offs = K.buffers(batch.column(3))
            while lo < len(batch) - 1:
                hi = min(len(batch), max(lo + 2, int(np.searchsorted(offs, offs[lo] + K.CHUNK, "right"))))
                yield pairs(batch.slice(lo, hi - lo))
                lo = hi - 1

    def pairs(batch):
        part, guest, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        raw, off = K.buffers(batch.column(3))
        data, off = raw[off[0] : off[-1]], off - off[0]
        chars = np.append(np.flatnonzero(CHAR[data]), len(data))
        first = np.searchsorted(chars, off)
        n = np.diff(first)
        own = np.flatnonzero((guest[:-1] == 0) & (part[1:] == part[:-1]))
        half = n[own] // 2
        stop = chars[first[own] + n[own] - half]
        take = chars[first[own + 1] + np.minimum(half, n[own + 1])]
        whole = data.tobytes()
        edited = [whole[off[i] : a] + whole[off[i + 1] : b] for i, a, b in zip(own.tolist(), stop.tolist(), take.tolist())]
        sk = sketches(data, off)
        ed = [s for _, _, d, o in K.chunks(pa.array(edited, pa.binary()).cast(pa.string())) for s in sketches(d, o)]
        cols = [
            batch.column(2).take(pa.array(own)), pa.array(n[own], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([text_of(sk[i]) for i in own], pa.string()), pa.array([text_of(s) for s in ed], pa.string()),
            pa.array([likeness(sk[i], s) for i, s in zip(own, ed)], pa.float64()), pa.array([likeness(sk[i], sk[i + 1]) for i in own], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ranged(docs).mapInArrow(run, NEXT)


def op5_syncmers(spark, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
