"""Removal of every byte that lies in a 400-byte string which also starts elsewhere in the corpus.

Texts are taken as UTF-8 bytes; strings never cross documents. See ``repeats`` for the search, which is exact.

Defined results: an empty table gives no rows; a null or empty text has no bytes; rows without doc_id take no part and keep all; rows
that repeat a doc_id are documents of their own, so equal ones repeat each other, and different ones don't share what is removed; other columns
are not read. A text is never cut, so an executor needs some 40 bytes of memory for each byte of the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .repeats import Spec, covered, fingerprints, repeated, with_lists
from .shared import table, with_own_ids, written

BYTES = K.mix(K.byte_table(61).copy())


def byte_units(data: np.ndarray, off: np.ndarray):
    return BYTES[data], off


def spec(width: int = 400) -> Spec:
    return Spec(byte_units, width, max(1, min(32, width // 2)), max(1, width // 9))


def find(docs: DataFrame, width: int = 400) -> DataFrame:
    """rows (doc_id, spans) of starts of strings that also start elsewhere."""
    sp = spec(width)
    matched = fingerprints(docs, sp).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    return repeated(docs, sp, written(matched, "matched"), later=False)


def removed(docs: DataFrame, width: int = 400) -> DataFrame:
    """rows (doc_id, n_bytes, n_removed, n_spans, kept): kept is binary."""
    kind = dict(docs.dtypes)["doc_id"]
    docs, _ = with_own_ids(docs.select("doc_id", "text", F.col("doc_id").alias("given")))
    joined = with_lists(docs, find(docs, width), "spans").select("given", "text", "spans")

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):  # a small batch for each chunk bounds the memory
                out = []
                for d, own in enumerate(batch.column(2).slice(lo, hi - lo)):
                    text, n = data[off[d] : off[d + 1]], int(off[d + 1] - off[d])
                    if own.is_valid:
                        gone = covered(n, own.values.to_numpy(zero_copy_only=False), width)
                        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                        out.append((n, int(gone.sum()), runs, text[~gone].tobytes()))
                    else:
                        out.append((n, 0, 0, text.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(v, k) for v, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
