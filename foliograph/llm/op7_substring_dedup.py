"""Substring dedup over a log-structured fingerprint index.

The index is a folder of immutable runs and a manifest that names them. A run has a row (fp, n) for each anchor hash of the
windows of a batch, and how often it occurred, in ``buckets`` buckets by fp, sorted. A new batch becomes a run of its own (the only
shuffle), is merge-joined bucket by bucket with the older runs, which are neither shuffled nor sorted, to find the hashes
that occurred before; and runs of like level are compacted into one. ``FingerprintIndex`` on the folder of
an index opens it again, in any session. Matches are then verified on the texts (hashes over all words of a window and
its anchor, 128 bits together) before a word is removed; for that the texts of earlier batches are read again, by the
anchor hashes that met.

Defined results: an empty table gives no rows; a null or empty text has no words and is kept as it is; fewer words than a
window remove nothing; rows without doc_id take no part; equal rows of one doc_id count as one document, and
different texts of one doc_id as documents that follow each other by a hash of the text; columns of docs that have the name of
one of the three new columns are replaced, all others are left alone. A text is never cut, so an executor needs some
40 bytes of memory for each byte of the longest one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .repeats import Spec, covered, fingerprints, repeated, with_lists
from .shared import dropped, free, fresh_path, table, with_own_ids, written

WORDS = K.byte_table(71, zero=K.SPACES)


def word_units(data: np.ndarray, off: np.ndarray):
    starts, _, first = K.spans(data, off, K.NOT_SPACE)
    return K.word_hashes(data, starts, WORDS), first


def spec(window: int = 20) -> Spec:
    return Spec(word_units, window, max(1, min(5, window // 2)))


@contextmanager
def whole_buckets(spark: SparkSession):
    """Buckets are joined as they lie: no plan may coalesce or broadcast them."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


class FingerprintIndex:
    """Sorted immutable runs in a folder; fan_in runs of one level are compacted into one of the next."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.path, self.fan_in = spark, path or fresh_path(spark, "index"), fan_in
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[tuple[int, str]] = []  # level, name
        at = self._fs().getFileSystem(spark._jsc.hadoopConfiguration())
        if at.exists(self._fs("manifest.json")):
            said = json.loads("\n".join(r[0] for r in spark.read.text(f"{self.path}/manifest.json").collect()))
            self.fan_in, self.buckets, self.runs = said["fan_in"], said["buckets"], [tuple(x) for x in said["runs"]]
            for _, name in self.runs:
                spark.sql(f"create table if not exists {name} (fp bigint, n bigint) using parquet clustered by (fp) sorted by (fp) into {self.buckets} buckets location '{self.path}/{name}'")

    def _fs(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _save(self) -> None:
        """The manifest is replaced as a whole, so a run counts only once all of it is there."""
        conf = self.spark._jsc.hadoopConfiguration()
        fs = self._fs().getFileSystem(conf)
        fs.mkdirs(self._fs())
        out = fs.create(self._fs("manifest.json.new"), True)
        out.write(bytearray(json.dumps({"fan_in": self.fan_in, "buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()
        fs.delete(self._fs("manifest.json"), False)
        fs.rename(self._fs("manifest.json.new"), self._fs("manifest.json"))

    def _run(self, counts: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex[:16]}"
        counts.sortWithinPartitions("fp").write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def older(self, run: DataFrame) -> DataFrame:
        """Those hashes (fp) of a run that an older run has; every run is read bucket by bucket."""
        found = None
        for _, name in self.runs:
            met = run.select("fp").join(self.spark.table(name).select("fp").hint("merge"), "fp", "left_semi")
            found = met if found is None else found.union(met)
        return run.select("fp").limit(0) if found is None else found

    def add(self, fps: DataFrame) -> DataFrame:
        """Add a batch of fingerprints (fp); returns those (fp) that occurred before or twice in it."""
        with whole_buckets(self.spark):
            # Counted by fp, so at most a row for each task and hash is shuffled, and into the buckets themselves.
            had = self.spark.conf.get("spark.sql.shuffle.partitions")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.buckets))
            try:
                name = self._run(fps.groupBy("fp").agg(F.count("*").alias("n")))
            finally:
                self.spark.conf.set("spark.sql.shuffle.partitions", had)
            run = self.spark.table(name)
            found = written(run.where("n > 1").select("fp").union(self.older(run)).distinct(), "found")
        self.runs.append((0, name))
        self._save()
        return found

    def compact(self) -> None:
        while True:
            levels = [lv for lv, _ in self.runs]
            lv = next((x for x in levels if levels.count(x) >= self.fan_in), None)
            if lv is None:
                return
            old = [name for x, name in self.runs if x == lv]
            with whole_buckets(self.spark):
                both = self.spark.table(old[0]).withColumnRenamed("n", "n0")
                for k, name in enumerate(old[1:], 1):  # a merge of sorted buckets, without a shuffle
                    both = both.join(self.spark.table(name).withColumnRenamed("n", f"n{k}").hint("merge"), "fp", "full")
                total = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(len(old))), F.lit(0).cast("long"))
                merged = self._run(both.select("fp", total.alias("n")))
            self.runs = [(x, name) for x, name in self.runs if x != lv] + [(lv + 1, merged)]
            self._save()
            for name in old:
                self.spark.sql(f"drop table if exists {name}")
            dropped(self.spark, [f"{self.path}/{name}" for name in old])


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """docs in runs of ascending doc_id; a filter on doc_id reaches the scan."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("q")).first()["q"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    out, low = [], None
    for c in [*cuts, None]:
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if c is not None:
            part = part.where(F.col("doc_id") <= c)
        out.append(part)
        low = c
    return out


def find(docs: DataFrame, window: int = 20, batches: int = 2, index: FingerprintIndex | None = None, before: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, spans) of window starts of docs that occurred before.

    before: the documents (doc_id, text) of the batches that the index already has, all of lesser doc_ids than docs.
    """
    index = index or FingerprintIndex(docs.sparkSession)
    sp, found = spec(window), None
    for part in batches_of(docs, batches):
        hit = index.add(fingerprints(part, sp))
        index.compact()
        found = hit if found is None else found.union(hit)
    every = docs.select("doc_id", "text")
    return repeated(every if before is None else before.select("doc_id", "text").union(every), sp, written(found.distinct(), "matched"), later=True)


def dedup(docs: DataFrame, window: int = 20, batches: int = 2, into: tuple[str, str, str] = ("n_words", "n_removed", "kept"), index: FingerprintIndex | None = None, before: DataFrame | None = None) -> DataFrame:
    """docs with three more columns: words, words removed, and the words that stay, joined by a space."""
    lost = {c.lower() for c in into}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in lost])
    names = docs.columns
    types = [f"`{n}` {t}" for n, t in docs.dtypes]
    given = free([*names, *into], "given")
    own, ids = with_own_ids(docs.withColumn(given, F.col("doc_id"))) if before is None else (docs.withColumn(given, F.col("doc_id")), None)
    spans = free([*names, *into, given], "spans")
    joined = with_lists(own, find(own, window, batches, index, before).withColumnRenamed("spans", spans), spans)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            lists = batch.column(len(names))
            for lo, hi, data, off in K.chunks(batch.column(at)):  # a small batch for each chunk bounds the memory
                n_words, n_removed, kept = [], [], []
                starts, ends, first = K.spans(data, off, K.NOT_SPACE)
                raw = data.tobytes()
                for d in range(hi - lo):
                    a, b = first[d], first[d + 1]
                    own = lists[lo + d].as_py()
                    n_words.append(b - a)
                    if own:
                        keep = ~covered(b - a, np.array(own, np.int64), window)
                        n_removed.append(int(b - a - keep.sum()))
                        kept.append(b" ".join(raw[starts[i] : ends[i]] for i in a + np.flatnonzero(keep)))
                    else:
                        n_removed.append(0)
                        kept.append(b" ".join(raw[off[d] : off[d + 1]].translate(TO_SPACE).split()))
                extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *extra], [*names, *into])

    columns = [F.col(given).alias("doc_id") if n == "doc_id" else F.col(f"`{n}`") for n in names]
    return joined.select(*columns, spans).mapInArrow(run, ", ".join([*types, f"`{into[0]}` long", f"`{into[1]}` long", f"`{into[2]}` string"]))


#: bytes.split() breaks at exactly the six separators.
TO_SPACE = bytes(32 if i in K.SPACES else i for i in range(256))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
with docs as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from docs where len(w) >= 20),
win as (select doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) as h from starts),
dup as (select doc_id, i from (select *, row_number() over (partition by h order by doc_id, i) as r from win) where r > 1),
gone as (select distinct doc_id, i + o as p from dup, (select unnest(range(0, 20)) as o)),
lost as (select doc_id, list(p) as ps from gone group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(len(l.ps), 0)::bigint as n_removed,
 sha256(array_to_string(list_filter(d.w, lambda x, k: l.ps is null or not list_contains(l.ps, k)), ' ')) as kept_sha256
from docs d left join lost l using (doc_id)
"""
