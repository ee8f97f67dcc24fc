"""Near-duplicate documents by MinHash: one-permutation hashing, optimal densification, banded stars.

A document's set is its distinct shingles of five words. One hash per shingle fills 64 bins (the least
value of each); an empty bin takes the value of the bin that a fixed random probe sequence finds
first (optimal densification). Bands of four bins give bucket keys. Two sets of Jaccard
similarity 0.85 meet in one of the 16 bands but for one case in 100,000.

Equal sets are one class before anything else, so thousands of copies are one row. In a bucket, classes
are not paired with each other: each is tied to the bucket's centre, the class that meets most others in all buckets,
and candidates are confirmed on the full sets. That joins a group of near copies to its origin. What is still in
several components of a bucket is joined on its rare shingles (prefix filtering): by a common order of shingles, the rarest first, two
linked sets share one of the first 15 to 20 per cent of theirs. What so meets in different components, and can have enough in common by
its sizes and the shingle's places, is confirmed on full sets. The filter loses no link, and a passage that many texts
share, though it fills a bucket with unlike documents, makes no pairs of them: its shingles are frequent and come last.

Defined results: an empty table gives no rows; null or empty texts, and texts of separators only, have empty sets and are linked with
nothing; fewer words than a shingle are one shingle; equal rows of one doc_id are one document, and different texts
of one doc_id are documents of their own, of which more than one may be kept; rows without doc_id link with nothing. Other
columns are not read. A text is never cut, so an executor needs some 50 bytes of memory for each byte of the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import components, rows_per_batch, sized, table, with_given_ids, with_own_ids, written

SHINGLE, BINS, ROWS = 5, 64, 4
WORDS = K.byte_table(21, lower=True, zero=K.SPACES)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
PROBES = np.random.default_rng(22).integers(0, BINS, (4096, BINS))
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE):
    """The sorted distinct shingle hashes of each text of a chunk."""
    starts, _, first = K.spans(data, off, K.NOT_SPACE)
    h = K.word_hashes(data, starts, WORDS)
    g = K.ngrams(h, shingle)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            s = np.sort(g[a : b - shingle + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            yield K.Ranges(h[a:b], K.GRAM_BASE).of(np.array([0]), np.array([b - a])) + np.uint64(b - a)
        else:
            yield h[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bins of each set, densified; a row of EMPTY for an empty set."""
    sig = np.full((len(sets), BINS), EMPTY)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, EDGES)
            v = s[np.minimum(at, len(s) - 1)]
            full = (at < len(s)) & (v >> np.uint64(58) == EDGES >> np.uint64(58))
            sig[i, full] = v[full]
    hole = (sig == EMPTY) & (sig != EMPTY).any(axis=1)[:, None]
    source = sig.copy()
    for probe in PROBES:
        rows = np.flatnonzero(hole.any(axis=1))
        if not len(rows):
            return sig
        found = source[np.ix_(rows, probe)]
        fill = hole[rows] & (found != EMPTY)
        sig[rows] = np.where(fill, found, sig[rows])
        hole[rows] &= ~fill
    for i in np.flatnonzero(hole.any(axis=1)):  # not met in practice
        sig[i, hole[i]] = source[i].min()
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    n = BINS // ROWS
    parts = sig.reshape(len(sig), n, ROWS)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(K.WORD_BASE), (len(sig), n)).copy()
    for r in range(ROWS):
        key = K.mix(key * np.uint64(K.GRAM_BASE) + parts[:, :, r])
    return key


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows (doc_id, n, k1, k2, bands): set size, two hashes of the whole set, bucket keys."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in K.chunks(batch.column(1)):
                sets = list(shingle_sets(data, off, shingle))
                n = np.array([len(s) for s in sets], np.int64)
                k = [np.array([int(K.mix(s * np.uint64(m)).sum(dtype=np.uint64)) for s in sets], np.uint64) for m in (K.WORD_BASE, K.BASE_2)]
                keys = band_keys(signatures(sets)).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), *(pa.array(x.view(np.int64)) for x in k), bands], ["doc_id", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Those pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sides = []
                for c in (2, 3):
                    own = []
                    for _, _, data, off in K.chunks(part.column(c)):
                        own += shingle_sets(data, off, shingle)
                    sides.append(own)
                ok = []
                for x, y in zip(*sides):
                    if len(x) > len(y):
                        x, y = y, x
                    both = 0
                    if len(x):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int((y[at] == x).sum())
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shingle_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """rows (rep, n, h) of the distinct shingles of texts (rep, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, off in K.chunks(batch.column(1)):
                sets = list(shingle_sets(data, off, shingle))
                n = np.array([len(s) for s in sets], np.int64)
                if n.sum():
                    own = [np.repeat(ids[lo:hi], n), np.repeat(n, n), np.concatenate(sets).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], ["rep", "n", "h"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, n long, h long")


def rare_pairs(rest: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b) of different components of rest (rep, comp) that may be linked; none that is linked is left out.

    All shingles are put into one order, the rarest first. Of a set of n, the first n - ceil(n * percent / 100) + 1 are taken: two
    linked sets have one of these in common, and what follows their first common one suffices for the link. Shingles of a passage that many
    texts share are frequent, so they come last and are taken only where a text has hardly anything else.
    """
    own = written(shingle_rows(texts.join(rest.select("rep"), "rep"), shingle), "shingles")
    count = own.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    met = own.join(count, "h")
    by = Window.partitionBy("rep")
    placed = met.withColumn("at", F.row_number().over(by.orderBy("c", "h")) + F.col("n") - F.count("*").over(by))  # single ones come first
    first = placed.where(f"at <= n - cast(ceil(n * {percent} / 100) as long) + 1").join(rest, "rep").select("h", "rep", "comp", "n", "at")
    first = written(first, "rare")
    many = first.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    first = first.join(many, "h")
    left = first.select("h", *[F.col(c).alias(f"{c}1") for c in ("rep", "comp", "n", "at")])
    right = first.select("h", *[F.col(c).alias(f"{c}2") for c in ("rep", "comp", "n", "at")])
    enough = f"(1 + least(n1 - at1, n2 - at2)) * (100 + {percent}) >= {percent} * (n1 + n2)"
    pairs = left.join(right, "h").where(f"comp1 < comp2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {enough}")
    return pairs.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def components_of(docs: DataFrame, reps: DataFrame, percent: int, shingle: int) -> DataFrame | None:
    """Components (id, component) of the representatives with confirmed links; None if none can have any."""
    keys = reps.select("rep", "n", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    cand = written(keys.join(many, "key"), "buckets")
    weight = cand.groupBy("rep").agg(F.sum("m").alias("w"))
    members = written(weight, "members")
    count = members.count()
    if not count:
        return None
    cand = cand.drop("m").join(sized(members, 48, count), "rep")
    ids = members.select(F.col("rep").alias("doc_id"))
    texts = written(docs.select("doc_id", "text").join(sized(ids, 32, count), "doc_id").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "texts")
    centres = cand.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "rep", "n")).alias("c")).select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"))
    star = written(cand.join(centres, "key").where("rep <> centre"), "stars")
    pairs = star.where(f"100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    with rows_per_batch(docs.sparkSession, 1024):
        found = written(confirmed(pairs, texts, percent, shingle), "links")
    comp = components(found)
    rest = star.select("key", "rep", "n").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    still = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = written(rest.join(still, "key").select("rep", "comp").distinct(), "rest")
    pairs = written(rare_pairs(rest, texts, percent, shingle), "pairs")
    with rows_per_batch(docs.sparkSession, 1024):
        more = written(confirmed(pairs, texts, percent, shingle), "links")
    return components(found.union(more)) if more.limit(1).count() else comp


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """docs' doc_id with n_shingles, component_id and kept."""
    docs, own = with_own_ids(docs.select("doc_id", "text"))
    sk = written(sketches(docs, shingle), "sketches")
    classes = sk.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r"))
    classes = written(classes.select("k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands")), "classes")
    comp = components_of(docs, classes, percent, shingle)
    ids = classes.select("k1", "k2", "rep")
    if comp is not None:
        ids = ids.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    else:
        ids = ids.withColumnRenamed("rep", "c")
    out = sk.select("doc_id", "n", "k1", "k2").join(ids, ["k1", "k2"], "left")
    c = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = with_given_ids(out, own, "component_id")
    return out if own is None else out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
with recursive docs as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, hash(array_to_string(w[i : i + 4], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as x from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * x >= 85 * (p.n + q.n - x)),
reach as (select doc_id, doc_id as c from docs union select l.b, r.c from reach r join link l on l.a = r.doc_id where r.c < l.b),
comp as (select doc_id, min(c) as c from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.c as component_id, d.doc_id = c.c as kept
from docs d join comp c using (doc_id) left join n using (doc_id)
"""
