"""Candidate windows: which texts may explain which anchors. Pairs are formed near anchors only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ANCHORS = ("Table", "Image")
WINDOW = 3


def context_windows(nodes: DataFrame, window: int = WINDOW, anchors=ANCHORS, boundaries=ANCHORS) -> DataFrame:
    """rows (doc, artifact, anchor, candidate, ord): up to ``window`` texts on either side of an anchor, not past a boundary.

    Texts are numbered between boundaries, so a window is a bounded lookup: each anchor asks for the
    numbers it may have, and an equi-join on (scope, stretch, number) answers.
    """
    w = W.partitionBy("doc", "artifact").orderBy("ord")
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(upto), F.lit(0))
    is_text, is_bound = F.col("type") == "Text", F.col("type").isin(*boundaries) if boundaries else F.lit(False)
    df = nodes.withColumn("b_", count(is_bound)).withColumn("x_", count(is_text))
    texts = df.where(is_text).select("doc", "artifact", F.col("b_").alias("stretch"), F.col("x_").alias("number"), F.col("id").alias("candidate"), "ord")
    here = df.where(F.col("type").isin(*anchors))
    own_text = F.when(is_text, 1).otherwise(0)
    own_bound = F.when(is_bound, 1).otherwise(0)
    left = F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.struct(F.col("b_").alias("stretch"), (F.col("x_") - k).alias("number")))
    right = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.struct((F.col("b_") + own_bound).alias("stretch"), (F.col("x_") + own_text + k).alias("number")))
    asks = here.select("doc", "artifact", F.col("id").alias("anchor"), F.explode(F.array_union(left, right)).alias("a")).select("doc", "artifact", "anchor", "a.*")
    return asks.join(texts, ["doc", "artifact", "stretch", "number"]).where("anchor <> candidate").select("doc", "artifact", "anchor", "candidate", "ord")


def gap(a: str, b: str) -> Column:
    """Distance of two boxes: the sum of their gaps in x and y."""
    g = lambda lo, hi: F.greatest(F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"), F.lit(0))
    return g("x_min", "x_max") + g("y_min", "y_max")


def centre_distance(a: str, b: str) -> Column:
    """Twice the L1 distance of two boxes' centres, a whole number."""
    d = lambda lo, hi: F.abs(F.col(f"{a}.{lo}") + F.col(f"{a}.{hi}") - F.col(f"{b}.{lo}") - F.col(f"{b}.{hi}"))
    return d("x_min", "x_max") + d("y_min", "y_max")


def nearest_texts(nodes: DataFrame, k: int = WINDOW, anchors=ANCHORS) -> DataFrame:
    """rows (doc, artifact, anchor, candidate, rank): the k texts of the scope nearest to an anchor, by gap, then centres, then order."""
    a = nodes.where(F.col("type").isin(*anchors)).select("doc", "artifact", F.col("id").alias("anchor"), F.col("bbox").alias("ab"))
    t = nodes.where("type = 'Text'").select("doc", "artifact", F.col("id").alias("candidate"), F.col("bbox").alias("tb"), "ord")
    pairs = a.join(t, ["doc", "artifact"]).withColumn("rank", F.row_number().over(W.partitionBy("doc", "artifact", "anchor").orderBy(gap("ab", "tb"), centre_distance("ab", "tb"), "ord")))
    return pairs.where(F.col("rank") <= k).select("doc", "artifact", "anchor", "candidate", "rank")


def row_siblings(windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors on one row of a sheet share their candidates: rows (doc, artifact, anchor, candidate)."""
    rows = nodes.where(F.col("type").isin(*ANCHORS) & F.col("row").isNotNull()).select("doc", "artifact", F.col("id").alias("anchor"), "row")
    own = windows.join(rows, ["doc", "artifact", "anchor"]).select("doc", "artifact", "row", "candidate").distinct()
    shared = rows.join(own, ["doc", "artifact", "row"]).select("doc", "artifact", "anchor", "candidate")
    return windows.select("doc", "artifact", "anchor", "candidate").unionByName(shared).distinct()


def without_captions(windows: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that aren't the source of a caption or reference yet."""
    used = edges.where("type in ('CAPTION_OF', 'REFERENCES')").select("doc", F.col("source").alias("candidate")).distinct()
    return windows.join(used, ["doc", "candidate"], "left_anti")


def grown(before: DataFrame, after: DataFrame) -> DataFrame:
    """Anchors whose candidates grew: rows (doc, anchor, n_new)."""
    keys = ["doc", "anchor", "candidate"]
    return after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").groupBy("doc", "anchor").agg(F.count("*").alias("n_new"))
