"""Boxes: overlap, containment, clusters, suppression. Pairs are formed within a page only, blocked by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELL = 250


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.cast("int").alias("x_min"), y0.cast("int").alias("y_min"), x1.cast("int").alias("x_max"), y1.cast("int").alias("y_max"))


def normalised(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Whole units of a thousandth of the page, halves to the even one."""
    return box(F.rint(x0 / width * 1000), F.rint(y0 / height * 1000), F.rint(x1 / width * 1000), F.rint(y1 / height * 1000))


def area(b: str) -> Column:
    return (F.col(f"{b}.x_max") - F.col(f"{b}.x_min")) * (F.col(f"{b}.y_max") - F.col(f"{b}.y_min"))


def shared_area(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")), F.lit(0))
    return side("x_min", "x_max") * side("y_min", "y_max")


def iou(a: str, b: str) -> Column:
    i = shared_area(a, b)
    u = area(a) + area(b) - i
    return F.when(i > 0, i / u).otherwise(F.lit(0.0))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.x_min") < F.col(f"{b}.x_max")) & (F.col(f"{b}.x_min") < F.col(f"{a}.x_max")) & (F.col(f"{a}.y_min") < F.col(f"{b}.y_max")) & (F.col(f"{b}.y_min") < F.col(f"{a}.y_max"))


def union_box(b: str) -> Column:
    return box(F.min(f"{b}.x_min"), F.min(f"{b}.y_min"), F.max(f"{b}.x_max"), F.max(f"{b}.y_max"))


def cells(b: str, pad: int = 0, cell: int = CELL) -> Column:
    """The grid cells that a box touches, as x * 4096 + y."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"{b}.{lo}") - pad) / cell), F.floor((F.col(f"{b}.{hi}") + pad) / cell))
    return F.flatten(F.transform(span("x_min", "x_max"), lambda x: F.transform(span("y_min", "y_max"), lambda y: x * 4096 + y)))


def close_pairs(boxes: DataFrame, pad: int = 0) -> DataFrame:
    """rows (page, a, b, ab, bb) with a < b of boxes (page, id, bbox) within pad of one another or nearer, by shared grid cells."""
    g = boxes.select("page", "id", "bbox", F.explode(cells("bbox", pad)).alias("cell"))
    a, b = (g.select("page", "cell", F.col("id").alias(n), F.col("bbox").alias(f"{n}b")) for n in "ab")
    return a.join(b, ["page", "cell"]).where("a < b").drop("cell").distinct()


def iou_pairs(boxes: DataFrame, least: float) -> DataFrame:
    return close_pairs(boxes).withColumn("iou", iou("ab", "bb")).where(F.col("iou") > least).select("page", "a", "b", "iou")


def centre_in(inner: str, outer: str, tolerance: int = 0) -> Column:
    """In doubled units, so that no centre is a fraction."""
    one = lambda lo, hi: (F.col(f"{inner}.{lo}") + F.col(f"{inner}.{hi}")).between(2 * (F.col(f"{outer}.{lo}") - tolerance), 2 * (F.col(f"{outer}.{hi}") + tolerance))
    return one("x_min", "x_max") & one("y_min", "y_max")


def cell_of(x: Column, y: Column, cell: int = CELL) -> Column:
    """The grid cell of a point."""
    return F.floor(x / cell) * 4096 + F.floor(y / cell)


def absorbed(regions: DataFrame, boxes: DataFrame, tolerance: int = 2) -> DataFrame:
    """rows (page, region, id) of boxes whose centre is in a region (page, region, rb); they meet in the centre's grid cell."""
    at = cell_of(F.expr("(bbox.x_min + bbox.x_max) / 2"), F.expr("(bbox.y_min + bbox.y_max) / 2"))
    near = regions.withColumn("cell", F.explode(cells("rb", tolerance))).join(boxes.withColumn("cell", at), ["page", "cell"])
    return near.where(centre_in("bbox", "rb", tolerance)).select("page", "region", "id")


def smallest_at(points: DataFrame, boxes: DataFrame, tolerance: int = 3) -> DataFrame:
    """rows (page, point, id): of the boxes that hold a point (page, point, x, y), the one of least area, the first of equals by ord."""
    inside = F.col("x").between(F.col("bbox.x_min") - tolerance, F.col("bbox.x_max") + tolerance) & F.col("y").between(F.col("bbox.y_min") - tolerance, F.col("bbox.y_max") + tolerance)
    near = points.withColumn("cell", cell_of(F.col("x"), F.col("y"))).join(boxes.withColumn("cell", F.explode(cells("bbox", tolerance))), ["page", "cell"])
    return near.where(inside).groupBy("page", "point").agg(F.min_by("id", F.struct(area("bbox"), F.col("ord"))).alias("id"))


def same_line(a: str, b: str, height: int, overlap: float = 0.5) -> Column:
    """Both of at most a height, and overlapping in y by half of the lower one."""
    h = lambda n: F.col(f"{n}.y_max") - F.col(f"{n}.y_min")
    both = F.greatest(F.least(F.col(f"{a}.y_max"), F.col(f"{b}.y_max")) - F.greatest(F.col(f"{a}.y_min"), F.col(f"{b}.y_min")), F.lit(0))
    return (h(a) <= height) & (h(b) <= height) & (both >= overlap * F.least(h(a), h(b))) & (both > 0)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the least that links a-b lead to: labels are hooked to lesser ones and shortened until nothing moves."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, nxt := root[root]):
            root = nxt
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def clusters(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (page, id, cluster): cluster is the least id that pairs (page, a, b) lead to. A page's graph fits its task; a batch of pages is one array."""
    types = dict(ids.dtypes)
    left = ids.groupBy("page").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    right = pairs.groupBy(F.col("page").alias("p_")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    none = F.expr(f"cast(array() as array<{types['id']}>)")
    both = left.join(right, F.col("page").eqNullSafe(F.col("p_")), "left").select("page", "ids", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [np.append(0, np.cumsum(batch.column(i).value_lengths().to_numpy(zero_copy_only=False))) for i in (1, 2)]
            ids, a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            at = [np.concatenate([lo + np.searchsorted(ids[lo:hi], x[p:q]) for lo, hi, p, q in zip(cut[0], cut[0][1:], cut[1], cut[1][1:])] or [np.zeros(0, int)]).astype(np.int64) for x in (a, b)]
            label = least_labels(len(ids), *at)
            page = np.repeat(np.arange(len(batch)), np.diff(cut[0]))
            flat = batch.column(1).flatten()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page)), flat, flat.take(pa.array(label))], ["page", "id", "cluster"])

    return both.mapInArrow(run, f"page {types['page']}, id {types['id']}, cluster {types['id']}")


def line_clusters(boxes: DataFrame, height: int = 40) -> DataFrame:
    """Lines of texts, left to right: rows (page, cluster, n, ids, bbox) of two or more."""
    a, b = (boxes.select("page", F.col("id").alias(n), F.col("bbox").alias(f"{n}b")) for n in "ab")
    band = lambda n: F.explode(F.sequence(F.floor(F.col(f"{n}b.y_min") / CELL), F.floor(F.col(f"{n}b.y_max") / CELL)))
    pairs = a.withColumn("y", band("a")).join(b.withColumn("y", band("b")), ["page", "y"]).where("a < b").where(same_line("ab", "bb", height)).select("page", "a", "b").distinct()
    got = clusters(boxes, pairs).join(boxes, ["page", "id"])
    out = got.groupBy("page", "cluster").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("bbox.x_min", "id"))), lambda s: s["id"]).alias("ids"), union_box("bbox").alias("bbox"))
    return out.where("n >= 2")


def semantic_regions(boxes: DataFrame, horizontal: int = 80, vertical: int = 32, tall: int = 80, most: int = 20) -> DataFrame:
    """Neighbouring texts in rows and columns, in reading order, in chunks of 20: rows (page, cluster, chunk, id, place)."""
    low = boxes.where(F.col("bbox.y_max") - F.col("bbox.y_min") <= tall)
    g = lambda lo, hi: F.greatest(F.col(f"ab.{lo}") - F.col(f"bb.{hi}"), F.col(f"bb.{lo}") - F.col(f"ab.{hi}"), F.lit(0))
    dx, dy = g("x_min", "x_max"), g("y_min", "y_max")
    pairs = close_pairs(low, horizontal).where(((dy == 0) & (dx <= horizontal)) | ((dx == 0) & (dy <= vertical)))
    got = clusters(low, pairs).join(low, ["page", "id"])
    place = F.row_number().over(W.partitionBy("page", "cluster").orderBy("bbox.y_min", "bbox.x_min", "id")) - 1
    size = F.count("*").over(W.partitionBy("page", "cluster"))
    got = got.withColumn("place", place).withColumn("n", size).where("n >= 2")
    return got.select("page", "cluster", F.floor(F.col("place") / most).cast("int").alias("chunk"), "id", (F.col("place") % most).alias("place"))


def dense_figures(boxes: DataFrame, gap: int = 4, least: int = 100, side: int = 30) -> DataFrame:
    """Clusters of drawn items within a gap that are many and large enough to be a figure: rows (page, cluster, n, bbox)."""
    g = lambda lo, hi: F.greatest(F.col(f"ab.{lo}") - F.col(f"bb.{hi}"), F.col(f"bb.{lo}") - F.col(f"ab.{hi}"))
    pairs = close_pairs(boxes, gap).where((g("x_min", "x_max") <= gap) & (g("y_min", "y_max") <= gap))
    out = clusters(boxes, pairs).join(boxes, ["page", "id"]).groupBy("page", "cluster").agg(F.count("*").alias("n"), union_box("bbox").alias("bbox"))
    return out.where(F.col("n") >= least).where((F.col("bbox.x_max") - F.col("bbox.x_min") >= side) & (F.col("bbox.y_max") - F.col("bbox.y_min") >= side))


def suppressed(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Greedy suppression, largest first: rows (page, id) of boxes that don't overlap a larger kept one by more than most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["id"], pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"]), key=lambda r: (-(r[3] - r[1]) * (r[4] - r[2]), r[0]))
        kept: list = []
        for r in rows:
            for k in kept:
                i = max(0, min(r[3], k[3]) - max(r[1], k[1])) * max(0, min(r[4], k[4]) - max(r[2], k[2]))
                u = (r[3] - r[1]) * (r[4] - r[2]) + (k[3] - k[1]) * (k[4] - k[2]) - i
                if i > 0 and i / u > most:
                    break
            else:
                kept.append(r)
        return pd.DataFrame({"page": [pdf["page"].iloc[0]] * len(kept), "id": [k[0] for k in kept]})

    types = dict(boxes.dtypes)
    flat = boxes.select("page", "id", F.col("bbox.x_min").alias("x0"), F.col("bbox.y_min").alias("y0"), F.col("bbox.x_max").alias("x1"), F.col("bbox.y_max").alias("y1"))
    return flat.groupBy("page").applyInPandas(run, f"page {types['page']}, id {types['id']}")


def page_order(nodes: DataFrame) -> DataFrame:
    """nodes with place: containers first, then by page and top edge, then the order they had."""
    key = [F.when(F.col("type").isin("File", "Artifact"), 0).otherwise(1), F.coalesce("page", F.lit(0)), F.coalesce("bbox.y_min", F.lit(0)), F.col("ord")]
    return nodes.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy(*key)))
