"""Sheets as cells (sheet, row, col, value): components, bounds, ranges, offsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .geometry import least_labels


def components(cells: DataFrame) -> DataFrame:
    """Cells that touch, also at a corner: cells with comp, the least row * 100000 + col of the component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["row"].to_numpy(np.int64) * 100000 + pdf["col"].to_numpy(np.int64)
        have, own = np.unique(key, return_inverse=True)
        links = []
        for step in (1, 99999, 100000, 100001):  # to the right, and the three below
            at = np.minimum(np.searchsorted(have, have + step), len(have) - 1)
            links.append(np.stack([np.flatnonzero(have[at] == have + step), at[have[at] == have + step]]))
        a, b = np.concatenate(links, axis=1)
        return pdf.assign(comp=have[least_labels(len(have), a, b)][own])

    return cells.groupBy("sheet").applyInPandas(run, ", ".join(f"{n} {t}" for n, t in cells.dtypes) + ", comp long")


def component_texts(cells: DataFrame) -> DataFrame:
    """rows (sheet, comp, n, text): the values of a component in reading order, joined by ' / '."""
    by = components(cells).groupBy("sheet", "comp").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("v"))
    return by.select("sheet", "comp", "n", F.array_join(F.transform("v", lambda x: x["value"]), " / ").alias("text"))


def bounds(cells: DataFrame, padding: int = 5) -> DataFrame:
    """The range in use, whatever the file declares: rows (sheet, max_row, max_col), padded."""
    return cells.groupBy("sheet").agg((F.max("row") + padding).alias("max_row"), (F.max("col") + padding).alias("max_col"))


def touches(a: str, b: str) -> Column:
    """Two ranges (r0, c0, r1, c1) that adjoin without a gap, or where one holds the other."""
    c = lambda n, f: F.col(f"{n}.{f}")
    rows = (c(a, "r0") <= c(b, "r1")) & (c(b, "r0") <= c(a, "r1"))
    cols = (c(a, "c0") <= c(b, "c1")) & (c(b, "c0") <= c(a, "c1"))
    beside = rows & ((c(a, "c1") + 1 == c(b, "c0")) | (c(b, "c1") + 1 == c(a, "c0")))
    above = cols & ((c(a, "r1") + 1 == c(b, "r0")) | (c(b, "r1") + 1 == c(a, "r0")))
    holds = lambda o, i: (c(o, "r0") <= c(i, "r0")) & (c(o, "c0") <= c(i, "c0")) & (c(o, "r1") >= c(i, "r1")) & (c(o, "c1") >= c(i, "c1"))
    return beside | above | holds(a, b) | holds(b, a)


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (sheet, name, r0, c0, r1, c1) that touch become their bounding range, again and again; the first name stays."""

    def near(a, b):
        rows, cols = a[1] <= b[3] and b[1] <= a[3], a[2] <= b[4] and b[2] <= a[4]
        hold = lambda o, i: o[1] <= i[1] and o[2] <= i[2] and o[3] >= i[3] and o[4] >= i[4]
        return rows and (a[4] + 1 == b[2] or b[4] + 1 == a[2]) or cols and (a[3] + 1 == b[1] or b[3] + 1 == a[1]) or hold(a, b) or hold(b, a)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = sorted(zip(pdf["name"], pdf["r0"], pdf["c0"], pdf["r1"], pdf["c1"]), key=lambda r: (r[1], r[2], r[0]))
        done: list = []
        while todo:
            a = todo.pop(0)
            b = next((x for x in done if near(a, x)), None)
            if b is None:
                done.append(a)
                continue
            done.remove(b)  # the grown range may touch others now
            todo.insert(0, (b[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4])))
        return pd.DataFrame(done, columns=["name", "r0", "c0", "r1", "c1"]).assign(sheet=pdf["sheet"].iloc[0])[["sheet", "name", "r0", "c0", "r1", "c1"]]

    types = dict(ranges.dtypes)
    cols = ("sheet", "name", "r0", "c0", "r1", "c1")
    return ranges.select(*cols).groupBy("sheet").applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in cols))


def offsets(sizes: DataFrame) -> DataFrame:
    """sizes (sheet, i, size) with start: the sum of the sizes before."""
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(W.partitionBy("sheet").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def parsed_range(text: Column) -> Column:
    """'R1C2:R3C4', or 'R1C2' for one cell, as (r0, c0, r1, c1)."""
    at = lambda i: F.nullif(F.regexp_extract(text, r"^R(\d+)C(\d+)(?::R(\d+)C(\d+))?$", i), F.lit("")).cast("int")
    return F.struct(at(1).alias("r0"), at(2).alias("c0"), F.coalesce(at(3), at(1)).alias("r1"), F.coalesce(at(4), at(2)).alias("c1"))


#: Cells and ranges meet in bands of so many rows.
BAND = 256


def in_ranges(cells: DataFrame, ranges: DataFrame, how: str = "left_semi") -> DataFrame:
    """Cells in some range of their sheet (or in none, with left_anti)."""
    band = F.explode(F.sequence(F.floor(F.col("r0") / BAND), F.floor(F.col("r1") / BAND)))
    r = ranges.select("sheet", "r0", "c0", "r1", "c1", band.alias("band")).alias("r")
    c = cells.alias("c")
    same = (F.col("c.sheet") == F.col("r.sheet")) & (F.floor(F.col("c.row") / BAND) == F.col("r.band"))
    return c.join(r, same & F.col("c.row").between(F.col("r.r0"), F.col("r.r1")) & F.col("c.col").between(F.col("r.c0"), F.col("r.c1")), how)


def overlapping(a: str, b: str) -> Column:
    """Two ranges (r0, c0, r1, c1) that share a cell."""
    c = lambda n, f: F.col(f"{n}.{f}")
    return (c(a, "r0") <= c(b, "r1")) & (c(b, "r0") <= c(a, "r1")) & (c(a, "c0") <= c(b, "c1")) & (c(b, "c0") <= c(a, "c1"))


def holding(outer: str, inner: str) -> Column:
    """A range that holds another one whole."""
    c = lambda n, f: F.col(f"{n}.{f}")
    return (c(outer, "r0") <= c(inner, "r0")) & (c(outer, "c0") <= c(inner, "c0")) & (c(outer, "r1") >= c(inner, "r1")) & (c(outer, "c1") >= c(inner, "c1"))


def with_anchors(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells with the row and column of the top left cell of the merged range (sheet, r0, c0, r1, c1) that they lie in, or their own."""
    band = F.explode(F.sequence(F.floor(F.col("r0") / BAND), F.floor(F.col("r1") / BAND)))
    m = merges.select(F.col("sheet").alias("s_"), "r0", "c0", "r1", "c1", band.alias("band_"))
    near = (F.col("sheet") == F.col("s_")) & (F.floor(F.col("row") / BAND) == F.col("band_")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    out = cells.join(m, near, "left")
    return out.select(*cells.columns, F.coalesce("r0", "row").alias("anchor_row"), F.coalesce("c0", "col").alias("anchor_col"))


def reached(sizes: DataFrame, anchors: DataFrame, most: int = 2000) -> DataFrame:
    """anchors (sheet, i, offset, extent) with reached: the row or column in which something ends that starts offset pixels into i.

    sizes: (sheet, i, size). The walk is ``most`` rows or columns at the longest, and stops at the last that has a size. A sheet's ends
    are one sorted array, of which an anchor takes the first that reaches far enough.
    """
    ends = offsets(sizes).select("sheet", "i", "start", (F.col("start") + F.col("size")).alias("end"))
    by = ends.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("i", "end"))).alias("ends_"), F.max("i").alias("last_"))
    at = anchors.join(ends.select("sheet", "i", "start"), ["sheet", "i"]).join(by, "sheet").withColumn("goal_", F.col("start") + F.col("offset") + F.col("extent"))
    first = F.expr("array_min(transform(filter(ends_, e -> e.i >= i and e.end >= goal_), e -> e.i))")
    return at.select(*anchors.columns, F.least(F.coalesce(first, "last_"), F.col("i") + most).alias("reached"))
