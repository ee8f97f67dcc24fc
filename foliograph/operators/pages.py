"""Pages of drawn lines and text blocks: table candidates, joined fragments, line order, outlines.

Each works on one page (or one document's outline) in a task; what isn't a fold is a window or a join.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .geometry import CELL, clusters, same_line

# Tolerances in points.
SPAN, CROSS, PAD, SMALLEST, OVERLAP = 3.0, 2.0, 2.0, 15.0, 0.3
SAME, GAP, SPACE = 0.02, 0.3, 0.08

CANDIDATE = "page {}, mode string, x0 double, y0 double, x1 double, y1 double"


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _box(lines: pd.DataFrame) -> tuple:
    flat = lines["kind"] == "h"
    xs = pd.concat([lines.loc[flat, ["lo", "hi"]].stack(), lines.loc[~flat, "at"]])
    ys = pd.concat([lines.loc[~flat, ["lo", "hi"]].stack(), lines.loc[flat, "at"]])
    return xs.min() - PAD, ys.min() - PAD, xs.max() + PAD, ys.max() + PAD


def _grids(lines: pd.DataFrame) -> list[tuple]:
    """Lines that cross or continue each other, with three or more in one direction and any in the other."""
    up = list(range(len(lines)))
    rows = list(lines[["kind", "lo", "hi", "at"]].itertuples(index=False, name=None))
    for i, (k, lo, hi, at) in enumerate(rows):
        for j in range(i):
            k2, lo2, hi2, at2 = rows[j]
            if k == k2:
                near = abs(at - at2) <= CROSS and lo2 <= hi + CROSS and lo <= hi2 + CROSS
            else:
                near = lo - CROSS <= at2 <= hi + CROSS and lo2 - CROSS <= at <= hi2 + CROSS
            if near:
                a, b = _root(up, i), _root(up, j)
                up[max(a, b)] = min(a, b)
    out = []
    for _, own in lines.groupby([_root(up, i) for i in range(len(lines))]):
        places = own["at"].round(1).groupby(own["kind"]).nunique()
        if len(places) == 2 and places.max() >= 3:
            out.append(("grid", *_box(own)))
    return out


def _ruled(lines: pd.DataFrame) -> list[tuple]:
    """Two or more level lines over the same stretch as the first of them that isn't taken."""
    left, out = lines[lines["kind"] == "h"], []
    while len(left):
        first = left.iloc[0]
        like = (left["lo"] - first["lo"]).abs().le(SPAN) & (left["hi"] - first["hi"]).abs().le(SPAN)
        if like.sum() >= 2:
            out.append(("ruled_rows", *_box(left[like])))
            left = left[~like]
        else:
            left = left.iloc[1:]
    return out


def table_candidates(lines: DataFrame) -> DataFrame:
    """rows (page, mode, x0, y0, x1, y1) from lines (page, ord, kind h or v, lo, hi, at); of overlapping ones the largest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        found = [c for c in _grids(pdf) + _ruled(pdf) if c[3] - c[1] >= SMALLEST and c[4] - c[2] >= SMALLEST]
        kept: list[tuple] = []
        for c in sorted(found, key=lambda c: -(c[3] - c[1]) * (c[4] - c[2])):
            shared = [max(0.0, min(c[3], k[3]) - max(c[1], k[1])) * max(0.0, min(c[4], k[4]) - max(c[2], k[2])) for k in kept]
            sizes = [(c[3] - c[1]) * (c[4] - c[2]) + (k[3] - k[1]) * (k[4] - k[2]) for k in kept]
            if not any(i > OVERLAP * (s - i) for i, s in zip(shared, sizes)):
                kept.append(c)
        return pd.DataFrame([(pdf["page"].iloc[0], *k) for k in kept], columns=["page", "mode", "x0", "y0", "x1", "y1"])

    return lines.groupBy("page").applyInPandas(run, CANDIDATE.format(dict(lines.dtypes)["page"]))


FRAGMENT = "page {}, ord int, text string, x0 double, y0 double, x1 double, y1 double, n int"


def joined_fragments(blocks: DataFrame, barriers: DataFrame) -> DataFrame:
    """Neighbouring one-line blocks of one font on one baseline as one: rows (page, ord, text, box, n).

    blocks: (page, ord, text, x0, y0, x1, y1, font, size, baseline, level: one line, written level). barriers: (page, x0, y0, x1, y1).
    """

    def run(key, pdf: pd.DataFrame, walls: pd.DataFrame) -> pd.DataFrame:
        fences = list(walls[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        out: list[list] = []
        head = last = None
        for b in pdf.sort_values("ord").itertuples():
            fits = head is not None and head.level and b.level and any(c.isalpha() for c in b.text) and any(c.isalpha() for c in last.text)
            if fits:
                s, gap = head.size, b.x0 - last.x1
                fits = s > 0 and b.font == head.font and abs(b.size - s) <= SAME * s and abs(b.baseline - head.baseline) <= SAME * s and -SAME * s <= gap <= GAP * s
                fits = fits and not any(x0 <= b.x0 and x1 >= last.x1 and y0 < min(last.y1, b.y1) and y1 > max(last.y0, b.y0) for x0, y0, x1, y1 in fences)
            if fits:
                o = out[-1]
                wide = gap > SPACE * last.size and not o[2][-1:].isspace() and not b.text[:1].isspace()
                o[2] += (" " if wide else "") + b.text
                o[3:] = [min(o[3], b.x0), min(o[4], b.y0), max(o[5], b.x1), max(o[6], b.y1), o[7] + 1]
            else:
                head = b
                out.append([key[0], b.ord, b.text, b.x0, b.y0, b.x1, b.y1, 1])
            last = b
        return pd.DataFrame(out, columns=["page", "ord", "text", "x0", "y0", "x1", "y1", "n"])

    return blocks.groupBy("page").cogroup(barriers.select(F.col("page").alias("p_"), "x0", "y0", "x1", "y1").groupBy("p_")).applyInPandas(run, FRAGMENT.format(dict(blocks.dtypes)["page"]))


def line_order(boxes: DataFrame, height: int = 30) -> DataFrame:
    """boxes (page, id, ord, bbox) with place: in each line the places of its boxes are filled from left to right."""
    a, b = (boxes.select("page", F.col("id").alias(n), F.col("bbox").alias(f"{n}b")) for n in "ab")
    band = lambda n: F.explode(F.sequence(F.floor(F.col(f"{n}b.y_min") / CELL), F.floor(F.col(f"{n}b.y_max") / CELL)))
    pairs = a.withColumn("y", band("a")).join(b.withColumn("y", band("b")), ["page", "y"]).where("a < b").where(same_line("ab", "bb", height)).select("page", "a", "b").distinct()
    line = clusters(boxes, pairs).withColumnRenamed("page", "page_").withColumnRenamed("id", "id_")
    got = boxes.join(line, (F.col("page") == F.col("page_")) & (F.col("id") == F.col("id_"))).drop("page_", "id_")
    w = W.partitionBy("page", "cluster")
    got = got.withColumn("k", F.row_number().over(w.orderBy("bbox.x_min", "ord")))
    slots = got.select("page", "cluster", F.row_number().over(w.orderBy("ord")).alias("k"), F.col("ord").alias("place"))
    return got.join(slots, ["page", "cluster", "k"]).drop("k")


def plain(text: str) -> str:
    return " ".join((text or "").split()).casefold()


def outline_matches(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Which text each outline entry means: rows (doc, ord, level, id), id null where none or several do.

    entries: (doc, ord, level, title, page, x, y); texts: (doc, id, ord, page, text, x0, y0, x1, y1). A text matches if it is the title, after its
    section number if it has one; of several the one that is nearest to the entry's point, if only one is. A text is taken once.
    """

    def run(key, todo: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        by: dict = {}
        for t in have.sort_values("ord").itertuples():
            by.setdefault((t.page, re.sub(r"^\d+(?:\.\d+)*\.?\s+", "", plain(t.text))), []).append(t)
        taken, out = set(), []
        for e in todo.sort_values("ord").itertuples():
            title = plain(e.title)
            free = [t for t in by.get((e.page, title), []) if t.id not in taken] if title else []
            pick = free[0] if len(free) == 1 else None
            if len(free) > 1 and pd.notna(e.x) and pd.notna(e.y):
                far = sorted((max(t.x0 - e.x, 0, e.x - t.x1) + max(t.y0 - e.y, 0, e.y - t.y1), i) for i, t in enumerate(free))
                if far[0][0] < far[1][0]:
                    pick = free[far[0][1]]
            if pick is not None:
                taken.add(pick.id)
            out.append((key[0], e.ord, e.level, None if pick is None else pick.id))
        return pd.DataFrame(out, columns=["doc", "ord", "level", "id"])

    right = texts.select(F.col("doc").alias("d_"), "id", "ord", "page", "text", "x0", "y0", "x1", "y1")
    return entries.groupBy("doc").cogroup(right.groupBy("d_")).applyInPandas(run, "doc string, ord int, level int, id string")
