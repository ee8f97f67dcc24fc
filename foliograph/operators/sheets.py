"""Sheets as graph nodes: bordered rectangles and declared ranges as tables, what lies outside them as texts, pictures that overlap as groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import cells as c
from . import geometry as geo


def _ends(marks: DataFrame, line: str, along: str, name: str) -> DataFrame:
    """marks (sheet, row, col) with ``name``: the last row or column of the unbroken stretch that each stands in."""
    w = W.partitionBy("sheet", line).orderBy(along)
    island = marks.withColumn("i_", F.col(along) - F.row_number().over(w))
    return island.withColumn(name, F.max(along).over(W.partitionBy("sheet", line, "i_"))).drop("i_")


def border_tables(borders: DataFrame) -> DataFrame:
    """Rectangles with borders on all four sides: rows (sheet, name, r0, c0, r1, c1).

    borders: (sheet, row, col, top, left, bottom, right). From a cell with a top and a left border, a rectangle goes as far right as the top
    border does, and as far down as the left one; it counts if its lowest row has bottom borders and its last column right
    ones, if it is more than a cell, and in no other one. All sides are unbroken stretches, so each is a lookup by sheet, row and column.
    """
    side = lambda name, line, along, end: _ends(borders.where(name).select("sheet", "row", "col").distinct(), line, along, end)
    corner = side("top", "row", "col", "c1").join(side("left", "col", "row", "r1"), ["sheet", "row", "col"]).where("row < r1 or col < c1")
    low = side("bottom", "row", "col", "to_c").select("sheet", F.col("row").alias("r1"), "col", "to_c")
    last = side("right", "col", "row", "to_r").select("sheet", F.col("col").alias("c1"), "row", "to_r")
    found = corner.join(low, ["sheet", "r1", "col"]).where("to_c >= c1").join(last, ["sheet", "c1", "row"]).where("to_r >= r1")
    found = found.select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), "r1", "c1").distinct()
    band = F.explode(F.sequence(F.floor(F.col("r0") / c.BAND), F.floor(F.col("r1") / c.BAND)))
    a, b = found.withColumn("band", F.floor(F.col("r0") / c.BAND)).alias("a"), found.withColumn("band", band).alias("b")
    other = ~((F.col("a.r0") == F.col("b.r0")) & (F.col("a.c0") == F.col("b.c0")) & (F.col("a.r1") == F.col("b.r1")) & (F.col("a.c1") == F.col("b.c1")))
    outer = a.join(b, (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.band") == F.col("b.band")) & other & c.holding("b", "a"), "left_anti")
    name = F.concat(F.lit("BorderTable"), F.row_number().over(W.partitionBy("sheet").orderBy("r0", "c0")).cast("string"))
    return outer.select("sheet", name.alias("name"), "r0", "c0", "r1", "c1")


def table_ranges(declared: DataFrame, bordered: DataFrame) -> DataFrame:
    """Declared ranges, and bordered ones that share no cell with them; those that touch are one."""
    band = F.explode(F.sequence(F.floor(F.col("r0") / c.BAND), F.floor(F.col("r1") / c.BAND)))
    a, b = bordered.withColumn("band", band).alias("a"), declared.withColumn("band", band).alias("b")
    hit = a.join(b, (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.band") == F.col("b.band")) & c.overlapping("a", "b"), "left_semi").select("sheet", "name", "r0", "c0", "r1", "c1").distinct()
    return c.merged_ranges(declared.unionByName(bordered.join(hit, ["sheet", "name", "r0", "c0", "r1", "c1"], "left_anti")))


def table_grids(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges with grid: rows of cells, empty texts where a range has none."""
    band = F.explode(F.sequence(F.floor(F.col("r0") / c.BAND), F.floor(F.col("r1") / c.BAND)))
    r = ranges.select(F.col("sheet").alias("s_"), "name", "r0", "c0", "r1", "c1", band.alias("band_"))
    inside = (F.col("sheet") == F.col("s_")) & (F.floor(F.col("row") / c.BAND) == F.col("band_")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    lines = cells.join(r, inside).groupBy("sheet", "name", "r0", "c0", "r1", "c1", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    whole = lines.groupBy("sheet", "name", "r0", "c0", "r1", "c1").agg(F.map_from_entries(F.collect_list(F.struct("row", "m"))).alias("rows_"))
    out = ranges.join(whole, ["sheet", "name", "r0", "c0", "r1", "c1"], "left")
    cell = "coalesce(element_at(element_at(rows_, r), k), '')"
    return out.withColumn("grid", F.expr(f"transform(sequence(r0, r1), r -> transform(sequence(c0, c1), k -> {cell}))")).drop("rows_")


def text_components(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells outside tables, those that touch as one text: rows (sheet, comp, n, text, row, col)."""
    left = c.in_ranges(cells, ranges, "left_anti")
    by = c.components(left).groupBy("sheet", "comp").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("v"))
    return by.select("sheet", "comp", "n", F.array_join(F.transform("v", lambda x: x["value"]), " / ").alias("text"), F.col("v")[0]["row"].alias("row"), F.col("v")[0]["col"].alias("col"))


def picture_groups(pictures: DataFrame) -> DataFrame:
    """Pictures (sheet, id, bbox) that overlap, also by way of others: rows (sheet, id, base), base the first of them."""
    own = pictures.select(F.col("sheet").alias("page"), "id", "bbox")
    pairs = geo.close_pairs(own).where(geo.overlaps("ab", "bb")).select("page", "a", "b")
    return geo.clusters(own, pairs).select(F.col("page").alias("sheet"), "id", F.col("cluster").alias("base"))


def range_name(name: Column) -> Column:
    return F.concat(name, F.lit(" ("), (F.col("r1") - F.col("r0") + 1).cast("string"), F.lit(" rows x "), (F.col("c1") - F.col("c0") + 1).cast("string"), F.lit(" cols)"))
