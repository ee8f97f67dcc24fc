"""Charts as rows (chart, series, place, kind, axis, i, category, value): scales and the geometry of bars, lines and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TICKS = 5


def scales(values: DataFrame) -> DataFrame:
    """rows (chart, axis, top): the greatest value of an axis, or 1 where that is 0 or missing."""
    return values.groupBy("chart", "axis").agg(F.coalesce(F.nullif(F.max("value"), F.lit(0)), F.lit(1)).cast("double").alias("top"))


def _scaled(values: DataFrame, width: Column, height: Column) -> DataFrame:
    """values with the middle x of their category and their height over the base."""
    n = values.groupBy("chart").agg((F.max("i") + 1).alias("n_"))
    out = values.join(scales(values), ["chart", "axis"]).join(n, "chart")
    return out.withColumn("step_", width / F.col("n_")).withColumn("x_", F.col("step_") * (F.col("i") + 0.5)).withColumn("h_", height * F.col("value") / F.col("top"))


def bars(values: DataFrame, width: float, height: float) -> DataFrame:
    """rows (chart, series, i, x0, x1, y0, y1) of the bars; y from the top of the plot down. Seven tenths of a category, shared by its series."""
    own = values.where("kind = 'bar'")
    rank = own.select("chart", "series", "place").distinct().withColumn("k_", F.row_number().over(W.partitionBy("chart").orderBy("place")) - 1)
    rank = rank.withColumn("bars_", F.count("*").over(W.partitionBy("chart"))).select("chart", "series", "k_", "bars_")
    at = _scaled(values, F.lit(width), F.lit(height)).where("kind = 'bar' and value is not null").join(rank, ["chart", "series"])
    one = F.col("step_") * 0.7 / F.col("bars_")
    x0 = F.col("x_") - F.col("step_") * 0.35 + F.col("k_") * one
    return at.select("chart", "series", "i", x0.alias("x0"), (x0 + one * 0.9).alias("x1"), (F.lit(height) - F.col("h_")).alias("y0"), F.lit(float(height)).alias("y1"))


def line_points(values: DataFrame, width: float, height: float) -> DataFrame:
    """rows (chart, series, i, x, y) of the points of the lines, in order of i; missing values have none."""
    at = _scaled(values, F.lit(width), F.lit(height)).where("kind = 'line' and value is not null")
    return at.select("chart", "series", "i", F.col("x_").alias("x"), (F.lit(height) - F.col("h_")).alias("y"))


def ticks(values: DataFrame, height: float, n: int = TICKS) -> DataFrame:
    """rows (chart, axis, tick, y, value) of n + 1 even ticks of each axis."""
    out = scales(values).withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return out.select("chart", "axis", "tick", (F.lit(height) - F.lit(height) * F.col("tick") / n).alias("y"), (F.col("top") * F.col("tick") / n).alias("value"))


def grids(values: DataFrame) -> DataFrame:
    """A chart as a table: rows (chart, r, cells), the names of its series first, then each category with their values."""
    cell = F.struct("place", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v"))
    rows = values.groupBy("chart", "i").agg(F.first("category").alias("c"), F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]).alias("v"))
    head = values.select("chart", "series", "place").distinct().groupBy("chart").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "series"))), lambda x: x["series"]).alias("v"))
    head = head.select("chart", F.lit(0).alias("r"), F.concat(F.array(F.lit("")), "v").alias("cells"))
    return head.unionByName(rows.select("chart", (F.col("i") + 1).cast("int").alias("r"), F.concat(F.array(F.coalesce("c", F.lit(""))), "v").alias("cells")))


def legend_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A legend's place as shares of the chart; null unless it was placed by hand, with all four."""
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def stroke_width(emu: Column) -> Column:
    """A line's width in points, at least 1."""
    return F.greatest(F.lit(1), F.rint(emu / 12700).cast("int"))
