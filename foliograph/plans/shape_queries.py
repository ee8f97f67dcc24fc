"""Queries over drawn shapes and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import pages
from ..sources.adapters import adapter, prefix
from .catalog import query
from .layout_queries import REACH, boxes


@query("select l_orderkey as id, l_linenumber as line, round_even(l_quantity * 96 / 72, 0)::int as pt, round_even(l_quantity * 7.0 + 5, 0)::int as chars, round_even(l_partkey * 1000 / 914400.0 * 96, 0)::int as emu from lineitem")
def shape_units(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), shapes.pt_to_px(q).alias("pt"), shapes.chars_to_px(q).alias("chars"), shapes.emu_to_px(F.col("l_partkey") * 1000).alias("emu"))


@query("with t as (select p_partkey as id, (p_partkey % 256)::int as c, (p_size % 9 - 4) / 4.0 as t from part) select id, case when t < 0 then greatest(round_even(c * (1 + t), 0), 0) when t > 0 then least(round_even(c * (1 - t) + 255 * t, 0), 255) else c end::int as channel from t")
def shape_tint(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), shapes.tinted((F.col("p_partkey") % 256).cast("int"), (F.col("p_size") % 9 - 4) / 4.0).alias("channel"))


@query(prefix("boxes") + """, e as (select id, case when (id % 2 = 0) <> (id % 3 = 0) then x1 else x0 end as ax, y0 as ay, case when (id % 2 = 0) <> (id % 3 = 0) then x0 else x1 end as bx, y1 as by_ from boxes),
s as (select *, (ax + bx) / 2.0 as m, i, i / 16.0 as t from e, (select unnest(range(17)) as i))
select id, i::int as step, round((1 - t) * (1 - t) * (1 - t) * ax + 3 * (1 - t) * (1 - t) * t * m + 3 * (1 - t) * t * t * m + t * t * t * bx, 3) as x,
 round((1 - t) * (1 - t) * (1 - t) * ay + 3 * (1 - t) * (1 - t) * t * ay + 3 * (1 - t) * t * t * by_ + t * t * t * by_, 3) as y from s""")
def connector_curve(spark, sf_dir):
    b = adapter(spark, sf_dir, "boxes")
    e = shapes.ends(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("id") % 2 == 0, F.col("id") % 3 == 0)
    out = b.select("id", F.posexplode(shapes.curved(e)).alias("step", "p"))
    return out.select("id", "step", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(prefix("boxes").replace("with ", "with recursive ", 1) + """, near as (select a.page, a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id < b.id and a.y1 - a.y0 <= 30 and b.y1 - b.y0 <= 30
 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)),""" + REACH + """,
o as (select page, cluster, id, ord, row_number() over (partition by page, cluster order by x0, ord) as k, row_number() over (partition by page, cluster order by ord) as s from comp join boxes using (page, id))
select a.page, a.id, b.ord as place from o a join o b on a.page = b.page and a.cluster = b.cluster and a.k = b.s""")
def line_order(spark, sf_dir):
    return pages.line_order(boxes(spark, sf_dir)).select("page", "id", "place")


@query()
def table_candidates(spark, sf_dir):
    """Every ninth event as a line; in runs of nine, lines that form grids and rules."""
    e = adapter(spark, sf_dir, "boxes")
    k = F.col("id") % 9
    lines = e.select(F.col("page").cast("long").alias("page"), "ord", F.when(k < 5, "h").otherwise("v").alias("kind"), F.lit(10.0).alias("lo"), F.when(k == 8, 40.0).otherwise(90.0).alias("hi"), (k * 11.0 + 10).alias("at"))
    return pages.table_candidates(lines)
