"""Queries over the geometry and the colours of shapes, sheets and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colours, shapes
from ..operators import cells, charts
from ..sources.adapters import adapter, prefix
from .catalog import query


def rounded(p, *names: str):
    return [F.round(F.col(f"{p}.{n}"), 4).alias(n) for n in names]


def placed(spark, sf_dir):
    return adapter(spark, sf_dir, "boxes").withColumn("box", F.struct(F.col("x0").alias("x_min"), F.col("y0").alias("y_min"), F.col("x1").alias("x_max"), F.col("y1").alias("y_max")))


PRESET_NAMES = ["pentagon", "octagon", "star5", "rightArrow", "leftArrow", "downArrow", "upArrow", "diamond", "plain"]
UNIT = ", ".join(f"({i}, '{name}', {k}, {x!r}, {y!r})" for name, i in (("rightArrow", 3), ("diamond", 7)) for k, (x, y) in enumerate(shapes.PRESETS[name]))
ROUND = "union all select {k}, '{name}', i, 0.5 + {r} * cos(2 * pi() * i / {n} - pi() / 2), 0.5 + {r} * sin(2 * pi() * i / {n} - pi() / 2) from (select unnest(range({n})) as i) "
UNITS = f"""unit as (select * from (values {UNIT}) as v(kind, name, k, ux, uy)
 {ROUND.format(k=0, name='pentagon', n=5, r=0.5)} {ROUND.format(k=1, name='octagon', n=8, r=0.5)} {ROUND.format(k=2, name='star5', n=10, r='case when i % 2 = 0 then 0.5 else 0.19 end')}
 union all select * from (values (8, 'plain', 0, 0.0, 0.0), (8, 'plain', 1, 1.0, 0.0), (8, 'plain', 2, 1.0, 1.0), (8, 'plain', 3, 0.0, 1.0)) as w),
units as (select kind, k, ux, uy from unit union all select 4, k, 1 - ux, uy from unit where kind = 3 union all select 5, k, uy, ux from unit where kind = 3 union all select 6, k, uy, 1 - ux from unit where kind = 3)"""


@query(prefix("boxes") + f", {UNITS} select b.id, u.k::int as k, round(b.x0 + ux * (b.x1 - b.x0), 4) as x, round(b.y0 + uy * (b.y1 - b.y0), 4) as y from boxes b join units u on u.kind = b.id % 9")
def shape_outlines(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, PRESET_NAMES)), (F.col("id") % 9 + 1).cast("int"))
    out = placed(spark, sf_dir).select("id", F.posexplode(shapes.outline(name, F.col("box"))).alias("k", "p"))
    return out.select("id", "k", *rounded("p", "x", "y"))


@query(prefix("boxes") + """, e as (select id, x1::double as tx, y0::double as ty, x0::double as ox, y1::double as oy, (x1 - x0) / sqrt((x1 - x0) * (x1 - x0) + (y0 - y1) * (y0 - y1)) as dx, (y0 - y1) / sqrt((x1 - x0) * (x1 - x0) + (y0 - y1) * (y0 - y1)) as dy, id % 5 + 2 as s from boxes),
p as (select id, 0 as k, tx as x, ty as y from e where id % 3 < 2 union all select id, 1, tx - dx * s - dy * s / 2, ty - dy * s + dx * s / 2 from e where id % 3 < 2
 union all select id, 2, tx - dx * s * 2, ty - dy * s * 2 from e where id % 3 = 1 union all select id, case id % 3 when 1 then 3 else 2 end, tx - dx * s + dy * s / 2, ty - dy * s - dx * s / 2 from e where id % 3 < 2
 union all select id, 0, tx - s / 2, ty - s / 2 from e where id % 3 = 2 union all select id, 1, tx + s / 2, ty + s / 2 from e where id % 3 = 2)
select id, k::int as k, round(x, 4) as x, round(y, 4) as y from p""")
def arrowheads(spark, sf_dir):
    kind = shapes.head_kind(F.element_at(F.array(F.lit("stealth"), F.lit("diamond"), F.lit("oval")), (F.col("id") % 3 + 1).cast("int")))
    tip, other = (F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("x1", "y0"), ("x0", "y1")))
    out = placed(spark, sf_dir).select("id", F.posexplode(shapes.arrowhead(tip, other, F.col("id") % 5 + 2, kind)).alias("k", "p"))
    return out.select("id", "k", *rounded("p", "x", "y"))


@query(prefix("boxes") + """, e as (select id, x0::double as ax, y0::double as ay, (x1 - x0)::double as dx, (y1 - y0)::double as dy, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as l from boxes),
s as (select *, unnest(range(cast(ceil(l / 10) as bigint))) as k from e)
select id, k::int as k, round(ax + dx / l * k * 10, 4) as x0, round(ay + dy / l * k * 10, 4) as y0, round(ax + dx / l * least(k * 10 + 6, l), 4) as x1, round(ay + dy / l * least(k * 10 + 6, l), 4) as y1 from s""")
def dashed_lines(spark, sf_dir):
    a, b = (F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("x0", "y0"), ("x1", "y1")))
    out = placed(spark, sf_dir).select("id", F.posexplode(shapes.dashes(a, b)).alias("k", "p"))
    return out.select("id", "k", *rounded("p", "x0", "y0", "x1", "y1"))


@query(prefix("boxes") + """, m as (select * from (values (0, 0, 0, -1), (0, 1, 1, 0), (0, 2, 0, 1), (0, 3, -1, 0), (1, 0, 0, -1), (1, 1, 1, 1), (1, 2, -1, 1), (2, 0, -1, -1), (2, 1, 1, -1), (2, 2, 1, 1), (2, 3, -1, 1), (3, 0, -1, 0), (3, 1, 1, 0), (3, 2, 0, -1), (3, 3, 0, 1), (4, 0, -1, -1), (4, 1, 1, 1)) as v(kind, k, mx, my))
select id, k, (x0 + 4 * mx)::double as x, (y0 + 4 * my)::double as y from boxes join m on kind = id % 5""")
def chart_markers(spark, sf_dir):
    symbol = F.element_at(F.array(*map(F.lit, ["diamond", "triangle", "square", "plus", "circle"])), (F.col("id") % 5 + 1).cast("int"))
    at = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))
    return placed(spark, sf_dir).select("id", F.posexplode(shapes.marker(at, symbol)).alias("k", "p")).select("id", "k", "p.x", "p.y")


@query(prefix("boxes") + """, e as (select id, x0 + round_even((id % 50) * 9525 / 914400.0 * 96, 0) as l, y0 + round_even((id % 30 - 15) * 12700 / 914400.0 * 96, 0) as t, greatest(1, round_even((id % 7) * 100000 / 914400.0 * 96, 0)) as w, greatest(1, round_even((id % 4) * 100000 / 914400.0 * 96, 0)) as h from boxes)
select id, l::int as x_min, t::int as y_min, (l + w)::int as x_max, (t + h)::int as y_max from e""")
def calibrated_boxes(spark, sf_dir):
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    n = F.col("id")
    return placed(spark, sf_dir).select("id", shapes.calibrated(F.col("box"), pair(n * 0, n * 0), pair(n % 50 * 9525, (n % 30 - 15) * 12700), pair(n % 7 * 100000, n % 4 * 100000)).alias("b")).select("id", "b.*")


@query("""select p_partkey as id, case when p_partkey % 5 = 0 then 1.0 when p_partkey % 7 = 0 then 1.0 else (p_size * 1000) / 100000 end as alpha, p_partkey % 3 = 1 as flip_h, p_partkey % 2 = 1 as flip_v, case when p_partkey % 11 = 0 then 0.0 else (p_size * 90000) / 60000 end as degrees,
 case p_partkey % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 2 when 4 then 1 end::int as border from part""")
def shape_attributes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("id", F.col("p_partkey"))
    alpha = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, "half").otherwise((F.col("p_size") * 1000).cast("string"))
    rot = F.when(F.col("id") % 11 != 0, (F.col("p_size") * 90000).cast("string"))
    t = shapes.transform_of((F.col("id") % 3).cast("string"), (F.col("id") % 2).cast("string"), rot)
    style = F.element_at(F.array(*map(F.lit, ["thin", "double", "thick", "medium", "unheard-of", None])), (F.col("id") % 6 + 1).cast("int"))
    return p.select("id", shapes.opacity(alpha).alias("alpha"), t.alias("t"), shapes.border_width(style).alias("border")).select("id", "alpha", "t.*", "border")


@query(prefix("boxes") + """select id, case when id % 2 = 0 then x0 + x1 - (x0 + 3) else x0 + 1 end as x_min, case when id % 3 = 0 then y0 + y1 - (y0 + 4) else y0 + 2 end as y_min,
 case when id % 2 = 0 then x0 + x1 - (x0 + 1) else x0 + 3 end as x_max, case when id % 3 = 0 then y0 + y1 - (y0 + 2) else y0 + 4 end as y_max from boxes""")
def flipped_parts(spark, sf_dir):
    inner = F.struct((F.col("x0") + 1).alias("x_min"), (F.col("y0") + 2).alias("y_min"), (F.col("x0") + 3).alias("x_max"), (F.col("y0") + 4).alias("y_max"))
    return placed(spark, sf_dir).select("id", shapes.flipped(F.col("box"), inner, F.col("id") % 2 == 0, F.col("id") % 3 == 0).alias("b")).select("id", "b.*")


@query("""with s as (select o_custkey as sheet, o_orderkey as i, case when o_orderkey % 4 = 0 then 0 else round_even(coalesce(nullif(o_orderkey % 3, 0) * 10.5, 15.0) * 96 / 72, 0) end as h, case when o_orderkey % 9 = 0 then 0 else round_even(case when o_orderkey % 5 = 0 then 8.43 else o_orderkey % 5 * 2.5 end * 7 + 5, 0) end as w from orders)
select sheet, i, h::int as height, w::int as width, coalesce(sum(h) over p, 0)::bigint as top, coalesce(sum(w) over p, 0)::bigint as left_ from s window p as (partition by sheet order by i rows between unbounded preceding and 1 preceding)""")
def sheet_grid(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("sheet"), k.alias("i"), shapes.row_height(F.when(k % 3 > 0, k % 3 * 10.5), k % 4 == 0, F.lit(None).cast("double")).alias("height"), shapes.column_width((k % 5 * 2.5).cast("double"), k % 9 == 0, shapes.default_width(F.lit(None).cast("double"), F.lit(0.0))).alias("width"))
    rows = cells.offsets(o.withColumn("size", F.col("height"))).withColumnRenamed("start", "top").drop("size")
    return cells.offsets(rows.withColumn("size", F.col("width"))).withColumnRenamed("start", "left_").drop("size")


@query("""with s as (select o_custkey as sheet, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderkey % 40 as size from orders), e as (select *, sum(size) over (partition by sheet order by i rows unbounded preceding) as fin from s)
select a.sheet, a.i::int as i, coalesce(min(b.i), max(c.n))::int as reached from (select *, fin - size + 3 + 70 as goal from e) a left join e b on b.sheet = a.sheet and b.i >= a.i and b.fin >= a.goal join (select sheet, max(i) as n from e group by 1) c on c.sheet = a.sheet group by 1, 2""")
def anchors_reached(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sizes = o.select(F.col("o_custkey").alias("sheet"), F.expr("cast(row_number() over (partition by o_custkey order by o_orderkey) as int)").alias("i"), (F.col("o_orderkey") % 40).alias("size"))
    return cells.reached(sizes, sizes.select("sheet", "i", F.lit(3).alias("offset"), F.lit(70).alias("extent"))).select("sheet", "i", "reached")


@query("""with c as (select p_partkey as id, printf('%06X', cast(p_partkey * 7919 % 16777216 as bigint)) as hex, p_partkey % 4 as k, (p_size % 5 - 2) / 4.0 as t from part),
r as (select id, k, t, cast('0x' || hex[1:2] as int) as r, cast('0x' || hex[3:4] as int) as g, cast('0x' || hex[5:6] as int) as b from c)
select id, case when k = 3 then null when k = 2 or t = 0 then r when t < 0 then round_even(r * (1 + t), 0) else round_even(r * (1 - t) + 255 * t, 0) end::int as r, case when k = 3 then null when k = 2 or t = 0 then g when t < 0 then round_even(g * (1 + t), 0) else round_even(g * (1 - t) + 255 * t, 0) end::int as g,
 case when k = 3 then null when k = 2 or t = 0 then b when t < 0 then round_even(b * (1 + t), 0) else round_even(b * (1 - t) + 255 * t, 0) end::int as b from r""")
def cell_colours(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = F.format_string("%06X", F.col("p_partkey") * 7919 % 16777216)
    theme = F.array(F.lit("000000"), F.lit("000000"), own)
    kind = F.when(F.col("p_partkey") % 4 == 2, "rgb").otherwise("theme")
    index = F.when(F.col("p_partkey") % 4 == 3, 9).otherwise(2)
    out = p.select(F.col("p_partkey").alias("id"), colours.fill(F.lit("solid"), colours.resolved(kind, F.concat(F.lit("FF"), own), index, (F.col("p_size") % 5 - 2) / 4.0, theme)).alias("c"))
    return out.select("id", "c.r", "c.g", "c.b")


@query("""with c as (select p_partkey as id, cast(p_partkey * 31 % 256 as double) / 255 as r, cast(p_partkey * 57 % 256 as double) / 255 as g, cast(p_partkey * 91 % 256 as double) / 255 as b, p_size * 3000 as m, (p_size % 7 - 3) * 5000 as o from part),
h as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from c), l as (select *, (hi + lo) / 2 as l, hi - lo as s from h),
t as (select *, case when s = 0 then 0 when l <= 0.5 then s / (hi + lo) else s / (2 - hi - lo) end as sat, case when s = 0 then 0 when r = hi then (g - b) / s when g = hi then 2 + (b - r) / s else 4 + (r - g) / s end / 6 as hue, least(1, greatest(0, l * (m / 100000.0) + o / 100000.0)) as nl from l),
q as (select *, case when nl <= 0.5 then nl * (1 + sat) else nl + sat - nl * sat end as top from t),
x as (select id, sat, nl, top, 2 * nl - top as bot, unnest([0, 1, 2]) as k, unnest([hue + 1 / 3, hue, hue - 1 / 3]) as u from q),
y as (select *, u - floor(u) as f from x),
z as (select id, k, round_even(case when sat = 0 then nl when f < 1 / 6 then bot + (top - bot) * f * 6 when f < 0.5 then top when f < 2 / 3 then bot + (top - bot) * (2 / 3 - f) * 6 else bot end * 255, 0)::bigint as v from y)
select id, string_agg(printf('%02X', v), '' order by k) as colour from z group by id""")
def lightness(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    own = F.format_string("%02X%02X%02X", k * 31 % 256, k * 57 % 256, k * 91 % 256)
    return p.select(k.alias("id"), colours.lightness_changed(own, F.col("p_size") * 3000, (F.col("p_size") % 7 - 3) * 5000).alias("colour"))


CHART = "select o_custkey as chart, concat('s', cast(o_orderkey % 4 as string)) as series, cast(o_orderkey % 4 as int) as place, case when o_orderkey % 4 < 2 then 'bar' else 'line' end as kind, case when o_orderkey % 4 = 3 then 'right' else 'left' end as axis, cast(o_orderkey % 3 as int) as i, concat('c', cast(o_orderkey % 3 as string)) as category, max(case when o_orderkey % 13 > 0 then o_totalprice end) as value from orders group by 1, 2, 3, 4, 5, 6, 7"
SCALE = f"with v as ({CHART}), top as (select chart, axis, coalesce(nullif(max(value), 0), 1) as top from v group by 1, 2), n as (select chart, max(i) + 1 as n from v group by 1), s as (select v.*, top, 900.0 / n as step, 900.0 / n * (i + 0.5) as x, 500 * value / top as h from v join top using (chart, axis) join n using (chart))"


def chart_values(spark, sf_dir):
    return spark.sql(CHART.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query(SCALE + """, k as (select chart, series, row_number() over (partition by chart order by place) - 1 as k, count(*) over (partition by chart) as b from (select distinct chart, series, place from v where kind = 'bar'))
select chart, series, i, round(x - step * 0.35 + k * step * 0.7 / b, 4) as x0, round(x - step * 0.35 + k * step * 0.7 / b + step * 0.7 / b * 0.9, 4) as x1, round(500 - h, 4) + 0.0 as y0, 500.0::double as y1 from s join k using (chart, series) where kind = 'bar' and value is not null""")
def chart_bars(spark, sf_dir):
    b = charts.bars(chart_values(spark, sf_dir), 900.0, 500.0)
    return b.select("chart", "series", "i", *[F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query(SCALE + "select chart, series, i, round(x, 4) as x, round(500 - h, 4) + 0.0 as y from s where kind = 'line' and value is not null")
def chart_lines(spark, sf_dir):
    return charts.line_points(chart_values(spark, sf_dir), 900.0, 500.0).select("chart", "series", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(SCALE + "select chart, axis, k::int as tick, round(500 - 500 * k / 5.0, 4)::double as y, round(top * k / 5, 4) as value from top, (select unnest(range(6)) as k)")
def chart_ticks(spark, sf_dir):
    return charts.ticks(chart_values(spark, sf_dir), 500.0).select("chart", "axis", "tick", F.round("y", 4).alias("y"), F.round("value", 4).alias("value"))


@query(SCALE + """, h as (select chart, '|' || string_agg(series, '|' order by place) as cells from (select distinct chart, series, place from v) group by 1),
r as (select chart, i + 1 as r, min(category) || '|' || string_agg(case when value is null then '' else 'v' end, '|' order by place) as cells from v group by 1, 2)
select chart, 0 as r, cells from h union all select chart, r::int, cells from r""")
def chart_grids(spark, sf_dir):
    g = charts.grids(chart_values(spark, sf_dir))
    return g.select("chart", "r", F.array_join(F.transform("cells", lambda c: F.when(c.rlike(r"^\d"), "v").otherwise(c)), "|").alias("cells"))
