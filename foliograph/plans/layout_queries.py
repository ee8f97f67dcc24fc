"""Queries over headings, boxes, sheets and number formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as tx
from ..operators import cells, headings, sheets
from ..operators import geometry as geo
from ..sources.adapters import adapter, prefix
from .catalog import query
from .graph_queries import CHAIN, chain


@query(prefix("outline") + """,
h as (select * from outline where level is not null and not excluded),
p as (select o.doc, o.artifact, o.ord, o.id, o.level, o.excluded, arg_max(struct_pack(i := h.id), h.ord) as up from outline o left join h on h.artifact = o.artifact and h.ord < o.ord and (o.level is null or h.level < o.level) and not o.excluded where o.id is not null group by all)
select doc, artifact, ord, id, coalesce(up.i, artifact) as parent, not excluded and case when up is null then level is not null else up.i is not null end as structural from p""")
def hierarchy_outline(spark, sf_dir):
    return headings.hierarchy(adapter(spark, sf_dir, "outline")).drop("level", "excluded")


NUM = prefix("numbered") + r""",
h as (select *, regexp_extract(text, '^(\d+(?:\.\d+)*)\s+[A-Za-z]', 1) as number from numbered where not is_toc and regexp_matches(text, '^(\d+(?:\.\d+)*)\s+[A-Za-z]')),
x as (select *, regexp_extract(number, '^(.*)\.\d+$', 1) as p from h where number like '%.%')"""


@query(NUM + """, l as (select x.doc, x.artifact, x.id, x.p, arg_max(struct_pack(n := h.number, i := h.id), h.ord) as last from x join h on h.artifact = x.artifact and h.ord < x.ord and not starts_with(h.number, x.p || '.') group by all)
select doc, id, last.i as parent from l where last.n = p""")
def numbered_nesting(spark, sf_dir):
    return headings.numbered_nesting(adapter(spark, sf_dir, "numbered"))


@query(prefix("report") + r""", i as (select *, cast(regexp_extract(text, '^(\d+)\)', 1) as int) as n, row_number() over (partition by doc, artifact order by ord) as k from report where type = 'Text' and regexp_matches(text, '^\d+\)')),
g as (select *, n - k as d from i), s as (select *, case when n = lag(n) over w + 1 then 0 else 1 end as fresh from i window w as (partition by doc, artifact order by ord)),
r as (select *, sum(fresh) over (partition by doc, artifact order by ord) as run from s)
select doc, artifact, run::bigint as run, count(*)::bigint as n, arg_min(id, ord) as first_id, string_agg(id, ',' order by ord) as ids from r group by 1, 2, 3 having count(*) >= 2""")
def enumerated_runs(spark, sf_dir):
    nodes = adapter(spark, sf_dir, "report").withColumn("parent", F.col("artifact")).withColumn("is_toc", F.lit(False))
    return headings.enumerated_runs(nodes).withColumn("ids", F.array_join("ids", ","))


@query(prefix("numbered") + r""", m as (select *, length(text) <= 60 and regexp_matches(text, '^\d{1,2}[.\s]+[^\d\s.]') as num, length(text) <= 60 and regexp_matches(text, '^<[^<>]{1,40}>$') as ang from numbered),
p as (select t.doc, t.artifact, t.id, t.num, 'numbered' as family, arg_max(h.id, h.ord) as heading from m t join m h on h.artifact = t.artifact and h.ord < t.ord and h.num group by all
 union all select t.doc, t.artifact, t.id, t.num, 'angled', arg_max(h.id, h.ord) from m t join m h on h.artifact = t.artifact and h.ord < t.ord and h.ang group by all)
select doc, id, family, heading from p where not num or family = 'numbered'""")
def open_heading_asof(spark, sf_dir):
    return headings.open_headings(adapter(spark, sf_dir, "numbered"))


@query(prefix("numbered") + r"""select t.doc, t.id, arg_max(h.id, h.ord) as heading from numbered t join numbered h on h.artifact = t.artifact and h.ord < t.ord and h.text like '<%' where not regexp_matches(t.text, '^(\d+(?:\.\d+)*)\s+[A-Za-z]') group by 1, 2""")
def confirmed_heading_asof(spark, sf_dir):
    nodes = adapter(spark, sf_dir, "numbered")
    return headings.confirmed_heading(nodes, nodes.where("text like '<%'"))


@query(f"with e as ({CHAIN}) select '1' as doc, id, cast(case when id < 230 then id - 1 else id % 230 end as int) as depth from e where id > 0")
def node_depth(spark, sf_dir):
    c = chain(spark, sf_dir).where("id > 0")
    return headings.depths(c.selectExpr("'1' doc", "id"), c.where("up is not null").selectExpr("'1' doc", "id", "up parent"))


# Events as outlines of twelve levels and body, in scopes of 50.
DEEP = "select '1' as doc, cast(cast(floor(event_id / 50) as bigint) as string) as artifact, cast(event_id as int) as ord, cast(event_id as string) as id, case when event_id * 7 % 13 < 12 then cast(event_id * 7 % 13 as int) end as level, event_id % 17 = 3 as excluded from events"


@query(f"""with o as ({DEEP}), h as (select * from o where level is not null and not excluded),
p as (select o.doc, o.artifact, o.ord, o.id, o.level, o.excluded, arg_max(h.id, h.ord) as up from o left join h on h.artifact = o.artifact and h.ord < o.ord and (o.level is null or h.level < o.level) and not o.excluded group by all)
select doc, artifact, ord, id, coalesce(up, artifact) as parent, not excluded and (level is not null or up is not null) as structural from p""")
def hierarchy_deep(spark, sf_dir):
    e = spark.sql(DEEP.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return headings.hierarchy(e).drop("level", "excluded")


def boxes(spark, sf_dir):
    b = adapter(spark, sf_dir, "boxes")
    return b.select("page", "id", "ord", geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))


@query(prefix("boxes") + "select page, min(x0)::int as x_min, min(y0)::int as y_min, max(x1)::int as x_max, max(y1)::int as y_max from boxes group by page")
def bbox_union(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page").agg(geo.union_box("bbox").alias("b")).select("page", "b.*")


@query(prefix("boxes") + "select id, round_even(x0 / 613.0 * 1000, 0)::int as x_min, round_even(y0 / 792.0 * 1000, 0)::int as y_min, round_even(x1 / 613.0 * 1000, 0)::int as x_max, round_even(y1 / 792.0 * 1000, 0)::int as y_max from boxes")
def bbox_normalise(spark, sf_dir):
    b = adapter(spark, sf_dir, "boxes")
    return b.select("id", geo.normalised(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(613.0), F.lit(792.0)).alias("b")).select("id", "b.*")


IOU = prefix("boxes") + """, p as (select a.page, a.id as a, b.id as b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as i,
 (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s from boxes a join boxes b on a.page = b.page and a.id < b.id)"""


@query(IOU + "select page, a, b, round(i / (s - i), 6) as iou from p where i / (s - i) > 0.1")
def iou_pairs(spark, sf_dir):
    return geo.iou_pairs(boxes(spark, sf_dir), 0.1).withColumn("iou", F.round("iou", 6))


@query(prefix("boxes") + "select r.page, r.id as region, b.id from boxes r join boxes b on r.page = b.page and r.id % 5 = 0 and b.id % 5 > 0 and b.x0 + b.x1 between 2 * (r.x0 - 2) and 2 * (r.x1 + 2) and b.y0 + b.y1 between 2 * (r.y0 - 2) and 2 * (r.y1 + 2)")
def centre_absorption(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return geo.absorbed(b.where("id % 5 = 0").select("page", F.col("id").alias("region"), F.col("bbox").alias("rb")), b.where("id % 5 > 0"))


@query(prefix("boxes") + """select p.page, p.id as point, arg_min(b.id, cast((b.x1 - b.x0) * (b.y1 - b.y0) as bigint) * 1000000 + b.ord) as id from boxes p join boxes b on p.page = b.page
 and p.x0 between b.x0 - 3 and b.x1 + 3 and p.y0 between b.y0 - 3 and b.y1 + 3 group by 1, 2""")
def smallest_node_at_point(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return geo.smallest_at(b.select("page", F.col("id").alias("point"), F.col("bbox.x_min").alias("x"), F.col("bbox.y_min").alias("y")), b)


REACH = """ both_ as (select page, a, b from near union all select page, b, a from near),
reach as (select page, id, id as c from boxes union select r.page, x.b, r.c from reach r join both_ x on x.page = r.page and x.a = r.id),
comp as (select page, id, min(c) as cluster from reach group by 1, 2)"""


@query(prefix("boxes").replace("with ", "with recursive ", 1) + """, near as (select a.page, a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id < b.id and a.y1 - a.y0 <= 40 and b.y1 - b.y0 <= 40
 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)),""" + REACH + """
select page, cluster, count(*)::bigint as n, string_agg(id, ',' order by x0, id) as ids, min(x0)::int as x_min, max(y1)::int as y_max from comp join boxes using (page, id) group by 1, 2 having count(*) >= 2""")
def same_line_clusters(spark, sf_dir):
    return geo.line_clusters(boxes(spark, sf_dir)).select("page", "cluster", "n", F.array_join("ids", ",").alias("ids"), "bbox.x_min", "bbox.y_max")


@query(prefix("boxes").replace("with ", "with recursive ", 1) + """, near as (select a.page, a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id < b.id
 where greatest(a.x0 - b.x1, b.x0 - a.x1) <= 40 and greatest(a.y0 - b.y1, b.y0 - a.y1) <= 40),""" + REACH + """
select page, cluster, count(*)::bigint as n, min(x0)::int as x_min, max(x1)::int as x_max from comp join boxes using (page, id) group by 1, 2 having count(*) >= 5 and max(x1) - min(x0) >= 30 and max(y1) - min(y0) >= 30""")
def figure_density(spark, sf_dir):
    return geo.dense_figures(boxes(spark, sf_dir), 40, 5).select("page", "cluster", "n", "bbox.x_min", "bbox.x_max")


@query(prefix("boxes").replace("with ", "with recursive ", 1) + """, near as (select a.page, a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id < b.id where a.y1 - a.y0 <= 80 and b.y1 - b.y0 <= 80 and
 ((greatest(a.y0 - b.y1, b.y0 - a.y1, 0) = 0 and greatest(a.x0 - b.x1, b.x0 - a.x1, 0) <= 80) or (greatest(a.x0 - b.x1, b.x0 - a.x1, 0) = 0 and greatest(a.y0 - b.y1, b.y0 - a.y1, 0) <= 32))),""" + REACH + """,
o as (select page, cluster, id, row_number() over (partition by page, cluster order by y0, x0, id) - 1 as k, count(*) over (partition by page, cluster) as n from comp join boxes using (page, id) where y1 - y0 <= 80)
select page, cluster, (k // 20)::int as chunk, id, (k % 20)::int as place from o where n >= 2""")
def semantic_regions(spark, sf_dir):
    return geo.semantic_regions(boxes(spark, sf_dir))


@query()
def nms(spark, sf_dir):
    return geo.suppressed(boxes(spark, sf_dir))


@query(prefix("boxes") + "select page as doc, id, row_number() over (partition by page order by case when id % 7 = 0 then 0 else 1 end, id % 3, y0, ord)::int as place from boxes")
def page_resort(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("type", F.expr("case when id % 7 = 0 then 'Artifact' else 'Text' end"))
    return geo.page_order(b.withColumnRenamed("page", "doc").withColumn("page", F.expr("id % 3"))).select("doc", "id", "place")


def sheet(spark, sf_dir):
    return adapter(spark, sf_dir, "sheet")


@query(prefix("sheet") + "select sheet, (max(row) + 5)::int as max_row, (max(col) + 5)::int as max_col from sheet group by sheet")
def content_bounds(spark, sf_dir):
    return cells.bounds(sheet(spark, sf_dir))


@query(prefix("sheet").replace("with ", "with recursive ", 1) + """, reach as (select sheet, row, col, row::bigint * 100000 + col as c from sheet union select s.sheet, s.row, s.col, r.c from reach r join sheet s on s.sheet = r.sheet and abs(s.row - r.row) <= 1 and abs(s.col - r.col) <= 1 where s.row * 100000 + s.col > r.c),
comp as (select sheet, row, col, min(c) as comp from reach group by 1, 2, 3)
select sheet, comp, count(*)::bigint as n, string_agg(value, ' / ' order by row, col) as text from comp join sheet using (sheet, row, col) group by 1, 2""")
def component_text(spark, sf_dir):
    return cells.component_texts(sheet(spark, sf_dir))


@query(prefix("sheet") + ", s as (select sheet, row as i, sum(col)::bigint as size from sheet group by 1, 2) select sheet, i, size, coalesce(sum(size) over (partition by sheet order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from s")
def prefix_offsets(spark, sf_dir):
    return cells.offsets(sheet(spark, sf_dir).groupBy("sheet", F.col("row").alias("i")).agg(F.sum("col").alias("size")))


FORMATS = ["0.00", "#,##0.00", '"EUR "#,##0.0;[Red](#,##0.0);"none"', "0.0%", "%0", '0" days"', "General"]


@query("""with v as (select o_orderkey as id, cast(o_orderkey % 7 as int) as k, case when o_orderkey % 11 = 0 then 0 when o_orderkey % 3 = 0 then -o_totalprice else o_totalprice end as x from orders)
select id, case k when 0 then printf('%.2f', x) when 1 then format('{:,.2f}', x) when 2 then case when x > 0 then format('EUR {:,.1f}', x) when x < 0 then format('({:,.1f})', -x) else 'none' end
 when 3 then case when x < 0 then '-' else '' end || printf('%.1f', abs(x) * 100) || '%' when 4 then case when x < 0 then '-' else '' end || '%' || printf('%.0f', abs(x) * 100)
 when 5 then case when x < 0 then '-' else '' end || printf('%.0f', abs(x)) || ' days' else cast(cast(floor(x) as bigint) as varchar) end as shown from v""")
def number_format(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.expr("case when o_orderkey % 11 = 0 then 0 when o_orderkey % 3 = 0 then -o_totalprice else o_totalprice end")
    v = o.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("fmt"), x.alias("x"))
    v = v.withColumn("x", F.when(F.col("fmt") == "General", F.floor("x")).otherwise(F.col("x")))
    return v.select("id", numbers.displayed_by(F.col("x"), F.col("fmt"), FORMATS).alias("shown"))


@query("""select o_orderkey as id, case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%y-%m-%d') when 2 then strftime(o_orderdate, '%m-%d-%Y') when 3 then strftime(o_orderdate, '%m/%d/%Y')
 when 4 then strftime(o_orderdate, '%Y-%m') when 5 then strftime(o_orderdate, '%m-%d') else strftime(o_orderdate, '%Y-%m-%d') end as shown from orders""")
def date_format_xl(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fmt = F.element_at(F.array(*map(F.lit, ["yyyy/mm/dd", "YY.MM.DD", "mm-dd-yyyy", "m/d/yyyy", "yyyy.mm", "mm/dd", "[$-409]d mmm"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), numbers.excel_date(F.col("o_orderdate"), fmt).alias("shown"))


@query(prefix("boxes") + "select id, case when id % 3 = 0 then concat('row ', (id % 9)::varchar, ' col ', page::varchar) else concat('page ', page::varchar, ' bbox ', x0::varchar, ',', y0::varchar, ',', x1::varchar, ',', y1::varchar) end as hint from boxes")
def layout_hint(spark, sf_dir):
    b = boxes(spark, sf_dir)
    cell = F.col("id") % 3 == 0
    return b.select("id", tx.layout_hint(F.when(~cell, F.col("page")), F.when(~cell, F.col("bbox")), F.when(cell, F.col("id") % 9), F.when(cell, F.col("page"))).alias("hint"))


# Customers as bordered cells: twenty to a sheet's row, rectangles of three by two with gaps, some of them open.
BORDERS = "select cast(floor(c_custkey / 400) as int) as sheet, cast(floor(c_custkey / 20) % 20 as int) as row, cast(c_custkey % 20 as int) as col, c_custkey % 20 % 4 < 3 and floor(c_custkey / 20) % 3 = 0 and c_custkey % 37 > 0 as top, c_custkey % 20 % 4 = 0 and floor(c_custkey / 20) % 3 < 2 as left_, c_custkey % 20 % 4 < 3 and floor(c_custkey / 20) % 3 = 1 as bottom, c_custkey % 20 % 4 = 2 and floor(c_custkey / 20) % 3 < 2 as right_ from customer"


@query(f"""with b as ({BORDERS}), k as (select sheet, row as r0, col as c0 from b where top and left_),
e as (select k.*, (select coalesce(min(x.col), 20) - 1 from (select k.sheet as s, k.r0 as r, unnest(range(20)) as col) x where x.col > k.c0 and not exists (select 1 from b where b.sheet = x.s and b.row = x.r and b.col = x.col and b.top)) as c1,
 (select coalesce(min(x.row), 20) - 1 from (select k.sheet as s, k.c0 as c, unnest(range(20)) as row) x where x.row > k.r0 and not exists (select 1 from b where b.sheet = x.s and b.col = x.c and b.row = x.row and b.left_)) as r1 from k),
f as (select e.* from e where (r1 > r0 or c1 > c0) and (select count(*) from b where b.sheet = e.sheet and b.row = e.r1 and b.col between e.c0 and e.c1 and bottom) = c1 - c0 + 1 and (select count(*) from b where b.sheet = e.sheet and b.col = e.c1 and b.row between e.r0 and e.r1 and right_) = r1 - r0 + 1),
o as (select * from f where not exists (select 1 from f g where g.sheet = f.sheet and g.r0 <= f.r0 and g.c0 <= f.c0 and g.r1 >= f.r1 and g.c1 >= f.c1 and (g.r0, g.c0, g.r1, g.c1) <> (f.r0, f.c0, f.r1, f.c1)))
select sheet, 'BorderTable' || row_number() over (partition by sheet order by r0, c0) as name, r0, c0, r1::int as r1, c1::int as c1 from o""")
def border_tables(spark, sf_dir):
    b = spark.sql(BORDERS.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return sheets.border_tables(b.withColumnsRenamed({"left_": "left", "right_": "right"}))


RANGES = "select distinct sheet, cast(concat('t', cast(floor(row / 30) as int)) as string) as name, cast(floor(row / 30) as int) * 30 as r0, 2 as c0, cast(floor(row / 30) as int) * 30 + 9 as r1, 5 as c1 from sheet"


def ranges(spark, sf_dir):
    return spark.sql(RANGES.replace("from sheet", "from {sheet}"), sheet=sheet(spark, sf_dir))


@query(prefix("sheet") + f", r as ({RANGES}) select sheet, name, r0, count(value)::bigint as filled, string_agg(coalesce(value, ''), '|' order by y, x) as cells from (select r.*, y, x, s.value from r, (select unnest(range(10)) as y), (select unnest(range(2, 6)) as x) left join sheet s on s.sheet = r.sheet and s.row = r.r0 + y and s.col = x) group by 1, 2, 3")
def table_grids(spark, sf_dir):
    g = sheets.table_grids(sheet(spark, sf_dir), ranges(spark, sf_dir))
    flat = F.flatten("grid")
    return g.select("sheet", "name", "r0", F.size(F.filter(flat, lambda v: v != "")).cast("long").alias("filled"), F.array_join(flat, "|").alias("cells"))


@query(prefix("sheet") + f", r as ({RANGES}) select s.sheet, s.row, s.col, s.value from sheet s where not exists (select 1 from r where r.sheet = s.sheet and s.row between r.r0 and r.r1 and s.col between r.c0 and r.c1)")
def cells_outside(spark, sf_dir):
    return cells.in_ranges(sheet(spark, sf_dir), ranges(spark, sf_dir), "left_anti")


@query(prefix("sheet") + f", r as ({RANGES}) select s.sheet, s.row, s.col, coalesce(r.r0, s.row) as anchor_row, coalesce(r.c0, s.col) as anchor_col from sheet s left join r on r.sheet = s.sheet and s.row between r.r0 and r.r1 and s.col between r.c0 and r.c1")
def merged_anchors(spark, sf_dir):
    return cells.with_anchors(sheet(spark, sf_dir), ranges(spark, sf_dir)).drop("value")


@query(prefix("boxes").replace("with ", "with recursive ", 1) + """, near as (select a.page, a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1),""" + REACH + " select page as sheet, id, cluster as base from comp")
def picture_groups(spark, sf_dir):
    return sheets.picture_groups(boxes(spark, sf_dir).withColumnRenamed("page", "sheet"))
