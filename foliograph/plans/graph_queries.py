"""Queries over the report graph: containment, captions, citations, integrity, windows, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import enrich, export, graph, windows
from ..operators import geometry as geo
from ..schema import EDGE_TYPES, NODE_TYPES
from ..sources.adapters import adapter, prefix
from .catalog import query


def report(spark, sf_dir):
    return adapter(spark, sf_dir, "report")


def whole(spark, sf_dir):
    """The report graph with its files and artifacts, and PARENT_OF edges from top to bottom."""
    nodes = report(spark, sf_dir)
    arts = nodes.groupBy("doc", "artifact").agg(F.lit(0).alias("ord")).select("doc", "artifact", "ord", F.concat(F.lit("a"), "artifact").alias("id"), F.lit("Artifact").alias("type"))
    files = nodes.select("doc").distinct().select("doc", F.lit(0).alias("ord"), F.concat(F.lit("f"), "doc").alias("id"), F.lit("File").alias("type"))
    every = nodes.unionByName(arts, allowMissingColumns=True).unionByName(files, allowMissingColumns=True)
    edges = nodes.select("doc", *graph.edge("PARENT_OF", F.concat(F.lit("a"), "artifact"), "id"))
    edges = edges.unionByName(arts.select("doc", *graph.edge("PARENT_OF", F.concat(F.lit("f"), "doc"), "id")))
    return every, edges


WHOLE = (
    prefix("report")
    + """,
arts as (select doc, artifact, concat('a', artifact) as id from report group by doc, artifact),
nodes as (select doc, id, type from report union all select doc, id, 'Artifact' from arts union all select distinct doc, concat('f', doc), 'File' from report),
edges as (select doc, 'PARENT_OF' as type, concat('a', artifact) as source, id as target from report union all select doc, 'PARENT_OF', concat('f', doc), id from arts)"""
)
NEAR = """,
near as (select *, lag(id) over w as p_id, lag(type) over w as p_type, lead(id) over w as n_id, lead(type) over w as n_type from report window w as (partition by doc, artifact order by ord)),
capt as (select * from near where type = 'Text' and (starts_with(text, 'Table ') or starts_with(text, 'Figure '))),
caps as (select doc, artifact, id as source, p_id as target, ord * 2 as edge_ord from capt where p_type in ('Table', 'Image')
 union all select doc, artifact, id, n_id, ord * 2 + 1 from capt where n_type in ('Table', 'Image'))"""
LABELLED = """,
found as (select doc, artifact, ord, id, unnest(regexp_extract_all(text, '(?i)(table|figure)\\.?\\s*(\\d+)')) as m, unnest(range(1, 1 + len(regexp_extract_all(text, '(?i)(table|figure)\\.?\\s*(\\d+)')))) as k from report where type = 'Text'),
lab as (select doc, artifact, id, k, case when lower(m) like 'table%' then 'table:' else 'figure:' end || regexp_extract(m, '\\d+') as label from found),
anchors as (select c.doc, c.artifact, l.label, arg_max(c.target, c.edge_ord) as anchor from caps c join lab l on l.doc = c.doc and l.artifact = c.artifact and l.id = c.source and l.k = 1 group by all),
refs as (select distinct l.doc, l.id as source, a.anchor as target from lab l join anchors a using (doc, artifact, label) where l.id not in (select source from caps))"""


@query(WHOLE + f"select d.doc, t.type, count(n.id)::bigint as n from (select distinct doc from nodes) d cross join (select unnest({list(NODE_TYPES)}) as type) t left join nodes n on n.doc = d.doc and n.type = t.type group by 1, 2")
def node_type_counts(spark, sf_dir):
    return graph.node_counts(whole(spark, sf_dir)[0])


@query(WHOLE + f"select d.doc, t.type, count(n.target)::bigint as n from (select distinct doc from edges) d cross join (select unnest({list(EDGE_TYPES)}) as type) t left join edges n on n.doc = d.doc and n.type = t.type group by 1, 2")
def edge_type_counts(spark, sf_dir):
    return graph.edge_counts(whole(spark, sf_dir)[1])


@query(WHOLE + "select doc, count(*)::bigint as n, count(distinct type)::bigint as kinds from nodes where type not in ('File', 'Artifact') group by doc")
def content_nodes(spark, sf_dir):
    return graph.content_nodes(whole(spark, sf_dir)[0]).groupBy("doc").agg(F.count("*").alias("n"), F.countDistinct("type").alias("kinds"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as ord from documents where text is not null)
select doc_id, ord::bigint as ord, case when length(t) > 40 then left(t, 40) || '…' else t end as name from l where t <> ''""")
def node_names40(spark, sf_dir):
    lines = adapter(spark, sf_dir, "lines").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "t")).where("t <> ''")
    return lines.select("doc_id", F.col("ord").cast("long").alias("ord"), graph.short_name(F.col("t")).alias("name"))


@query(prefix("report") + "select doc, 'PARENT_OF' as type, artifact as source, id as target from report")
def parent_edges(spark, sf_dir):
    return graph.parent_edges(report(spark, sf_dir))


@query(prefix("report") + """, a as (select doc, artifact as id, cast(artifact as int) as ord from report group by doc, artifact)
select * from (select doc, 'NEXT' as type, id as source, lead(id) over (partition by doc order by ord) as target from a) where target is not null""")
def next_chain(spark, sf_dir):
    arts = report(spark, sf_dir).select("doc", F.col("artifact").alias("id"), F.col("artifact").cast("int").alias("ord")).distinct()
    return graph.next_edges(arts)


@query(prefix("report") + NEAR + "select doc, artifact, 'CAPTION_OF' as type, source, target, edge_ord from caps")
def caption_prefix(spark, sf_dir):
    return graph.caption_edges(report(spark, sf_dir))


@query(prefix("report") + NEAR + LABELLED + "select doc, 'REFERENCES' as type, source, target from refs")
def reference_labels(spark, sf_dir):
    nodes = report(spark, sf_dir)
    return graph.reference_edges(nodes, graph.caption_edges(nodes))


@query(prefix("report") + NEAR + LABELLED + """, every as (select doc, 'PARENT_OF' as type, artifact as source, id as target from report
 union all select doc, 'CAPTION_OF', source, target from caps union all select doc, 'REFERENCES', source, target from refs)
select doc, type, count(*)::bigint as n, count(distinct target)::bigint as targets from every group by doc, type""")
def finalize(spark, sf_dir):
    nodes = report(spark, sf_dir)
    once = graph.finalize(nodes, graph.parent_edges(nodes))
    return once.groupBy("doc", "type").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


@query(prefix("report") + NEAR + "select doc, source, count(distinct target)::bigint as n from caps group by doc, source having count(distinct target) > 1")
def ambiguous_captions(spark, sf_dir):
    return graph.ambiguous_captions(graph.caption_edges(report(spark, sf_dir)))


@query(WHOLE + """, kept as (select * from nodes where hash_key(id) > 0),
x as (select doc, source as e from edges union select doc, target from edges) select x.doc, x.e as "end" from x left join kept n on n.doc = x.doc and n.id = x.e where n.id is null""".replace("hash_key(id) > 0", "not (id like '%7')"))
def invariant_dangling(spark, sf_dir):
    nodes, edges = whole(spark, sf_dir)
    return graph.dangling(nodes.where("id not like '%7'"), edges)


@query(WHOLE + """, more as (select * from edges union all select doc, type, target as source, concat('a', source) as target from edges where target like '%3')
select doc, target, count(*)::bigint as n from more group by doc, target having count(*) > 1""")
def invariant_fanin(spark, sf_dir):
    edges = whole(spark, sf_dir)[1]
    more = edges.where("target like '%3'").select("doc", *graph.edge("PARENT_OF", "target", F.concat(F.lit("a"), "source")))
    return graph.fan_in(edges.unionByName(more))


@query("""with e as (select cast(o_custkey % 10 as string) as doc, cast(o_orderkey % 4000 as string) as source, cast(o_custkey % 3000 as string) as target from orders)
select doc, source as id, 'out' as side, count(*)::bigint as n from e group by 1, 2 having count(*) > 1 union all select doc, target, 'in', count(*)::bigint from e group by 1, 2 having count(*) > 1""")
def invariant_next_degree(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return graph.next_degree(o.selectExpr("cast(o_custkey % 10 as string) doc", "'NEXT' type", "cast(o_orderkey % 4000 as string) source", "cast(o_custkey % 3000 as string) target"))


# Parts in documents of 97, each part under one other, every fifth also under a second one, and in odd documents only under lesser ones.
FAN = "select doc, id, up from (select floor(p_partkey / 97) as doc, p_partkey % 97 as id, (p_partkey * 31 + 7) % 97 as up from part union select floor(p_partkey / 97), p_partkey % 97, (p_partkey * 17) % 97 from part where p_partkey % 5 = 0) as x where doc % 2 = 0 or up < id"


@query(f"""with recursive e as ({FAN}),
r as (select doc, id, 1 as k from e union select e.doc, e.id, k + 1 from r join e on e.doc = r.doc and e.up = r.id where k < 98)
select distinct cast(doc as bigint) as doc, cast(id as bigint) as id from r where k = 98""")
def invariant_cycles(spark, sf_dir):
    e = spark.sql(FAN.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    found = graph.on_cycles(e.selectExpr("doc", "'PARENT_OF' type", "up source", "id target"))
    return found.select(F.col("doc").cast("long").alias("doc"), F.col("id").cast("long").alias("id"))


#: Customers in chains of 200 and more under an artifact: each hangs under the one before, every 230th is an artifact, and the first has none.
CHAIN = "select c_custkey as id, case when c_custkey % 230 <> 0 and c_custkey > 1 then c_custkey - 1 end as up, c_custkey % 230 = 0 as top from customer"


def chain(spark, sf_dir):
    return spark.sql(CHAIN.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


@query(f"with e as ({CHAIN}) select '1' as doc, cast(id as varchar) as id, cast(id - id % 230 as varchar) as artifact from e where not top and id > 230")
def artifact_map_climb(spark, sf_dir):
    c = chain(spark, sf_dir)
    nodes = c.selectExpr("'1' doc", "cast(id as string) id", "case when top then 'Artifact' else 'Text' end type")
    return graph.artifact_map(nodes, c.where("up is not null").selectExpr("'1' doc", "'PARENT_OF' type", "cast(up as string) source", "cast(id as string) target"))


@query(f"""with e as ({CHAIN}) select '1' as doc, cast(id as varchar) as id, case when top or id <= 230 then null when id % 7 = 0 then '230' else cast(id - id % 230 as varchar) end as native_artifact, case when not top then cast(id % 9 as int) end as native_page from e""")
def native_locations(spark, sf_dir):
    c = chain(spark, sf_dir)
    nodes = c.selectExpr("'1' doc", "cast(id as string) id", "case when top then 'Artifact' else 'Text' end type", "cast(id % 9 as int) page", "case when not top and id > 230 and id % 7 = 0 then '230' end native_artifact")
    return graph.with_native_location(nodes, c.where("up is not null").selectExpr("'1' doc", "'PARENT_OF' type", "cast(up as string) source", "cast(id as string) target")).select("doc", "id", "native_artifact", "native_page")


@query(prefix("report") + "select doc, id, type from report where id in (select cast(o_orderkey * 2 as varchar) from orders)")
def nodes_by_id(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey * 2 as string) id")
    nodes = report(spark, sf_dir)
    return graph.nodes_by_id(nodes, nodes.join(ids.distinct(), "id", "left_semi")).select("doc", "id", "type")


WINDOWS = """,
t as (select doc, artifact, id, ord from report where type = 'Text'), b as (select doc, artifact, id, ord from report where type in ('Table', 'Image'))"""


@query(prefix("report") + WINDOWS + """,
l as (select b.doc, b.artifact, b.id as anchor, t.id as candidate, t.ord, row_number() over (partition by b.doc, b.artifact, b.id, t.ord < b.ord order by abs(t.ord - b.ord)) as k
 from b join t on t.doc = b.doc and t.artifact = b.artifact and not exists (select 1 from b x where x.doc = b.doc and x.artifact = b.artifact and x.ord > least(b.ord, t.ord) and x.ord < greatest(b.ord, t.ord)))
select doc, artifact, anchor, candidate, ord from l where k <= 3""")
def context_windows_bounded(spark, sf_dir):
    return windows.context_windows(report(spark, sf_dir))


WIDE = WINDOWS + """,
l as (select b.doc, b.artifact, b.id as anchor, t.id as candidate, t.ord, row_number() over (partition by b.doc, b.artifact, b.id, t.ord < b.ord order by abs(t.ord - b.ord)) as k
 from b join t on t.doc = b.doc and t.artifact = b.artifact), wide as (select doc, artifact, anchor, candidate, ord from l where k <= 3)"""


@query(prefix("report") + WIDE + "select * from wide")
def context_windows_wide(spark, sf_dir):
    return windows.context_windows(report(spark, sf_dir), boundaries=())


def placed(spark, sf_dir):
    n = F.col("id").cast("long")
    x, y = n * 37 % 900, n * 91 % 940
    return report(spark, sf_dir).withColumn("bbox", geo.box(x, y, x + n % 90 + 5, y + n % 50 + 5)).withColumn("row", (n % 4).cast("int"))


@query(prefix("report") + """, p as (select *, cast(id as bigint) as n from report), q as (select *, n * 37 % 900 as x0, n * 91 % 940 as y0, n * 37 % 900 + n % 90 + 5 as x1, n * 91 % 940 + n % 50 + 5 as y1 from p),
r as (select a.doc, a.artifact, a.id as anchor, t.id as candidate, row_number() over (partition by a.doc, a.artifact, a.id order by greatest(a.x0 - t.x1, t.x0 - a.x1, 0) + greatest(a.y0 - t.y1, t.y0 - a.y1, 0),
 abs(a.x0 + a.x1 - t.x0 - t.x1) + abs(a.y0 + a.y1 - t.y0 - t.y1), t.ord) as rank from q a join q t on a.doc = t.doc and a.artifact = t.artifact and a.type in ('Table', 'Image') and t.type = 'Text')
select doc, artifact, anchor, candidate, rank::int as rank from r where rank <= 3""")
def spatial_knn(spark, sf_dir):
    return windows.nearest_texts(placed(spark, sf_dir))


@query(prefix("report") + WIDE + """, rows as (select doc, artifact, id, cast(id as bigint) % 4 as r from report where type in ('Table', 'Image'))
select doc, artifact, anchor, candidate from wide union select x.doc, x.artifact, y.id, w.candidate from wide w join rows x on x.doc = w.doc and x.artifact = w.artifact and x.id = w.anchor join rows y on y.doc = x.doc and y.artifact = x.artifact and y.r = x.r""")
def row_sibling_union(spark, sf_dir):
    nodes = placed(spark, sf_dir)
    return windows.row_siblings(windows.context_windows(nodes, boundaries=()), nodes)


@query(prefix("report") + NEAR + WIDE + "select doc, artifact, anchor, candidate, ord from wide where candidate not in (select source from caps)")
def candidate_exclusion(spark, sf_dir):
    nodes = report(spark, sf_dir)
    return windows.without_captions(windows.context_windows(nodes, boundaries=()), graph.caption_edges(nodes)).select("doc", "artifact", "anchor", "candidate", "ord")


@query(prefix("report") + WIDE + """, n as (select * from l where k <= 1) select w.doc, w.anchor, count(*)::bigint as n_new from (select * from l where k <= 2) w left join n using (doc, anchor, candidate) where n.k is null group by 1, 2""")
def candidate_growth(spark, sf_dir):
    nodes = report(spark, sf_dir)
    return windows.grown(windows.context_windows(nodes, 1, boundaries=()), windows.context_windows(nodes, 2, boundaries=()))


@query(prefix("report") + r"""select 1 as section, ord::bigint as ord, id, concat('MERGE (n:', type, ' {id: ''', id, '''}) SET n += {ord: ', ord::varchar, case when text is null then '' else concat(', text: ''', replace(replace(replace(text, '\', '\\'), '''', '\'''), chr(10), '\n'), '''') end, '};') as line from report""")
def cypher_nodes(spark, sf_dir):
    return export.cypher_nodes(report(spark, sf_dir), ["ord", "text"])


@query(prefix("report") + "select 2 as section, artifact as source, id as target, concat('MATCH (a {id: ''', artifact, '''}), (b {id: ''', id, '''}) MERGE (a)-[:PARENT_OF {doc: ''', doc, '''}]->(b);') as line from report")
def cypher_edges(spark, sf_dir):
    return export.cypher_edges(graph.parent_edges(report(spark, sf_dir)), ["doc"])


@query(prefix("report") + """select doc, id, concat('{"artifact":"', artifact, '","ord":', ord::varchar, case when text is null then '' else concat(',"text":"', text, '"') end, '}') as props from report""")
def json_props(spark, sf_dir):
    return report(spark, sf_dir).select("doc", "id", export.json_rows(None, ["artifact", "ord", "text"]).alias("props"))


@query(prefix("report") + "select doc, count(*)::bigint as n, min(id) as low from (select doc, id from report where type = 'Text' union all select concat(doc, 'x'), id from report where type <> 'Text') group by doc")
def document_merge(spark, sf_dir):
    nodes = report(spark, sf_dir).select("doc", "id", "type")
    both = graph.merge(nodes.where("type = 'Text'"), nodes.where("type <> 'Text'").withColumn("doc", F.concat("doc", F.lit("x"))))
    return both.groupBy("doc").agg(F.count("*").alias("n"), F.min("id").alias("low"))


@query(prefix("report") + ", s as (select doc, artifact as parent, cast(cast(id as bigint) % 3 as int) as page, count(*) as n, string_agg(id, ',' order by ord) as ids from report group by 1, 2, 3) select doc, parent, page, ids from s where n between 2 and 60")
def sibling_regions(spark, sf_dir):
    nodes = report(spark, sf_dir).withColumn("page", F.expr("cast(cast(id as bigint) % 3 as int)"))
    return enrich.sibling_regions(graph.parent_edges(nodes), nodes).withColumn("ids", F.array_join("ids", ","))


@query(prefix("report") + NEAR + """, ok as (select doc, source, min(target) as target from caps where cast(source as bigint) % 2 = 0 group by 1, 2)
select c.doc, c.source, c.target from caps c where cast(c.source as bigint) % 2 = 1 or exists (select 1 from ok where ok.doc = c.doc and ok.source = c.source and ok.target = c.target)""")
def confirmed_captions(spark, sf_dir):
    edges = graph.caption_edges(report(spark, sf_dir)).select("doc", "type", "source", "target")
    confirmed = edges.where("cast(source as bigint) % 2 = 0").groupBy("doc", "source").agg(F.min("target").alias("target"))
    return enrich.resolved_captions(edges, confirmed).select("doc", "source", "target")


@query(prefix("report") + """, t as (select doc, artifact as g, id, ord, text from report where type = 'Text' and text is not null), k as (select doc, g, min(ord) as o from t group by 1, 2)
select t.doc, arg_min(t.id, t.ord) as id, string_agg(t.text, chr(10) order by t.ord) as text, string_agg(t.id, ',' order by t.ord) as merged_from from t group by t.doc, t.g""")
def merged_texts(spark, sf_dir):
    nodes = placed(spark, sf_dir)
    groups = nodes.where("type = 'Text' and text is not null").select("doc", F.concat("doc", F.lit("/"), "artifact").alias("group"), "id", F.col("ord").alias("place"))
    out, _ = enrich.merged_texts(nodes, graph.parent_edges(nodes), groups)
    return out.where("merged_from is not null").select("doc", "id", "text", F.array_join("merged_from", ",").alias("merged_from"))


GRID = """with g as (select o_custkey as id, list([cast(o_orderkey as string), o_orderstatus, o_orderpriority] order by o_orderkey) as grid from orders group by 1)"""


def grids(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("r"))))
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(rows, lambda x: x["r"]).alias("grid"))


@query(GRID + "select id, concat('T', id::varchar, chr(10), array_to_string(list_transform(grid[1:5], lambda r: array_to_string(r[1:2], ' | ')), chr(10))) as preview from g")
def grid_preview(spark, sf_dir):
    return grids(spark, sf_dir).select("id", tx.grid_preview(F.concat(F.lit("T"), F.col("id").cast("string")), F.col("grid"), 5, 2).alias("preview"))


@query(GRID + ", r as (select id, unnest(grid) as r, unnest(range(len(grid))) as i from g) select id, i::int as r, c::int as c, r[c + 1] as value from r, (select unnest(range(3)) as c)")
def table_grid_cells(spark, sf_dir):
    rows = grids(spark, sf_dir).select("id", F.posexplode("grid").alias("r", "row"))
    return rows.select("id", "r", F.posexplode("row").alias("c", "value"))
