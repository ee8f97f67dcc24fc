"""Relational tables as document graphs, so that every operator has data of any size.

Each adapter is a SQL text over the tables that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (tables it reads, SQL)
ADAPTERS = {
    # Customers as artifacts; their orders as tables, images, captions, citations and list items.
    "report": (
        ("orders",),
        """select cast(o_custkey % 25 as string) as doc, cast(o_custkey as string) as artifact,
 cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as ord, cast(o_orderkey as string) as id,
 case o_orderkey % 5 when 0 then 'Table' when 1 then 'Image' else 'Text' end as type,
 case o_orderkey % 5 when 2 then concat(case when o_orderkey % 2 = 0 then 'Table ' else 'Figure ' end, cast(o_orderkey % 3 + 1 as string), '. ', o_orderpriority)
 when 3 then concat(o_orderpriority, ' as in table ', cast(o_orderkey % 3 + 1 as string), ' and Figure.', cast(o_orderkey % 2 + 1 as string))
 when 4 then concat(cast(o_orderkey % 3 + 1 as string), ') ', o_orderstatus, ' item') end as text from orders""",
    ),
    # Conversations as outlines: system and user turns are headings of two levels, some excluded, some barriers.
    "outline": (
        ("conversations",),
        """select cast(conv_id % 10 as string) as doc, cast(conv_id as string) as artifact, cast(turn as int) as ord,
 case when (conv_id + turn) % 11 = 5 and role = 'user' then null else concat(cast(conv_id as string), '-', cast(turn as string)) end as id,
 case role when 'system' then 0 when 'user' then cast(1 + turn % 3 as int) end as level, turn % 7 = 6 as excluded from conversations""",
    ),
    # Parts as numbered headings of three levels, and body.
    "numbered": (
        ("part",),
        """select '1' as doc, cast(cast(floor(p_partkey / 40) as int) as string) as artifact, cast(row_number() over (partition by floor(p_partkey / 40) order by p_partkey) as int) as ord,
 cast(p_partkey as string) as id, 'Text' as type, p_size % 9 = 8 as is_toc, cast(p_partkey % 2 as string) as parent,
 case p_size % 5 when 0 then concat(cast(cast(floor(p_partkey % 40 / 14) as int) + 1 as string), ' Title') when 1 then concat(cast(cast(floor(p_partkey % 40 / 14) as int) + 1 as string), '.', cast(p_size % 3 + 1 as string), ' Title')
 when 2 then concat(cast(cast(floor(p_partkey % 40 / 14) as int) + 1 as string), '.', cast(p_size % 3 + 1 as string), '.', cast(p_size % 2 + 1 as string), ' Title')
 when 3 then concat('<', p_brand, '>') else p_name end as text from part""",
    ),
    # Events as boxes on pages.
    "boxes": (
        ("events",),
        """select cast(floor(event_id / 60) as int) as page, event_id as id, cast(event_id as int) as ord,
 cast(event_id * 37 % 600 as int) as x0, cast(event_id * 91 % 700 as int) as y0, cast(event_id * 37 % 600 + event_id % 90 + 5 as int) as x1, cast(event_id * 91 % 700 + event_id % 50 + 5 as int) as y1 from events""",
    ),
    # Line items as cells of sheets: 200 orders a sheet, each a row, with gaps after some rows and columns.
    "sheet": (
        ("lineitem",),
        """select cast(floor(l_orderkey / 200) as int) as sheet, cast(l_orderkey % 200 * 2 + case when l_orderkey % 3 = 0 then 1 else 0 end as int) as row,
 cast(l_linenumber + floor(l_linenumber / 3) as int) as col, cast(min(l_partkey) as string) as value from lineitem group by 1, 2, 3""",
    ),
    # Documents' lines as texts.
    "lines": (("documents",), "select doc_id, source, text from documents where text is not null"),
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = ADAPTERS[name]
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def prefix(*names: str) -> str:
    """The adapters as common table expressions."""
    return "with " + ",\n".join(f"{n} as ({ADAPTERS[n][1]})" for n in names)
