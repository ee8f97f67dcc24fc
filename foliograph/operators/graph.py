"""Scaffold relations of a document graph: containment, order, captions, citations, integrity.

nodes have (doc, artifact, ord, id, type, text); edges have (doc, type, source, target). Every window is
partitioned by the scope, and ties are broken by ord, so that results never depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from ..schema import CONTAINERS, EDGE_TYPES, NODE_TYPES

# Prefixes of captions, and the pattern of a label.
CAPTION_PREFIXES = ("표 ", "그림 ", "Table ", "Figure ", "<표", "<그림", "[표", "[그림")
LABEL = r"(?iu)(표|그림|Table|Figure)\.?\s*(\d+)"


def content_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("type").isin(*CONTAINERS))


def short_name(text: Column, most: int = 40) -> Column:
    """The first 40 code points, and an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def edge(kind: str, source: str | Column, target: str | Column) -> list[Column]:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return [F.lit(kind).alias("type"), as_col(source).alias("source"), as_col(target).alias("target")]


def parent_edges(nodes: DataFrame) -> DataFrame:
    """Every content node under its artifact."""
    return content_nodes(nodes).select("doc", *edge("PARENT_OF", "artifact", "id"))


def next_edges(artifacts: DataFrame) -> DataFrame:
    """Consecutive artifacts of a document, by ord."""
    after = F.lead("id").over(W.partitionBy("doc").orderBy("ord", "id"))
    return artifacts.withColumn("after", after).where("after is not null").select("doc", *edge("NEXT", "id", "after"))


def is_caption(text: Column) -> Column:
    out = F.startswith(text, F.lit(CAPTION_PREFIXES[0]))
    for p in CAPTION_PREFIXES[1:]:
        out = out | F.startswith(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def caption_edges(nodes: DataFrame) -> DataFrame:
    """A caption text is tied to the node before it and the node after it, where these are tables or images.

    edge_ord: the text's ord times 2, plus 1 for the node after.
    """
    w = W.partitionBy("doc", "artifact").orderBy("ord")
    near = content_nodes(nodes)
    for side, f in (("before", F.lag), ("after", F.lead)):
        near = near.withColumn(side, f(F.struct("id", "type")).over(w))
    near = near.where((F.col("type") == "Text") & is_caption(F.col("text")))
    sides = F.array(F.struct(F.col("before").alias("n"), F.lit(0).alias("k")), F.struct(F.col("after").alias("n"), F.lit(1).alias("k")))
    near = near.select("doc", "artifact", "ord", "id", F.explode(sides).alias("s")).where(F.col("s.n.type").isin("Table", "Image"))
    return near.select("doc", "artifact", *edge("CAPTION_OF", "id", F.col("s.n.id")), (F.col("ord") * 2 + F.col("s.k")).alias("edge_ord"))


def label_key(word: Column, number: Column) -> Column:
    """'table:7' or 'figure:7'; the number stays text, so 01 is not 1."""
    return F.concat(F.when(F.lower(word).isin("표", "table"), "table").otherwise("figure"), F.lit(":"), number)


def labels(text: Column) -> Column:
    """The keys of all labels in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(LABEL), F.lit(0))
    return F.transform(found, lambda m: label_key(F.regexp_extract(m, LABEL, 1), F.regexp_extract(m, LABEL, 2)))


def reference_edges(nodes: DataFrame, captions: DataFrame) -> DataFrame:
    """Texts that cite a label, other than captions, refer to the label's anchor: that of the last caption with it."""
    texts = content_nodes(nodes).where("type = 'Text'")
    own = texts.select("doc", "artifact", F.col("id").alias("source"), F.get(labels(F.col("text")), F.lit(0)).alias("label"))
    named = captions.join(own, ["doc", "artifact", "source"]).where("label is not null")
    anchors = named.groupBy("doc", "artifact", "label").agg(F.max_by("target", "edge_ord").alias("anchor"))
    cites = texts.join(captions.select("doc", F.col("source").alias("id")).distinct(), ["doc", "id"], "left_anti")
    cites = cites.select("doc", "artifact", "id", F.explode(F.array_distinct(labels(F.col("text")))).alias("label"))
    return cites.join(anchors, ["doc", "artifact", "label"]).select("doc", *edge("REFERENCES", "id", "anchor")).distinct()


def finalize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the captions and references that aren't there yet; doing it twice adds nothing."""
    captions = cut(caption_edges(nodes))  # read three times below
    new = captions.select("doc", "type", "source", "target").unionByName(reference_edges(nodes, captions))
    return edges.unionByName(new.join(edges, ["doc", "type", "source", "target"], "left_anti"), allowMissingColumns=True)


def with_native_location(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Content nodes with native_artifact and native_page, which later reparenting leaves as they are; those that have them keep them."""
    have = [c for c in ("native_artifact", "native_page") if c in nodes.columns]
    page = F.col("page") if "page" in nodes.columns else F.lit(None).cast("int")
    at = artifact_map(nodes, edges).withColumnRenamed("artifact", "found_")
    out = nodes.join(at, ["doc", "id"], "left")
    content = ~F.col("type").isin(*CONTAINERS)
    old = lambda c: F.col(c) if c in have else F.lit(None)
    return out.select(*[c for c in nodes.columns if c not in have], F.when(content, F.coalesce(old("native_artifact"), "found_")).alias("native_artifact"), F.when(content, F.coalesce(old("native_page"), page)).alias("native_page"))


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the ids (doc, id) that are there."""
    return nodes.join(ids.select("doc", "id").distinct(), ["doc", "id"], "left_semi")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every broken invariant as a row (doc, kind, id, n); none means a sound graph."""
    out = dangling(nodes, edges).select("doc", F.lit("dangling edge").alias("kind"), F.col("end").alias("id"), F.lit(None).cast("long").alias("n"))
    out = out.unionByName(fan_in(edges).select("doc", F.lit("fan-in").alias("kind"), F.col("target").alias("id"), "n"))
    out = out.unionByName(on_cycles(edges).select("doc", F.lit("cycle").alias("kind"), "id", F.lit(None).cast("long").alias("n")))
    return out.unionByName(next_degree(edges).select("doc", F.concat(F.lit("NEXT "), "side").alias("kind"), "id", "n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both documents' rows; identity is (doc, id), so equal file names don't collide."""
    return a.unionByName(b, allowMissingColumns=True)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends without a node: rows (doc, end)."""
    ends = edges.select("doc", F.explode(F.array("source", "target")).alias("end"))
    return ends.join(nodes.select("doc", F.col("id").alias("end")).distinct(), ["doc", "end"], "left_anti").distinct()


def fan_in(edges: DataFrame) -> DataFrame:
    """Nodes with several parents: rows (doc, target, n)."""
    return edges.where("type = 'PARENT_OF'").groupBy("doc", "target").agg(F.count("*").alias("n")).where("n > 1")


def next_degree(edges: DataFrame) -> DataFrame:
    """Nodes with several NEXT edges out of or into them: rows (doc, id, side, n)."""
    out = None
    for side, c in (("out", "source"), ("in", "target")):
        one = edges.where("type = 'NEXT'").groupBy("doc", F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("doc", "id", F.lit(side).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def on_cycles(edges: DataFrame, kind: str = "PARENT_OF") -> DataFrame:
    """Nodes on a cycle of edges of a kind, or below one, whatever their fan-in: rows (doc, id).

    After k doublings a row (id, to) says that a walk of 2**k edges leads up from id to to. Where there are no cycles the rows run
    out once 2**k is the depth; walks as long as a document has edges only exist from a cycle.
    """
    up = edges.where(F.col("type") == kind).select("doc", F.col("target").alias("id"), F.col("source").alias("to")).distinct()
    most = up.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = 1
    while step <= most:
        nxt = up.select("doc", F.col("id").alias("to"), F.col("to").alias("far"))
        up = cut(up.join(nxt, ["doc", "to"]).select("doc", "id", F.col("far").alias("to")).distinct())
        step *= 2
        if up.isEmpty():
            break
    return up.select("doc", "id").distinct()


def artifact_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc, id, artifact): the nearest artifact above a node along PARENT_OF, at any depth.

    Of several parents the last counts, by edge_ord where edges have it, else by id. A node's native_artifact, where nodes have
    that column and it names an artifact, goes before its place in the tree. Nodes that only lead to a cycle have no row.
    """
    last = "edge_ord" if "edge_ord" in edges.columns else "source"
    up = edges.where("type = 'PARENT_OF'").groupBy("doc", F.col("target").alias("id")).agg(F.max_by("source", F.struct(last, "source")).alias("to"))
    tops = nodes.where("type = 'Artifact'").select("doc", F.col("id").alias("to")).distinct()
    up = cut(up.join(tops.withColumn("top", F.lit(True)), ["doc", "to"], "left").select("doc", "id", "to", F.coalesce("top", F.lit(False)).alias("top")))
    most = up.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = 1
    while step <= most and not up.where("not top").isEmpty():
        nxt = up.select("doc", F.col("id").alias("to"), F.col("to").alias("far"), F.col("top").alias("far_top"))
        moved = up.where("not top").join(nxt, ["doc", "to"]).select("doc", "id", F.col("far").alias("to"), F.col("far_top").alias("top"))
        up = cut(up.where("top").unionByName(moved))  # a row whose walk has ended under no artifact goes
        step *= 2
    out = up.where("top").select("doc", "id", F.col("to").alias("artifact"))
    if "native_artifact" in nodes.columns:
        own = nodes.select("doc", "id", F.col("native_artifact").alias("to")).join(tops, ["doc", "to"], "left_semi").select("doc", "id", F.col("to").alias("artifact"))
        out = out.join(own, ["doc", "id"], "left_anti").unionByName(own)
    return out


def type_counts(df: DataFrame, kinds: tuple[str, ...], by: str = "doc") -> DataFrame:
    """Counts by type, zeros included: rows (by, type, n)."""
    every = df.select(by).distinct().withColumn("type", F.explode(F.array(*map(F.lit, kinds))))
    return every.join(df.groupBy(by, "type").agg(F.count("*").alias("n")), [by, "type"], "left").select(by, "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return type_counts(nodes, NODE_TYPES)


def edge_counts(edges: DataFrame) -> DataFrame:
    return type_counts(edges, EDGE_TYPES)


def ambiguous_captions(edges: DataFrame) -> DataFrame:
    """Captions with several targets: rows (doc, source, n)."""
    return edges.where("type = 'CAPTION_OF'").groupBy("doc", "source").agg(F.countDistinct("target").alias("n")).where("n > 1")
