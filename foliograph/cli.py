"""python -m foliograph.cli PATH --format json|cypher -o OUT [--check]: files to a graph, by Spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .operators import export, graph, headings
from .sources import office, pdf


def build(spark: SparkSession, path: str):
    """(nodes, edges) of all files under a path: outline hierarchy, numbered nesting, captions, references, bookmarks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    is_pdf = F.lower("path").endswith(".pdf")
    raw, printed = cut(office.parsed(files.where(~is_pdf))), cut(pdf.parsed(files.where(is_pdf)))  # each file is read once
    nodes = cut(office.nodes_of(raw).unionByName(office.sheet_nodes(raw), allowMissingColumns=True))
    tree = headings.hierarchy(nodes.withColumn("excluded", F.col("is_toc")))
    nested = headings.numbered_nesting(nodes).withColumnRenamed("parent", "nested_")
    tree = tree.join(nested, ["doc", "id"], "left").withColumn("source", F.when(~F.col("structural"), F.coalesce("nested_", "parent")).otherwise(F.col("parent")))
    edges = tree.select("doc", F.lit("PARENT_OF").alias("type"), "source", F.col("id").alias("target"))
    leaves, boxes = cut(pdf.nodes_of(printed)), pdf.containers(printed)
    edges = edges.unionByName(pdf.tree(printed, leaves))
    nodes = nodes.unionByName(leaves.drop("image"), allowMissingColumns=True)
    tops, links = office.containers(raw)
    tops, links = tops.unionByName(boxes[0]), links.unionByName(boxes[1])
    edges = cut(graph.finalize(nodes, cut(edges)).unionByName(office.bookmark_references(nodes)).unionByName(links).distinct())
    return cut(graph.with_native_location(nodes.unionByName(tops, allowMissingColumns=True), edges)), edges


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliograph")
    p.add_argument("path")
    p.add_argument("--format", choices=("json", "cypher"), default="json")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--check", action="store_true", help="report integrity problems on stderr")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("foliograph").getOrCreate()
    nodes, edges = build(spark, args.path)
    if args.format == "json":
        nodes.drop("bookmarks", "links").write.mode("overwrite").json(f"{args.output}/nodes")
        edges.write.mode("overwrite").json(f"{args.output}/edges")
    else:
        lines = export.cypher_constraints(spark).unionByName(export.cypher_nodes(nodes, ["ord", "text"]).drop("id"))
        lines = lines.unionByName(export.cypher_edges(edges, ["doc"]).select("section", F.lit(0).cast("long").alias("ord"), "line"))
        export.write_cypher(lines, args.output)
    if args.check:
        for r in graph.problems(nodes, edges).limit(100).toLocalIterator():
            print(r.asDict(), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
