"""Exports: Cypher statements and JSON, one row for each node or edge, ordered by section and ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("File", "Artifact", "Text", "Table", "Image", "Group")


def quoted(text: Column) -> Column:
    """A Cypher string: backslash, quote and newline are escaped."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("'"))


def literal(c: Column, kind: str) -> Column:
    if kind == "string":
        return quoted(c)
    if kind.startswith("array<string"):
        return F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]"))
    if kind.startswith(("array", "struct", "map")):
        return quoted(F.to_json(c))
    return c.cast("string")


def properties(df: DataFrame, names: list[str]) -> Column:
    """' {k: v, …}' of the columns that aren't null; nothing without any."""
    types = dict(df.dtypes)
    parts = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), literal(F.col(n), types[n]))) for n in names]))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" {"), F.array_join(parts, ", "), F.lit("}"))).otherwise("")


def cypher_constraints(spark) -> DataFrame:
    return spark.createDataFrame([(0, i, f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{x}) REQUIRE n.id IS UNIQUE;") for i, x in enumerate(LABELS)], "section int, ord long, line string")


def cypher_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    line = F.concat(F.lit("MERGE (n:"), "type", F.lit(" {id: "), quoted(F.col("id")), F.lit("}) SET n +="), properties(nodes, names), F.lit(";"))
    return nodes.select(F.lit(1).alias("section"), F.col("ord").cast("long").alias("ord"), "id", line.alias("line"))


def cypher_edges(edges: DataFrame, names: list[str]) -> DataFrame:
    line = F.concat(F.lit("MATCH (a {id: "), quoted(F.col("source")), F.lit("}), (b {id: "), quoted(F.col("target")), F.lit("}) MERGE (a)-[:"), F.col("type"), properties(edges, names), F.lit("]->(b);"))
    return edges.select(F.lit(2).alias("section"), "source", "target", line.alias("line"))


def write_cypher(lines: DataFrame, path: str) -> None:
    """A script in order, as text files of consecutive parts; range partitions keep the order without one task for all."""
    lines.repartitionByRange("section", "ord").sortWithinPartitions("section", "ord").select("line").write.text(path)


def json_rows(df: DataFrame, names: list[str]) -> Column:
    return F.to_json(F.struct(*names))
