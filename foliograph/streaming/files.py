"""Graphs of files as they arrive. A file's graph needs nothing of other files, so each micro-batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..sources import office


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends nodes and edges of new files under source to target/nodes and target/edges, once each.

    A batch is written under its own number and overwritten if it is run again after a failure.
    """

    def batch(raw: DataFrame, number: int) -> None:
        raw = raw.persist()
        nodes = office.nodes_of(raw)
        edges = graph.finalize(nodes, graph.parent_edges(nodes)).unionByName(office.bookmark_references(nodes)).distinct()
        nodes.write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        edges.write.mode("overwrite").parquet(f"{target}/edges/batch={number}")
        raw.unpersist()

    raw = office.read_files(spark, source, stream=True)
    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
