"""What judges were asked and what came of it, as tables of a run; and the way of a graph into a graph database."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .export import LABELS

PUSH_ROWS = 500


class Trace:
    """A run's folder: before and after (nodes, edges), calls and outcomes. A table that can't be written is left out and breaks nothing."""

    def __init__(self, directory: str):
        self.path = f"{directory.rstrip('/')}/run-{uuid.uuid4().hex}"
        self.failed: list[str] = []

    def save(self, name: str, rows: DataFrame) -> None:
        try:
            rows.write.json(f"{self.path}/{name}")
        except Exception as e:  # of any file system
            self.failed.append(f"{name}: {type(e).__name__}")

    def calls(self, rows: DataFrame) -> None:
        """Calls with the candidates of each anchor; of an error only its kind is kept, as its text may hold secrets."""
        ids = F.transform(F.from_json(F.coalesce(F.get_json_object("question", "$.members"), F.get_json_object("question", "$.candidates")), "array<struct<id:string>>"), lambda m: m["id"])
        self.save("calls", rows.withColumn("candidate_ids", ids).withColumnRenamed("key", "anchor_id"))


@contextmanager
def trace(directory: str, nodes: DataFrame, edges: DataFrame) -> Iterator[Trace]:
    """Writes the graph before; the caller saves what it is afterwards."""
    t = Trace(directory)
    t.save("before/nodes", nodes)
    t.save("before/edges", edges)
    yield t


def push(nodes: DataFrame, edges: DataFrame, connect: Callable, names: tuple[str, ...] = (), batch: int = PUSH_ROWS) -> None:
    """Merge a graph into a database that speaks Cypher, from all tasks, ``batch`` rows a statement; doing it twice adds nothing.

    connect: a function that opens a session with run(statement, rows=...) and close(); it runs on the executors. Nodes go before edges.
    """
    types = {n: t for n, t in nodes.dtypes if n in names}
    plain = [F.to_json(F.col(n)).alias(n) if t.startswith(("struct", "map", "array<array", "array<struct")) else F.col(n) for n, t in types.items()]

    def sender(statement: Callable[[str], str]) -> Callable:
        def send(rows: Iterator) -> None:
            session, waiting = connect(), {}
            try:
                for r in rows:
                    own = waiting.setdefault(r["type"], [])
                    own.append({k: (json.loads(v) if k == "props" else v) for k, v in r.asDict().items() if k != "type"})
                    if len(own) >= batch:
                        session.run(statement(r["type"]), rows=own)
                        waiting[r["type"]] = []
                for kind, own in waiting.items():
                    if own:
                        session.run(statement(kind), rows=own)
            finally:
                session.close()

        return send

    session = connect()
    try:
        for label in LABELS:
            session.run(f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{label}) REQUIRE n.id IS UNIQUE")
    finally:
        session.close()
    rows = nodes.where(F.col("type").isin(*LABELS)).select("type", "id", F.to_json(F.struct(*plain) if plain else F.struct("id")).alias("props"))
    rows.foreachPartition(sender(lambda kind: f"UNWIND $rows AS r MERGE (n:{kind} {{id: r.id}}) SET n += r.props"))
    links = edges.where(F.col("type").rlike("^[A-Z_]+$")).select("type", "source", "target")
    links.foreachPartition(sender(lambda kind: f"UNWIND $rows AS r MATCH (a {{id: r.source}}), (b {{id: r.target}}) MERGE (a)-[:{kind}]->(b)"))


def bolt(uri: str, auth: tuple[str, str], database: str | None = None) -> Callable:
    """connect() for ``push`` by the database's own driver, which is only needed here."""

    class Session:
        def __init__(self):
            from neo4j import GraphDatabase

            self.driver = GraphDatabase.driver(uri, auth=auth)
            self.session = self.driver.session(database=database)

        def run(self, statement: str, **values) -> None:
            self.session.run(statement, **values).consume()

        def close(self) -> None:
            self.session.close()
            self.driver.close()

    return Session
