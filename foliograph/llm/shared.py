"""What the operators share: reading tables, cutting lineage, checked broadcasts, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and holds at most this much; beyond, a shuffled join.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a local session, which has one machine, gets a temporary folder; on a cluster it is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="foliograph-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


_MADE: list[list[str]] = []


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables written meanwhile, for ``dropped`` once nothing reads them any more."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder, by the file system that holds them."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    for made in _MADE:
        made.append(path)
    return path


def free(taken: list[str], name: str) -> str:
    """name, or name with as many underscores as make it unlike the names taken."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def with_own_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs, rows (doc_id, given) or None): a doc_id of its own for each different text, in the order of the ids given.

    Where no doc_id repeats, docs as they are, and None. Else ids are dealt anew, ascending by (doc_id, hash of the text), and
    equal rows share one; a null doc_id stays null.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, None
    text, given = F.xxhash64("text"), free(docs.columns, "given")
    h = free([*docs.columns, given], "text_hash")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias(given), text.alias(h)).distinct()
    ids = written(ids.repartitionByRange(given, h).sortWithinPartitions(given, h).withColumn("own", F.monotonically_increasing_id()), "ids")
    own = free([*docs.columns, given, h], "own")
    keyed = docs.withColumnRenamed("doc_id", given).withColumn(h, text)
    out = keyed.join(ids.withColumnRenamed("own", own), [given, h], "left")
    kept = [F.col(own).alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept), ids.select(F.col("own").alias("doc_id"), F.col(given).alias("given"))


def with_given_ids(out: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    """out with the given ids again in doc_id and other columns of ids."""
    for c in ("doc_id", *columns) if ids is not None else ():
        names = out.columns
        back = ids.select(F.col("doc_id").alias("own_"), F.col("given").alias("given_"))
        out = out.join(back, F.col(c) == F.col("own_"), "left").select(*[F.col("given_").alias(n) if n == c else F.col(f"`{n}`") for n in names])
    return out


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, which outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """Batches for Python of at most n rows, where a row holds several texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def sized(small: DataFrame, row_bytes: int, count: int | None = None) -> DataFrame:
    """small with a broadcast hint if its counted rows are few enough; else as it is, for a shuffled join."""
    n = small.count() if count is None else count
    return F.broadcast(small) if n * row_bytes <= BROADCAST_BYTES else small


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component) with the least id that can be reached.

    Alternating large-star and small-star steps: each node's neighbours are tied to the least of them,
    which flattens every component to a star in a logarithmic number of rounds. Each round is a few
    shuffles of what is left of the edges and ends in a written table.
    """
    e = edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
        e = written(small.select("x.*").where("u <> v").distinct(), "star")
        # A round that changes nothing is a star in every component; a sum of hashes tells.
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
