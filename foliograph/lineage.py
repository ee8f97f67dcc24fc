"""Cutting the plan of a loop: a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df as a written table under spark.checkpoint.dir; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="foliograph-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        at = _OWN[0]
    path = f"{at.rstrip('/')}/loop-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
