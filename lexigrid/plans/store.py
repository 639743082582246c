"""Tables between steps, and joins against vocabularies of unknown size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows need at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexigrid-')}"
        sc.setCheckpointDir(base)
    if base.startswith("/") and sc.master.startswith("local"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: it isn't computed twice, and a lost executor takes nothing with it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, split: int = 4 << 20) -> DataFrame:
    """``df``, a table read from files, dealt to all cores if its files are too small to be split over them; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * split else df


def listed(df: DataFrame, name: str, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> list | None:
    """The values of a column if the counted rows fit a broadcast, else None."""
    most = limit // row_bytes
    rows = df.select(name).limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def sized(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit; otherwise Spark shuffles both sides of a join.

    Counting runs ``df``: it should be materialized, or cheap.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
