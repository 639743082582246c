"""Where intermediate tables go, and joins against id lists of unknown size."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows need at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may lack the setting; it then gets one of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexigrid-')}"
        sc.setCheckpointDir(base)
    # The file system is part of the path from here on: to other readers a bare path is local, to Spark it may not be.
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"{base.rstrip('/')}/lexigrid-{uuid.uuid4().hex}-{name}"


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes within are deleted at the end, but for those it is told to keep."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: later readers recompute nothing, and a lost executor takes nothing with it.

    Within ``scratch`` the table is deleted at the scope's end; with ``keep``
    it belongs to the scope around, or to the caller.
    """
    path = shared_dir(df.sparkSession, name)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows were counted to fit; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def only(docs: DataFrame, ids: DataFrame, key: str, row_bytes: int = 48) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids`` (a materialized one-column table)."""
    return docs.join(sized(ids, row_bytes), key, "left_semi")


def without(docs: DataFrame, ids: DataFrame, key: str, row_bytes: int = 48) -> DataFrame:
    """Rows of ``docs`` whose key isn't in ``ids``; rows with a null key stay."""
    return docs.join(sized(ids, row_bytes), key, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
