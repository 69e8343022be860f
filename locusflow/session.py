"""Session set-up, shared scratch space and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Largest row count and size (estimated from the values) that may be shipped to every executor as a broadcast table.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def build_session(app: str = "locusflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` entries use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A private temporary folder is used only on a local master, where driver and executors are one
    process; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="locusflow-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path under :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back, so that iterative jobs neither grow their plan nor lose
    executor state. A reliable checkpoint would run its last stage twice."""
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(df: DataFrame) -> Column:
    """Size of a row: text and array lengths, eight bytes for anything else."""
    total = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map")):
            total = total + 32 * F.greatest(F.size(c), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after counting rows and bytes; a bigger table keeps the shuffled join."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_bytes_of(df))).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def broadcast_if_rows(df: DataFrame, rows: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for a table whose row count is already known."""
    return F.broadcast(df) if rows <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_locusflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="locusflow-pkg-"), "locusflow")
    sc.addPyFile(shutil.make_archive(base, "zip", root_dir=root, base_dir="locusflow"))
    sc._locusflow_shipped = True


def one_value(df: DataFrame) -> Column:
    """A one-row, one-column DataFrame as a scalar subquery."""
    return df.scalar()
