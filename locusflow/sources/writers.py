"""Writers. Directory writes stay parallel; a single file is made only on request."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_decimal_comma, vector_text


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> str:
    out = df if files is None else df.coalesce(files)
    out.write.mode(mode).parquet(path)
    return path


def flat_for_text(df: DataFrame) -> DataFrame:
    """Vectors and arrays as ``"[a,b,..]"`` text, as delimited files hold no nested values."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, VectorUDT):
            c = vector_text(vector_to_array(c))
        elif field.dataType.typeName() == "array":
            c = vector_text(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists", files: int | None = None, sep: str = ",") -> str:
    """Directory of delimited files. ``files=1`` gives one part, for results known to be small."""
    out = flat_for_text(df)
    out = out if files is None else out.coalesce(files)
    out.write.mode(mode).option("header", header).option("sep", sep).option("escape", '"').csv(path)
    return path


def decimal_comma(df: DataFrame) -> DataFrame:
    """Floating-point columns as text with a decimal comma."""
    return df.select(
        *[
            to_decimal_comma(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_csv2(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """``;`` separated with decimal commas."""
    return write_csv(decimal_comma(df), path, mode=mode, sep=";")


def grid_path(base: str, *parameters: object) -> str:
    """Output name of one grid point."""
    return "_".join([base, *[str(p) for p in parameters]]) + ".csv"


def write_single_file(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> str:
    """One delimited file at ``path``: written as one part next to it, then renamed.

    Meant for reports; all rows pass through one task.
    """
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}.tmp"
    write_csv(df, folder, header=header, files=1, sep=sep)
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(folder)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"could not move the result to {path}")
    fs.delete(source, True)
    return path
