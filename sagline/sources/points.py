"""Point tables in Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline.schema import POINTS


def base_name(path: Column) -> Column:
    """File name without its folder, used as ``cloud_id``."""
    return F.element_at(F.split(path, "/"), -1)


def by_cloud(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet, one folder per cloud; only the folders of its own clouds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cloud_id").parquet(path)


def as_points(df: DataFrame, x="x", y="y", z="z", point_id="point_id", classification="classification",
              cloud_id=None) -> DataFrame:
    """Any table as points. Arguments are columns or names; a missing class is 0.

    ``cloud_id`` may be NULL-valued, a column, or left out when the table has its own.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    cloud = F.col("cloud_id") if cloud_id is None else col(cloud_id)
    if isinstance(classification, str) and classification not in df.columns:
        code = F.lit(0)
    else:
        code = F.coalesce(col(classification), F.lit(0))
    cols = (cloud, col(point_id), col(x), col(y), col(z), code)
    return df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, POINTS)])


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", **columns) -> DataFrame:
    """Read a folder or file of points.

    CSV files without a ``cloud_id`` column are clouds of their own, named by their file; equal names in different
    folders are an error. A Parquet table is written in parts that are no clouds: without the column, ``cloud_id``
    must be given.
    CSV files have a header and the columns of :data:`sagline.schema.POINTS` by name.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f.dataType.simpleString() for f in POINTS}
        schema = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)
        df = spark.read.option("header", True).schema(schema).csv(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'; LAS files are read with read_las")
    if "cloud_id" not in columns and "cloud_id" not in df.columns:
        if fmt == "parquet":
            raise ValueError("the table has no cloud_id; give one, such as cloud_id=F.lit('flight')")
        names = [f.rpartition("/")[2] for f in df.inputFiles()]
        if len(set(names)) < len(names):
            raise ValueError("files of the same name in different folders; give a cloud_id")
        columns["cloud_id"] = base_name(F.input_file_name())
    return as_points(df, **columns)
