"""Wire fits as JSON, and Parquet sinks for wires and ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline.sources.points import base_name, by_cloud

RECORD = ("p array<double>, normr double, df double, rsq double, mu_mean double, mu_std double, mu array<double>")


def normalise_fits(df: DataFrame) -> DataFrame:
    """One shape for records with ``mu`` and records with ``mu_mean, mu_std``."""
    has = F.col("mu_mean").isNotNull() & F.col("mu_std").isNotNull()
    return df.select(*[c for c in df.columns if c == "cloud_id"], "wire_id", "p", "normr", "df", "rsq",
                     F.when(has, F.col("mu_mean")).otherwise(F.get("mu", F.lit(0))).alias("mu_mean"),
                     F.when(has, F.col("mu_std")).otherwise(F.get("mu", F.lit(1))).alias("mu_std"))


def fit_records(text: Column) -> Column:
    """The records of a JSON array of fits; text that is not such JSON is an error."""
    return F.from_json(text, f"array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})


def read_wire_info(spark: SparkSession, path: str, fmt: str = "array", cloud_id: str | None = None) -> DataFrame:
    """``[cloud_id,] wire_id, p, normr, df, rsq, mu_mean, mu_std``.

    ``array``: a JSON array per file, where a record's position is its wire; several files are clouds of their own,
    named by their folder ``cloud_id=...`` or else their file without its ending. ``lines``: one record per line
    with its ``wire_id``, and ``cloud_id`` where it has one, as :func:`write_wire_info` leaves them; such files are
    split. ``cloud_id`` names the cloud of a single file. Text that is not such JSON is an error.
    """
    named = [] if cloud_id is None else [F.lit(cloud_id).alias("cloud_id")]
    if fmt == "lines":
        rows = spark.read.option("mode", "FAILFAST").schema(f"cloud_id string, wire_id int, {RECORD}").json(path)
        if named or not rows.where("cloud_id IS NOT NULL").take(1):
            rows = rows.select(*named, *[c for c in rows.columns if c != "cloud_id"])
        return normalise_fits(rows)
    if fmt != "array":
        raise ValueError("fmt must be 'array' or 'lines'")
    records = fit_records(F.col("value"))
    text = spark.read.schema("value string").text(path, wholetext=True)
    file = F.input_file_name()
    if not named and len(text.inputFiles()) > 1:
        folder = F.regexp_extract(file, "/cloud_id=([^/]+)/", 1)
        named = [F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_replace(base_name(file), "[.][^.]*$", "")).alias("cloud_id")]
    rows = text.select(*named, records.alias("r"))
    return normalise_fits(rows.select(*[c for c in rows.columns if c == "cloud_id"], F.posexplode("r").alias("wire_id", "r")).select(
        *["cloud_id"] * bool(named), "wire_id", "r.*"))


def write_wire_info(fits: DataFrame, path: str) -> None:
    """One JSON record per wire, with its ``wire_id``."""
    keys = [c for c in ("cloud_id", "wire_id") if c in fits.columns]
    fits.select(*keys, "p", "normr", "df", "rsq", "mu_mean", "mu_std").write.mode("overwrite").json(path)


def write_wire_arrays(fits: DataFrame, path: str) -> None:
    """One JSON array per cloud, wires in order, in a folder ``cloud_id=...`` each: the form that :func:`read_wire_info` takes
    as ``array``. A cloud's wires, some hundreds, are one array; they must be numbered from 0 without gaps."""
    record = F.struct("p", "normr", "df", "rsq", "mu_mean", "mu_std")
    whole = fits.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("wire_id", record.alias("r")))).alias("w"))
    even = F.raise_error(F.lit("wires are not numbered from 0 without gaps"))
    ok = F.forall(F.transform("w", lambda x, i: x.wire_id == i), lambda b: b)
    text = whole.select("cloud_id", F.when(ok, F.to_json(F.col("w.r"))).otherwise(even).alias("value"))
    text.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cloud_id").text(path)


def write_ground(ground: DataFrame, path: str) -> None:
    """Ground points as Parquet, one folder per cloud."""
    by_cloud(ground.select("cloud_id", "point_id", "x", "y", "z"), path)


def write_wires(points: DataFrame, path: str) -> None:
    """Points of wires as Parquet, one folder per cloud."""
    by_cloud(points.select("cloud_id", "wire_id", "point_id", "x", "y", "z"), path)
