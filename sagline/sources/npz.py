"""Ingest of array archives (.npz): ground points and points per wire.

Each task reads its share of rows of every array. Arrays stored uncompressed are read by seeking;
compressed ones are skipped through in small pieces. Nothing holds a whole array.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.utils import AnalysisException

from sagline.sources.files import SPLIT_BYTES, FilePart, list_parts, open_file

SCHEMA = "file string, key string, pos int, point_id long, x double, y double, z double"
ARROW = pa.schema([("file", pa.string()), ("key", pa.string()), ("pos", pa.int32()), ("point_id", pa.int64()),
                   ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
BATCH_ROWS = 65_536
GROUND_KEY = "ground_points"


def array_header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if kind.hasobject:
        raise ValueError("object arrays are not supported")
    if len(shape) != 2 or shape[1] != 3:
        raise ValueError(f"expected an n x 3 array, found shape {shape}")
    return shape, fortran, kind


def _skip(f, count: int) -> None:
    while count > 0:
        count -= len(f.read(min(count, 1 << 20))) or count


class NpzReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[FilePart]:
        return list_parts(self.path, ".npz", self.split_bytes)

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        with open_file(part.path) as raw, zipfile.ZipFile(raw) as archive:
            for pos, entry in enumerate(archive.infolist()):
                yield from self._array(archive, entry, part, pos)

    @staticmethod
    def _array(archive: zipfile.ZipFile, entry: zipfile.ZipInfo, part: FilePart, pos: int) -> Iterator[pa.RecordBatch]:
        key = entry.filename[:-4] if entry.filename.endswith(".npy") else entry.filename
        stored = entry.compress_type == zipfile.ZIP_STORED
        with archive.open(entry) as f:
            (total, _), fortran, kind = array_header(f)
            row, stop = part.rows(total)
            start, size = f.tell(), kind.itemsize

            def take(at: int, n: int) -> np.ndarray:
                """``n`` values from value index ``at`` on; calls go forward within one stream."""
                if stored:
                    f.seek(start + at * size)
                else:
                    _skip(f, start + at * size - f.tell())
                return np.frombuffer(f.read(n * size), kind)

            if fortran and not stored:
                # Three columns one after the other in a stream that only goes forward.
                with archive.open(entry) as g, archive.open(entry) as h:
                    streams = [f, g, h]
                    for c, s in enumerate(streams):
                        _skip(s, start + (c * total + row) * size - s.tell())
                    while row < stop:
                        n = min(BATCH_ROWS, stop - row)
                        yield _batch(part, key, pos, row, [np.frombuffer(s.read(n * size), kind) for s in streams])
                        row += n
                return
            while row < stop:
                n = min(BATCH_ROWS, stop - row)
                cols = [take(c * total + row, n) for c in range(3)] if fortran else take(3 * row, 3 * n).reshape(n, 3).T
                yield _batch(part, key, pos, row, cols)
                row += n


def _batch(part: FilePart, key: str, pos: int, row: int, cols) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays(
        [pa.array([part.name] * n), pa.array([key] * n), pa.array(np.full(n, pos, "int32")),
         pa.array(np.arange(row, row + n)), *[pa.array(np.ascontiguousarray(c, dtype="float64")) for c in cols]], schema=ARROW)


class NpzSource(DataSource):
    """``spark.read.format("sagline_npz").load(path)``; option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sagline_npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_arrays(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, key, pos, point_id, x, y, z``: rows of every n x 3 array of the archives."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("sagline_npz").option("splitBytes", split_bytes).load(path)


def ground_keys(arrays: DataFrame, by: str = "file") -> DataFrame:
    """``by, key``: of each archive's arrays (``by, key, pos``) the one named for ground, else the first."""
    return arrays.groupBy(by).agg(F.min_by("key", F.struct((F.col("key") != GROUND_KEY).cast("int"), "pos")).alias("key"))


def read_ground(spark: SparkSession, path: str, fmt: str = "npz", cloud_id: str | None = None) -> DataFrame | None:
    """Ground points ``cloud_id, point_id, x, y, z``; None when the source cannot be read.

    From an archive, the array ``ground_points``, or the first one if there is none of that name.
    """
    try:
        if fmt == "parquet":
            schema = "cloud_id string, point_id long, x double, y double, z double"
            return spark.read.schema(schema).parquet(path).select("cloud_id", "point_id", "x", "y", "z")
        rows = read_arrays(spark, path)
        names = ground_keys(rows)
        rows = rows.join(F.broadcast(names) if names.limit(10_001).count() <= 10_000 else names, ["file", "key"])
    except (FileNotFoundError, AnalysisException):
        return None
    cloud = F.col("file") if cloud_id is None else F.lit(cloud_id)
    return rows.select(cloud.alias("cloud_id"), "point_id", "x", "y", "z")


def numeric_suffix(key="key"):
    """Integer after the first underscore: the order of ``<prefix>_<int>`` names."""
    return F.split(key, "_")[1].cast("int")


def number_wires(wires: DataFrame) -> DataFrame:
    """Add ``wire_id`` and ``label`` to ``cloud_id, key, count``: from 0 by the numeric suffix, so ``w_10`` follows ``w_9``."""
    order = Window.partitionBy("cloud_id").orderBy(numeric_suffix(), "key")
    wires = wires.withColumn("wire_id", (F.row_number().over(order) - 1).cast("int"))
    return wires.select("cloud_id", "wire_id", "key", F.col("wire_id").alias("label"), "count")


def read_wires(spark: SparkSession, path: str, cloud_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, wires): ``cloud_id, wire_id, point_id, x, y, z`` and ``cloud_id, wire_id, key, label, count``.

    Wires are numbered from 0 by the numeric suffix of their key, so ``w_10`` follows ``w_9``.
    """
    cloud = F.col("file") if cloud_id is None else F.lit(cloud_id)
    rows = read_arrays(spark, path).select(cloud.alias("cloud_id"), "key", "point_id", "x", "y", "z")
    wires = number_wires(rows.groupBy("cloud_id", "key").agg(F.count(F.lit(1)).alias("count")))
    points = rows.join(wires.select("cloud_id", "wire_id", "key"), ["cloud_id", "key"])
    return points.select("cloud_id", "wire_id", "point_id", "x", "y", "z"), wires
