"""Ingest of uncompressed LAS point files, split by record ranges.

Records have a fixed length, so a task seeks to its own range of a file and decodes it to Arrow
batches. The layout is that of the public LAS specification, versions 1.0 to 1.4.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from sagline.sources.files import SPLIT_BYTES, FilePart, list_parts, open_file
from sagline.sources.points import by_cloud

SCHEMA = "cloud_id string, point_id long, x double, y double, z double, classification int"
ARROW = pa.schema([("cloud_id", pa.string()), ("point_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()),
                   ("z", pa.float64()), ("classification", pa.int32())])
BATCH_ROWS = 65_536
# Fixed values of the LAS header: size, offsets of its fields.
HEADER_BYTES = 375
POINTS_AT, FORMAT_AT, LENGTH_AT, COUNT_AT, SCALE_AT, OFFSET_AT, COUNT64_AT = 96, 104, 105, 107, 131, 155, 247


def read_header(raw: bytes) -> dict:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    code = raw[FORMAT_AT]
    if code & 0xC0:
        raise ValueError("compressed point records are not supported; decompress the file first")
    minor = raw[25]
    count, = struct.unpack_from("<I", raw, COUNT_AT)
    if minor >= 4 and len(raw) >= COUNT64_AT + 8:
        count = struct.unpack_from("<Q", raw, COUNT64_AT)[0] or count
    return {"format": code, "start": struct.unpack_from("<I", raw, POINTS_AT)[0],
            "length": struct.unpack_from("<H", raw, LENGTH_AT)[0], "count": count,
            "scale": struct.unpack_from("<3d", raw, SCALE_AT), "offset": struct.unpack_from("<3d", raw, OFFSET_AT)}


def record_type(code: int, length: int) -> np.dtype:
    """Coordinates and class of a record; the class moved to byte 16 with format 6."""
    return np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"],
                     "offsets": [0, 4, 8, 15 if code < 6 else 16], "itemsize": length})


class LasReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[FilePart]:
        return list_parts(self.path, ".las", self.split_bytes)

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        with open_file(part.path) as f:
            head = read_header(f.read(HEADER_BYTES))
            kind = record_type(head["format"], head["length"])
            name = part.name
            row, stop = part.rows(head["count"])
            f.seek(head["start"] + row * head["length"])
            while row < stop:
                n = min(BATCH_ROWS, stop - row)
                raw = np.frombuffer(f.read(n * head["length"]), kind)
                if len(raw) < n:
                    raise ValueError(f"{part.path}: file ends before its last record")
                xyz = [raw[a] * s + o for a, s, o in zip("xyz", head["scale"], head["offset"])]
                code = (raw["c"] & 0x1F if head["format"] < 6 else raw["c"]).astype("int32")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(row, row + n)), *map(pa.array, xyz), pa.array(code)], schema=ARROW)
                row += n


class LasSource(DataSource):
    """``spark.read.format("sagline_las").load(path)``; option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sagline_las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LasReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_las(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of a LAS file or of all LAS files below a folder, one cloud per file, named by its path below the folder."""
    spark.dataSource.register(LasSource)
    return spark.read.format("sagline_las").option("splitBytes", split_bytes).load(path)


def ingest_las(spark: SparkSession, path: str, out: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write LAS points to Parquet, one folder per cloud, and read them back. Clouds that are not in ``path`` stay as they are."""
    by_cloud(read_las(spark, path, split_bytes), out)
    return spark.read.schema(SCHEMA).parquet(out)
