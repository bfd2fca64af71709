"""Sharding along a Hilbert curve over document metadata.

Source, language and size are quantised to a grid, every document gets the position of its cell on the
Hilbert curve, and the curve is cut into runs. Neighbours on the curve are neighbours in all dimensions at
once, so every run covers a small box, and a filter on any dimension skips most shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sagline.llm.shared import stored

BITS = 10


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (n x d, each below ``2**bits``).

    The coordinates are turned to transposed form by undoing the excess rotations from the top bit down,
    then Gray-decoded and interleaved.
    """
    x = np.array(cells, dtype=np.int64, copy=True).T
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(curve_index(np.column_stack([a, b, c])))


def _named(column: Column) -> Column:
    """A grid coordinate for a name: equal names share one, null is 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(1 + F.crc32(column) % ((1 << BITS) - 1)).cast("long")


def _sized(size: Column) -> Column:
    """A grid coordinate for a size, 24 steps for each doubling."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(24 * F.log2(1.0 + size))).cast("long")


def curve_order(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang",
                carry: bool = False) -> DataFrame:
    """``_id, _size, _crc, _curve``, and the whole row as ``doc`` with ``carry``.

    Size is the text's UTF-8 bytes (null: none) plus 16; the checksum of a null text is that of the empty one.
    """
    own = [F.col(key).alias("_id"), *[F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] * carry]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    return docs.select(*own, size.alias("_size"), crc.alias("_crc"), _named(F.col(source)).alias("_s"),
                       _named(F.col(lang)).alias("_l")).withColumn(
        "_curve", pandas_udf(_curve, "long")("_s", "_l", _sized(F.col("_size")))).drop("_s", "_l")


def hilbert_shards(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", source: str = "source",
                   lang: str = "lang", carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` (and the row as ``doc`` with ``carry``): runs of the curve whose row counts differ by at most one.

    Rows are range-partitioned by curve position, checksum and id, so equal texts of one cell lie side by
    side and no cell is too large to split. The ordered table is stored, each part's rows are counted, and a
    row's rank is its part's offset plus its place; rank r of n goes to shard ``r * shards // n`` and slots
    count from 0 in each. Null metadata has a coordinate of its own; rows with null or repeated ids are
    ordered like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = curve_order(docs, text, key, source, lang, carry)
    order = ["_curve", "_crc", "_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "curve-order")
    part = F.shiftright("_at", 33)
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())
    starts, total = {}, 0
    for number, count in counts:
        starts[number], total = total, total + count
    offset = F.element_at(F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]), part) if starts else F.lit(0)
    rank = (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    n = max(total, 1)
    out = ordered.withColumn("_rank", rank).withColumn("_shard", F.expr(f"_rank * {shards} div {n}").cast("int"))
    first = F.expr(f"(_shard * {n}L + {shards - 1}) div {shards}")
    out = out.withColumn("_slot", F.col("_rank") - first)
    return out.select(*["doc"] * carry, F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                      F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, **columns: str) -> None:
    """Write the shards as folders ``shard_number=0 ...``, each in curve order, so that file statistics prune."""
    out = hilbert_shards(docs, shards, carry=True, **columns)
    out = out.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    out.select("doc.*", F.col("shard").alias("shard_number")).write.partitionBy("shard_number").parquet(path)
