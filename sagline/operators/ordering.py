"""Row numbers and neighbours in an order, for groups of any size.

A window with one partition per group sorts the whole group in one task. Groups above
``GROUP_ROWS`` are therefore range-split: a global range partitioning cuts each group into
consecutive pieces, windows run per (group, piece), and a table with one row per piece carries
the running offset or the neighbouring row across the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagline import session


def _keys(order: Sequence[str]) -> list[Column]:
    """Column names, with a leading minus for descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def has_large_group(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    limit = session.GROUP_ROWS if limit is None else limit
    return not session.is_empty(df.groupBy(*by).count().where(F.col("count") > limit))


def range_split(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_part``: consecutive pieces of each group in the given order."""
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *_keys(order))
    return session.cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn",
                limit: int | None = None) -> DataFrame:
    """1-based position of each row in its group. ``order`` must not leave ties."""
    by = list(by)
    if not has_large_group(df, by, limit):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*_keys(order))).cast("long"))
    parts = range_split(df, by, order)
    sizes = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*by, "_part").orderBy(*_keys(order))
    return (session.attach(parts, sizes, [*by, "_part"])
            .withColumn(name, (F.row_number().over(local) + F.col("_before")).cast("long"))
            .drop("_part", "_before"))


def next_row(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], name: str = "next",
             limit: int | None = None) -> DataFrame:
    """Add a struct of ``cols`` taken from the following row of the group; NULL on the last one."""
    by, row = list(by), F.struct(*cols)
    if not has_large_group(df, by, limit):
        return df.withColumn(name, F.lead(row).over(Window.partitionBy(*by).orderBy(*_keys(order))))
    parts = range_split(df, by, order)
    local = Window.partitionBy(*by, "_part").orderBy(*_keys(order))
    parts = parts.withColumns({"_i": F.row_number().over(local), "_lead": F.lead(row).over(local)})
    heads = parts.where(F.col("_i") == 1).select(*by, "_part", row.alias("_head"))
    heads = heads.select(*by, "_part", F.lead("_head").over(Window.partitionBy(*by).orderBy("_part")).alias("_over"))
    return (session.attach(parts, heads, [*by, "_part"])
            .withColumn(name, F.coalesce("_lead", "_over"))
            .drop("_part", "_i", "_lead", "_over"))


def systematic_sample(df: DataFrame, k: int, by: Sequence[str] = ("cloud_id",), order: Sequence[str] = ("point_id",),
                      limit: int | None = None) -> DataFrame:
    """Every k-th row of each group, starting with the first."""
    numbered = number_rows(df, by, order, "_rn", limit)
    return numbered.where((F.col("_rn") - 1) % k == 0).drop("_rn")
