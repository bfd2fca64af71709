"""Lineage cuts and size-checked joins shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIPPED = "sagline-source.zip"
# A table of at most this many rows (about 100 bytes each) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
# A group of at most this many rows may be ordered by one window task; larger ones are range-split.
GROUP_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a scratch folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, for clusters that have it only on the driver."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if any(f.endswith(f"/{SHIPPED}") for f in sc.listFiles) or not (root / "sagline").is_dir():
        return
    # Executors fetch the file from the driver when they first need it, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, SHIPPED)
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((root / "sagline").rglob("*.py")):
            out.write(source, source.relative_to(root))
    sc.addPyFile(str(path))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Materialise a per-group table and mark it for broadcast when its row count allows that."""
    df = cut_lineage(df)
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has few enough rows to be broadcast."""
    limit = BROADCAST_ROWS if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def attach(df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per group of ``stats`` to ``df``.

    A small ``stats`` is broadcast, so ``df`` keeps its partitioning; a large one is joined by
    shuffle, where adaptive execution splits a hot group.
    """
    return df.join(sized(stats), list(on), how)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0
