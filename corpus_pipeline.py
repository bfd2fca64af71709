"""A corpus from classified to sharded: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline.llm import cube, hilbert, passages, quality, simhash
from sagline.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHARDS = 40
# The classifier and the draw have no SQL form.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the stage's own input."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by id, of each group of linked fingerprints."""
    return simhash.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark window."""
    return passages.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced draw takes them, so that sources come near their targets."""
    return cube.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each drawn row goes: its run of the Hilbert curve, and its place there, in place of columns of these names."""
    found = hilbert.hilbert_shards(docs, SHARDS, carry=True)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return found.select(*[F.col("doc").getField(c).alias(c) for c in own], "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources), ("hilbert_sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is stored in the shared folder before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace("_", "-"))
    return docs
