"""The pipeline's stages, each against its operator on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sagline.llm import cube, passages, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        out.append(docs.cache())
        docs = stage(spark, docs, SF)
    return [*out, docs.cache()]


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    docs, good, single, clean, drawn, final = steps
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert ids(good) == ids(quality.judged(docs).where("_keep"))
    groups = simhash.near_groups(good).toPandas()
    assert ids(single) == sorted(groups["component_id"].unique())
    found = passages.find_passages(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(clean) == ids(found.where(F.size("hits") == 0))
    assert ids(drawn) == ids(cube.mix(clean).withColumn("n", F.explode(F.expr("sequence(1L, copies)"))).where("copies > 0"))
    assert ids(final) == ids(drawn)
    sizes = [r["count"] for r in final.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_run(spark, steps):
    got = pipeline.run(spark, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, steps[-1].collect()))
