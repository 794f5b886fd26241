import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from ledgerlens.llm import quality_rules, simhash, suffix_merge

from .helpers import documents, empty

SF = "/root/testdata/sf0.001"


def test_every_stage_keeps_the_columns_and_acts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
    last = C.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


def test_run_is_the_stages_one_after_another(spark):
    got = sorted(map(str, C.run(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learned(docs, labels)
    kept = docs.join(quality_rules.judge(docs, rules).where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    near = simhash.near_copies(kept).where("doc_id = component_id").select("doc_id")
    kept = kept.join(near, "doc_id", "left_semi").select(*docs.columns)
    kept = suffix_merge.without_repeats(kept).withColumn("n_chars", F.length("text").cast("long"))
    kept = C.mix(spark, kept, SF)
    assert got == sorted(map(str, C.encode(spark, kept, SF).collect())) and got


@pytest.mark.parametrize("which", ["empty", "awkward"])
def test_awkward_tables(spark, tmp_path, which):
    sf = f"{tmp_path}/sf"
    os.makedirs(sf)
    df = empty(spark) if which == "empty" else documents(spark, extra=True)
    df.write.parquet(f"file://{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{sf}/labels.parquet")
    docs = df
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == df.columns
    got = C.run(spark, sf).collect()
    assert (got == []) == (which == "empty")
