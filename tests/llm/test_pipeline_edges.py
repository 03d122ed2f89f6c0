"""The pipeline on nulls, odd texts, repeated rows, extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, ODD

NULL_ROWS = [(None, "no id at all in this row here", "en", "s1", 5), (None, "no id at all in this row here", "en", "s1", 5), (None, None, None, None, None), (3, "the same id but another text", None, None, 9), (7, "word", "en", None, None)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(ODD)] + NULL_ROWS
    odd = spark.createDataFrame(rows, DOCS)
    odd.select("*", F.lit(1).alias("score"), F.lit("z").alias("Text_"), F.lit(2).alias("node")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(13)] + [(1, None, None), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name == "pieces":
            assert out.columns == ["doc_id", "source", "piece_ids", "n_pieces", "round_trip"] and out.count() == docs.count()
            continue
        assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "minhash_dedup":
            kept = [(r.doc_id, r.text) for r in out.collect()]
            assert kept.count((None, "no id at all in this row here")) == 1 and (None, "") in kept and (3, "the same id but another text") in kept and (3, "\n\n") in kept
            assert (11, "same text here") in kept and (12, "same text here") not in kept
        docs = out


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
