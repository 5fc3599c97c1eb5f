"""The registered queries over the given tables, and the pipeline's stages against what each of them must do."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from factloom.llm import langid
from factloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not here")


def test_registered():
    names = set(entry_module.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_exact_products_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got = QUERIES["op9_exact_top_products"](spark, FOLDER).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op9_exact_top_products']})").fetchall())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = QUERIES["op10_language_id"](spark, folder).join(docs, "doc_id").filter("held_out")
    assert lang.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
    toxic = QUERIES["op7_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    assert toxic.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.93
    assert toxic.filter(~langid.held_out("doc_id", 3, 1)).count() == 0


def test_pipeline(spark, tmp_path):
    docs, before = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == before.columns
        if name in ("personal_data", "mixing"):
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in before.select("doc_id").collect())
        if name in ("toxicity", "near_duplicates"):
            assert 0 < docs.count() < before.count()
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()
