"""Every registered query against its DuckDB statement or its invariants, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlab.llm import queries
from tests.conftest import SF_SMALL

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(want, key=repr)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    hard = spark.createDataFrame([(10 ** 9, None, None, None, None), (10 ** 9 + 1, "", "en", "s", 0)], docs.schema)
    docs = docs.union(hard)
    benchmark = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, SF_SMALL).cache()
        assert 0 < docs.count() <= before
        if k < 4:
            assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {10 ** 9, 10 ** 9 + 1} <= ids
        if name == "secrets":
            assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}|password=[0-9a-f]{6}")).count() == 0
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert docs.filter("not round_trip").count() == 0 and len(benchmark) > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert 0 < rows.count() <= spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
