"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest
from fieldloom.llm import registry

TABLES = ("documents", "labels", "conversations", "benchmark")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want, got = con.execute(registry.SQL[name]).df(), registry.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(got).equals(plain(want))


def test_ten_operators():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from fieldloom.llm import simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        if name != "bpe":
            assert kept.columns == columns
        if name == "simhash_near_dedup":
            assert simhash.similar_classes(kept).where("doc_id != component_id").count() == 0
    assert kept.count() == corpus_pipeline.run(spark, sf_dir).count() > 0
