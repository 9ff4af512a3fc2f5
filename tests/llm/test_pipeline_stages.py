"""Stages of the pipeline, each on all documents, against the SQL of its operator."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenstep.llm import queries

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return lambda name, what: con.sql(f"select {what} from ({queries.ORACLE_SQL[name]})").fetchall()


def ids(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = STAGES[stage](spark, docs, sf_dir)
    assert set(docs.columns) <= set(out.columns)
    return Counter(r.doc_id for r in out.select("doc_id").collect())


def test_mix_follows_the_weights(spark, sf_dir, sql):
    got = ids(spark, sf_dir, "mix")
    want = {i: taken // size for i, size, taken in sql("op3_mixing", "doc_id, size, taken") if size}
    assert {i: got[i] for i in want} == want


def test_deduplicate(spark, sf_dir, sql):
    assert ids(spark, sf_dir, "deduplicate") == Counter(i for i, kept in sql("op4_near_dedup", "doc_id, kept") if kept)


def test_decontaminate(spark, sf_dir, sql):
    assert ids(spark, sf_dir, "decontaminate") == Counter(i for i, bad in sql("op6_decontamination", "doc_id, contaminated") if not bad)


def test_shard_keeps_all(spark, sf_dir):
    assert ids(spark, sf_dir, "shard") == Counter(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("stage", list(STAGES))
def test_odd_rows_and_names(spark, sf_dir, stage):
    """Nulls, repeats, empty texts and columns with names that stages use themselves; then no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0), (10**9 + 1, "a calm word or two", None, "web", 18)], docs.schema)
    clash = {"_gone": "mine", "_copies": "mine", "_words": "mine", "tail_probability": "mine", "whole": "mine", "size": "mine"}
    for frame in (docs.union(odd), docs.limit(0)):
        frame = frame.withColumns({k: F.lit(v) for k, v in clash.items()})
        out = STAGES[stage](spark, frame, sf_dir)
        assert out.columns[: len(frame.columns)] == frame.columns
        rows = out.collect()
        assert all(r[k] == v for r in rows for k, v in clash.items())
        if stage in ("deduplicate", "decontaminate", "shard") and frame.count():
            assert Counter(r.doc_id for r in rows)[10**9] == 2 and any(r.doc_id is None for r in rows)
