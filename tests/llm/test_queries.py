"""Registered queries against their SQL, top-k against brute force, the pipeline end to end."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenstep.llm import queries, topk

TABLES = ["documents", "labels", "benchmark", "embeddings", "conversations"]


def plain(x):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(plain, map(tuple, got.collect())), key=str) == sorted(map(plain, want), key=str)


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (None, [0.0] * 6), (5, rows[5][1])]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    for options in ({}, {"pass_queries": 2}):
        got = topk.top_k(v, v.where("vec_id % 100 = 0"), 7, **options).orderBy("query_id", "rank").collect()
        ok = {i: np.floor(np.array(e) * 1024) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
        want = []
        for q in sorted(i for i in ok if i % 100 == 0):
            best = sorted((-int(ok[q] @ e), i) for i, e in ok.items() if i != q and len(e) == len(ok[q]))[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        assert [tuple(r) for r in got] == want


def test_topk_leaves_entries_unread(spark, sf_dir):
    x = np.random.default_rng(3).normal(size=(4000, 16))
    v = topk.usable(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1))
    reading = {}
    got = topk.top_k(v, v.where("vec_id % 100 = 0"), reading=reading).collect()
    whole = np.floor(x * 1024)
    for q in range(0, 4000, 100):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(4000), -scores))[:10]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(int(i), int(scores[i])) for i in best]
    assert 0 < reading["read"] + 16 * reading["resolved"] < 0.8 * reading["all"]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
    assert topk.top_k(v.limit(0), v.where("vec_id = 0")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) <= set(out.columns) and "shard" in out.columns
    ids = out.select("doc_id").distinct()
    assert ids.join(docs, "doc_id", "left_anti").count() == 0
    assert 0 < ids.count() < docs.count()
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    assert ids.join(bad, "doc_id").count() <= 0.5 * bad.count()
    assert out.groupBy("shard").agg(F.sum(F.octet_length("text"))).count() == 16
    again = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard").orderBy("doc_id", "shard").collect()]
    assert again == [tuple(r) for r in out.select("doc_id", "shard").orderBy("doc_id", "shard").collect()]
