"""Mixing and sharding against direct versions."""

import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenstep.llm import mixing, sharding


def direct_targets(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] > cap * sizes[s]]
        if not over:
            return out | fixed
        fixed |= {s: cap * sizes[s] for s in over}


def docs(spark):
    rows = [(i, ("w " * (1 + i * i % 37)).strip(), ["é", "b", None, "a", "Z"][min(i % 9, 4)], "en") for i in range(800)]
    rows += [(900, None, "empty", None), (901, "", "empty", "x"), (902, "x y", "b", "en"), (902, "x y", "b", "en"), (None, "p q r", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mix(spark):
    frame = docs(spark)
    got = mixing.mixed(frame).collect()
    assert len(got) == 805
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
    want = direct_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 37 for s in sizes)
    assert sorted(map(str, mixing.mixed(frame.repartition(7)).collect())) == sorted(map(str, got))
    out = mixing.repeated(frame)
    assert out.columns == frame.columns
    assert out.select(mixing.text_size(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == sum(taken.values())
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    got = mixing.mixed(frame, F.col("w"), share=0.5).where("taken > 0").collect()
    assert sum(r.doc_id % 2 == 0 for r in got) > 0.6 * len(got)


def test_shards(spark):
    frame = docs(spark)
    got = sharding.digest(frame, 16).collect()
    assert len(got) == 805
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    assert set(per) == set(range(16))
    mean = sum(r["size"] for r in got) / 16
    for rows in per.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - mean) < 0.15 * mean
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert sharding.digest(frame.limit(0), 16).count() == 0
    assert sharding.digest(frame.limit(3), 5).count() == 3
    out = sharding.placed(frame.withColumn("shard", F.lit("mine")).withColumn("size", F.lit("x")), target_bytes=4000)
    assert out.count() == 805 and out.select("shard").distinct().count() > 4


def test_splits_follow_the_widest_dimension(spark):
    """Two sources of equal bytes and little else: the first cut parts them."""
    frame = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("en").alias("lang"))
    got = sharding.sharded(frame, 2).groupBy("shard").agg(F.count_distinct(F.col("doc_id") % 2).alias("n")).collect()
    assert [r.n for r in got] == [1, 1]


def test_placed_and_repeated_rows_follow_the_digests(spark):
    frame = docs(spark).dropDuplicates(["doc_id"]).withColumns({"_copies": F.lit("mine"), "key": F.lit(1), "d0": F.lit(2)})
    shard = {r.doc_id: r.shard for r in sharding.digest(frame, 16).collect()}
    assert {r.doc_id: r.shard for r in sharding.placed(frame, 16).collect()} == shard
    rated = spark.createDataFrame([(i, i % 2) for i in range(0, 800, 3)], "_rated long, _quality int")
    want = {r.doc_id: r.taken // r["size"] for r in mixing.digest(frame, rated, 2.0, 0.5).collect() if r["size"]}
    out = mixing.repeated(frame, rated, 2.0, 0.5)
    got = Counter(r.doc_id for r in out.where("length(text) > 0").collect())
    assert out.columns == frame.columns and got == Counter({k: v for k, v in want.items() if v})
    assert mixing.repeated(frame.limit(0), rated).count() == 0 and sharding.placed(frame.limit(0)).count() == 0
