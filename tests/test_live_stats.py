"""A stream's statistics equal those of a batch, also after late rows, a second run of a batch and compaction."""

import numpy as np

from lumenstep.operators import stats
from lumenstep.operators.models import StepClassifier
from lumenstep.operators.params import StepParams
from lumenstep.streaming.scoring import LiveStats

SCHEMA = "ts timestamp, x double, k string, f boolean, y int"


def same(a, b):
    assert (a.n, a.total) == (b.n, b.total) and a.features.keys() == b.features.keys()
    for k, f in a.features.items():
        g = b.features[k]
        assert f.kind == g.kind and list(f.values) == list(g.values) and (f.count == g.count).all() and np.allclose(f.total, g.total) and (f.null_count, f.null_total) == (g.null_count, g.null_total)


def test_stream_equals_batch(spark, tmp_path):
    nan = float("nan")
    days = ["2024-01-03", "2024-01-01", "2024-01-02"]  # rows of the first day come last but one
    for part, day in enumerate(days):
        rows = [(f"{day} 00:00:{i % 60:02d}", [None, nan, float(i % 9)][min(2, i % 5)], ["a", "b", None][i % 3], i % 2 == 0, None if i % 31 == 0 else int((i * 7 + part) % 10 < 4 + i % 3)) for i in range(200)]
        spark.createDataFrame(rows, "ts string, x double, k string, f boolean, y int").selectExpr("to_timestamp(ts) as ts", "x", "k", "f", "y").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={part}"))
    live = LiveStats(str(tmp_path / "stats"), "y", ["x"], ["k", "f"])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live.start(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination(120)
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    want = stats.collect(rows, "y", ["x"], ["k", "f"])[()]
    same(live.stats(spark), want)
    assert spark.read.parquet(live.folder).select("batch").distinct().count() == 3
    live.absorb(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "part=0")), 7)
    live.absorb(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "part=0")), 7)  # the batch runs again
    both = rows.union(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "part=0")))
    want = stats.collect(both, "y", ["x"], ["k", "f"])[()]
    same(live.stats(spark), want)
    same(live.compact(spark, str(tmp_path / "one")).stats(spark), want)
    params = StepParams(max_depth=3)
    fresh = StepClassifier(params, calibrate=False).fit(both, "y", ["x", "k", "f"])
    again = live.refit(StepClassifier(params, calibrate=False), spark)
    assert {k: [(n.lower, n.upper, n.category, round(n.score, 9)) for n in v] for k, v in again.profile.items()} == {k: [(n.lower, n.upper, n.category, round(n.score, 9)) for n in v] for k, v in fresh.profile.items()}
