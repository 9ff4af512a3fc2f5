"""Leaf sums of many models in one job against leaf ids of rows; partitioned regressors against single ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstep.operators import gram
from lumenstep.operators.models import PartitionedModel, StepRegressor
from lumenstep.operators.params import StepParams


@pytest.fixture(scope="module")
def rows(spark):
    nan = float("nan")
    data = [(f"p{i % 5}" if i % 13 else None, None if i % 7 == 0 else nan if i % 11 == 0 else float(i % 37), ["a", "b", None, "c"][i % 4], i % 3 == 0, float((i * 31) % 101) + (i % 37)) for i in range(1500)]
    return spark.createDataFrame(data, "part string, x double, k string, f boolean, y double").repartition(6)


@pytest.mark.parametrize("cells", [1, gram.CELLS])
def test_sums_equal_leaf_ids(rows, monkeypatch, cells):
    monkeypatch.setattr(gram, "CELLS", cells)
    model = StepRegressor(StepParams(max_depth=3, min_leaf_size=0.01)).fit(rows, "y", ["x", "k", "f"])
    sums = gram.leaf_sums(rows, "y", {None: model.profile})[None]
    ids = model.leaf_ids(rows).toPandas()
    start = np.concatenate([[0], np.cumsum([len(v) for v in model.profile.values()])])[:-1]
    own = ids[[f"leaf_{k}" for k in model.profile]].to_numpy() + start
    ones = np.zeros((len(ids), len(sums.count)))
    for c in range(own.shape[1]):
        ones[np.arange(len(ids)), own[:, c]] = 1
    assert (sums.both == ones.T @ ones).all() and (sums.count == ones.sum(0)).all() and np.allclose(sums.total, ids.y @ ones)


def test_partitions_in_one_scan(spark, rows):
    wide = rows.withColumn("part", F.concat(F.lit("q"), F.xxhash64("x", "k", "y") % 100))
    seen, real = [], gram.leaf_sums
    try:
        gram.leaf_sums = lambda *a: seen.append(out := real(*a)) or out
        model = PartitionedModel(StepRegressor, StepParams(max_depth=2)).fit(wide, "y", "part", ["x", "k"])
    finally:
        gram.leaf_sums = real
    assert len(seen) == 1 and len(seen[0]) == len(model.models) > 100
    few = PartitionedModel(StepRegressor, StepParams(max_depth=2)).fit(rows.where("part is not null"), "y", "part", ["x", "k"])
    for value in ("p0", "p3"):
        single = StepRegressor(StepParams(max_depth=2)).fit(rows.where(F.col("part") == value), "y", ["x", "k"])
        assert np.allclose([n.score for v in single.profile.values() for n in v], [n.score for v in few.models[value].profile.values() for n in v]) and np.isclose(single.base, few.models[value].base)


def test_ridge_takes_one_pass_over_rows(spark, rows):
    model = StepRegressor(StepParams(max_depth=2)).fit(rows, "y", ["x", "k"])
    spark.sparkContext.setJobGroup("ridge", "")
    model._finish(rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ridge")) <= 3  # a scan, its shuffle read, what is collected
    spark.sparkContext.setJobGroup("", "")
    assert gram.leaf_sums(rows.limit(0), "y", {None: model.profile})[None].count.sum() == 0
