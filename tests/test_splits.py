"""Distributed split search against the search over collected values and against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstep.operators import splits, stats, tree
from lumenstep.operators.models import StepClassifier, StepModel, StepRegressor
from lumenstep.operators.params import StepParams


def both(df, target, numeric, params, alpha=0.1):
    """Nodes of the features with values in a table, and with values on the driver."""
    out = []
    for most in (8, 10_000_000):
        s = stats.collect(df, target, numeric, [], max_values=most)[()]
        assert all((f.wide is not None) == (most == 8) for f in s.features.values())
        grown = tree.wide_leaves(s.features, s.n, s.base, lambda _: params, alpha)
        out.append((s.n, s.total, {k: tree.nodes(k, s.features[k], s.n, s.base, params, alpha, False, grown.get(k)) for k in numeric}))
    return out


def alike(a, b):
    """The same nodes; means may differ in the last digits, as sums of parts are added in another order."""
    plain = lambda nodes: [(n.lower, n.upper, n.is_null, n.freq) for n in nodes]
    return plain(a) == plain(b) and np.allclose([n.mean for n in a], [n.mean for n in b], rtol=1e-9)


@pytest.mark.parametrize("depth,alpha", [(0, 0.1), (1, 0.1), (4, 0.1), (8, 0.5)])
def test_equals_collected_values(spark, depth, alpha):
    rng = np.random.default_rng(depth)
    x, z = np.round(rng.normal(size=2500), 2), rng.integers(0, 40, 2500) / 4
    y = (rng.random(2500) < np.where(x > 0.3, 0.7, 0.2)).astype(int)
    rows = [(None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "x double, z double, y int").repartition(7)
    wide, local = both(df, "y", ["x", "z"], StepParams(max_depth=depth, min_leaf_size=0.004), alpha)
    assert wide[:2] == local[:2] and all(alike(wide[2][k], local[2][k]) for k in ("x", "z"))


def test_a_million_values(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n * 0.25).alias("x"), ((F.xxhash64("id") % 100 < 20) | ((F.col("id") * 7919 % n > 600_000) & (F.xxhash64("id") % 100 < 45))).cast("int").alias("y"))
    seen, real = [], splits.best_splits
    model = StepClassifier(StepParams(max_depth=2), calibrate=False)
    try:
        splits.best_splits = lambda *a: seen.append(out := real(*a)) or out
        model.fit(df, "y", ["x"])
    finally:
        splits.best_splits = real
    assert len(seen) == 2 and all(len(x) <= 2 for x in seen) and len(model.stats.features["x"].values) == 0
    pdf = df.toPandas().sort_values("x")
    x, y, base = pdf.x.to_numpy(), np.cumsum(pdf.y.to_numpy()), pdf.y.mean()
    step = splits.candidate_step(n, 0.1)
    at = np.arange(0, n - 1, step)

    def best(lo, hi):
        own = at[(at >= lo) & (at < hi - 1)]
        below, total = own + 1.0, y[own].astype(float)
        s0, s1 = (y[lo - 1] if lo else 0), y[hi - 1]
        gain = splits.gains(below, total, (lo, s0), (hi, s1), n, base, 100, 1e-4)
        return int(own[np.argmax(gain)]) + 1

    root = best(0, n)
    cuts = sorted([root, best(0, root), best(root, n)])
    assert [node.upper for node in model.profile["x"] if not node.is_null][:-1] == [(x[c - 1] + x[c]) / 2 for c in cuts]


def test_models_with_wide_features(spark):
    df = spark.range(3000).select((F.xxhash64("id") % 997 / 8).alias("x"), (F.xxhash64("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 5 > 0, F.rand(3)).alias("z"), (F.xxhash64("id") % 997 > 200).cast("int").alias("y")).persist()
    old = stats.collect.__defaults__
    try:
        stats.collect.__defaults__ = (None, 50, 100_000)
        wide = StepClassifier(StepParams(max_depth=3)).fit(df, "y", ["x", "k", "z"])
        ridge = StepRegressor(StepParams(max_depth=2)).fit(df, "y", ["x", "k"])
    finally:
        stats.collect.__defaults__ = old
    plain = StepClassifier(StepParams(max_depth=3)).fit(df, "y", ["x", "k", "z"])
    assert list(wide.profile) == ["x", "k", "z"] and all(alike(wide.profile[k], plain.profile[k]) for k in ("x", "z")) and wide.stats.n == 3000
    wide.refit(["x"], max_depth=1)
    plain.refit(["x"], max_depth=1)
    assert alike(wide.profile["x"], plain.profile["x"]) and len(wide.profile["x"]) == 3
    assert ridge.predict(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.2
    again = StepModel.from_json(wide.to_json())
    assert again.score(df).agg(F.sum("score")).first()[0] == pytest.approx(wide.score(df).agg(F.sum("score")).first()[0])
    with pytest.raises(ValueError, match="fit again"):
        again.refit(None, max_depth=2)


def test_one_value_and_none(spark):
    df = spark.createDataFrame([(1.0, None, 1), (1.0, None, 0)], "x double, z double, y int")
    groups = spark.createDataFrame([(0, 1.0, 2, 1.0)], "f int, v double, n long, s double")
    table, sizes = splits.cumulated(groups)
    assert sizes == {0: 1} and table.count() == 0
    leaves = splits.grow({"x": (splits.WideValues(table, 0, 1), StepParams(), 2.0, 1.0)}, 2, 0.5, 0.1)
    assert leaves == {"x": [(-math.inf, math.inf, 2.0, 1.0)]} and splits.grow({}, 2, 0.5, 0.1) == {}
    assert StepClassifier(calibrate=False).fit(df, "y", ["x", "z"]).stats.n == 2
