"""Models against independent derivations on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenstep.operators import calibration, stats
from lumenstep.operators.models import PartitionedModel, StepClassifier, StepModel, StepRegressor
from lumenstep.operators.params import StepParams


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        x = rng.choice([None, float("nan"), *[rng.randint(0, 40) / 4 for _ in range(8)]])
        k = rng.choice(["a", "b", "c", None])
        y = int(rng.random() < (0.8 if (x or 0) > 5 or k == "b" else 0.2))
        rows.append((i, x, rng.random(), k, rng.random() < 0.5, y, y * 3.0 + (x if x and x == x else 0)))
    return spark.createDataFrame(rows, "id long, x double, z double, k string, f boolean, y int, t double").persist()


def brute_leaves(pdf, name, p, alpha=0.1):
    """Leaves by scanning rows for every candidate, formulas only."""
    n, base = len(pdf), pdf.y.mean()
    x = pdf[[name, "y"]].dropna()
    u = np.sort(x[name].unique())
    nb = int((len(u) ** (1 - alpha) - 1) / (1 - alpha)) + 1
    cuts = [(u[i] + u[i + 1]) / 2 for i in range(0, len(u) - 1, len(u) // nb)]
    least = max(1, int(p.min_leaf_size * n))

    def visit(part, lower, upper, depth):
        best = (0.0, None)
        for c in cuts if depth < p.max_depth else []:
            if not lower < c < upper:
                continue
            a, b = part[part[name] <= c], part[part[name] > c]
            if len(a) < least or len(b) < least:
                continue
            la, lb = abs(a.y.mean() - base), abs(b.y.mean() - base)
            if max(la, lb) < p.min_info_gain:
                continue
            gain = round(la * math.log2(len(a) / n * 100) + lb * math.log2(len(b) / n * 100), 12)
            if gain > best[0]:
                best = (gain, c)
        if best[1] is None:
            return [(lower, upper, round(part.y.mean(), 9), len(part))]
        c = best[1]
        return visit(part[part[name] <= c], lower, c, depth + 1) + visit(part[part[name] > c], c, upper, depth + 1)

    return visit(x, -math.inf, math.inf, 0)


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_leaves_against_brute_force(frame, depth):
    p = StepParams(max_depth=depth, min_leaf_size=0.02)
    model = StepClassifier(p).fit(frame, "y", ["x", "z"])
    pdf = frame.toPandas()
    for name in ("x", "z"):
        got = [(n.lower, n.upper, round(n.mean, 9), round(n.freq * len(pdf))) for n in model.profile[name] if not n.is_null]
        assert got == brute_leaves(pdf, name, p)


def test_invariants(frame):
    model = StepClassifier(StepParams(max_depth=4, min_leaf_size=0.01)).fit(frame, "y", ["x", "z", "k", "f"])
    for v in model.profile.values():
        assert abs(sum(n.freq for n in v) - 1) < 1e-9
    out = model.predict_explain(frame).toPandas()
    total = out.filter(like="contribution_").sum(axis=1) + out.base_value
    assert np.allclose(total, out.score) and out.score.between(-1e-9, 1 + 1e-9).all()
    assert abs(sum(model.importances().values()) - 1) < 1e-9
    again = StepModel.from_json(model.to_json())
    assert np.allclose(again.predict(frame).toPandas().proba, out.proba)


def test_refit_equals_fresh_fit(frame):
    p = StepParams(max_depth=2, min_leaf_size=0.05, weight=0.5)
    one = StepClassifier().fit(frame, "y", ["x", "k"]).refit(None, frame, max_depth=2, min_leaf_size=0.05, weight=0.5)
    two = StepClassifier(p).fit(frame, "y", ["x", "k"])
    assert one.profile == two.profile and one.calibration == two.calibration


def test_unseen_missing_and_types(spark, frame):
    model = StepClassifier(calibrate=False).fit(frame, "y", ["k"])
    null = model.profile["k"][-1].score
    assert model.score(spark.createDataFrame([("new",), (None,)], "k string")).toPandas().score.tolist() == [model.base + null] * 2
    with pytest.raises(ValueError):
        model.score(spark.createDataFrame([(1,)], "other int"))
    with pytest.raises(ValueError):
        StepClassifier().fit(frame.withColumn("d", F.current_timestamp()), "y", ["d"])


def test_wide_feature_uses_bounded_cells_with_keys(frame):
    s = stats.Stats.merged(list(stats.collect(frame, "y", ["z"], [], ["f"], max_values=16).values())).features["z"]
    assert len(s.values) <= 16 and s.count.sum() == 400
    split, count, _ = stats.candidates(s, 0.1)
    z = frame.toPandas().z
    assert [int((z <= c).sum()) for c in split] == count.tolist()


def test_partitions_equal_single_models(frame):
    part = PartitionedModel(params=StepParams(max_depth=3)).fit(frame.where("k is not null"), "y", "k", ["x", "z"])
    for value in "abc":
        own = StepClassifier(StepParams(max_depth=3)).fit(frame.where(F.col("k") == value), "y", ["x", "z"])
        assert part.models[value].profile == own.profile and np.allclose(part.models[value].calibration, own.calibration)
    rows = frame.limit(20).withColumn("k", F.lit("elsewhere"))
    every = StepClassifier(StepParams(max_depth=3)).fit(frame.where("k is not null"), "y", ["x", "z"])
    assert np.allclose(part.predict(rows).toPandas().score, every.score(rows).toPandas().score)


def test_ridge_against_dense_solution(frame):
    model = StepRegressor(StepParams(max_depth=2, min_leaf_size=0.05)).fit(frame, "t", ["x", "k"])
    ids = model.leaf_ids(frame).toPandas()
    columns = [np.where(ids[f"leaf_{k}"] == n.node_id, n.raw, 0.0) for k in ("x", "k") for n in model.profile[k]]
    a = np.array(columns).T
    ac, yc = a - a.mean(axis=0), ids.t - ids.t.mean()
    w = np.linalg.solve(ac.T @ ac + np.eye(a.shape[1]), ac.T @ yc)
    assert np.allclose(model.predict(frame).toPandas().prediction, a @ w + ids.t.mean() - a.mean(axis=0) @ w)


def test_calibration_against_pandas():
    rng = random.Random(1)
    s = pd.Series([rng.random() for _ in range(3000)])
    y = pd.Series([int(rng.random() < v) for v in s])
    b = np.maximum(np.ceil((s * 20).round(9)) - 1, 0)
    n, m = y.groupby(b).count(), y.groupby(b).mean()
    t = pd.DataFrame({"n": n, "m": m}).reindex(range(20)).fillna(0)
    w = (t.n * t.m).rolling(3, center=True, min_periods=2).sum() / t.n.rolling(3, center=True, min_periods=2).sum()
    want = pd.Series(np.append(np.repeat(w.to_numpy(), 5), w.iloc[-1])).rolling(15, center=True, min_periods=3).mean()
    got = calibration.smoothed([(int(i), int(n[i]), float(m[i])) for i in n.index])
    assert np.allclose(got, want)


def test_empty_and_constant(spark, frame):
    model = StepClassifier().fit(frame.limit(0), "y", ["x", "k"])
    assert model.score(frame).count() == 400
    one = StepClassifier().fit(frame.withColumn("c", F.lit(1.0)), "y", ["c"])
    assert len(one.profile["c"]) == 2


def test_stream_equals_batch(spark, frame, tmp_path):
    from lumenstep.streaming.scoring import scored_stream

    model = StepClassifier().fit(frame, "y", ["x", "k"])
    frame.write.parquet(f"{tmp_path}/in")
    stream = scored_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), model)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    a, b = (d.orderBy("id").toPandas().score for d in (spark.read.parquet(f"{tmp_path}/out"), model.score(frame)))
    assert np.allclose(a, b)


def test_store_and_files(spark, frame, tmp_path):
    from lumenstep.sources.tables import ModelStore, read_csv, write_csv

    model = StepClassifier().fit(frame, "y", ["x", "k"])
    store = ModelStore(spark, f"{tmp_path}/store")
    store.save_model("m", StepClassifier().fit(frame, "y", ["k"]))
    version = store.save_model("m", model)
    assert np.allclose(store.load_model("m", version).score(frame).toPandas().score, model.score(frame).toPandas().score)
    write_csv(frame.select("id", "x", "k"), f"{tmp_path}/csv")
    assert read_csv(spark, f"{tmp_path}/csv").count() == 400
