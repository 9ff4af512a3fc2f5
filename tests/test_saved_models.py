"""Models that are saved, loaded and refitted behave as before; partitions with text targets; folds and dull columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenstep.operators.models import PartitionedModel, StepClassifier, StepModel, StepRegressor
from lumenstep.operators.params import StepParams
from lumenstep.operators.quality import drop_uninformative, uninformative
from lumenstep.operators.search import sample_rows, with_folds
from lumenstep.sources.tables import ModelStore


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, "yes" if (i * 7) % 10 + (i % 3 == 0) * 4 > 6 else "no", float(i % 17), "abc"[i % 3], ["x", "y", None][i // 7 % 3]) for i in range(400)]
    return spark.createDataFrame(rows, "id long, answer string, a double, b string, part string").withColumn("money", F.col("a") * 3 + F.when(F.col("b") == "a", 10).otherwise(0))


def same(left, right):
    assert [tuple(r) for r in left.orderBy("id").collect()] == [tuple(r) for r in right.orderBy("id").collect()]


def test_classifier_keeps_classes_and_statistics(spark, frame, tmp_path):
    model = StepClassifier(StepParams(max_depth=4)).fit(frame, "answer", ["a", "b"])
    store = ModelStore(spark, str(tmp_path / "models"))
    store.save_model("m", model)
    back = store.load_model("m")
    same(model.predict(frame), back.predict(frame))
    assert {r.prediction for r in back.predict(frame).collect()} == {"yes", "no"}
    old = list(back.calibration)
    for m in (model, back):
        m.refit(df=frame, max_depth=1)
    same(model.predict(frame), back.predict(frame))
    assert back.calibration == model.calibration != old
    with pytest.raises(ValueError):
        back.refit(df=frame.drop("answer"), max_depth=2)
    with pytest.raises(ValueError):
        StepModel.from_json(model.to_json(statistics=False)).refit(max_depth=2)


def test_partitioned_models_with_text_targets(spark, frame, tmp_path):
    model = PartitionedModel(params=StepParams(max_depth=3)).fit(frame, "answer", "part", ["a", "b"])
    out = model.predict(frame)
    assert {r.prediction for r in out.collect()} <= {"yes", "no"}
    store = ModelStore(spark, str(tmp_path / "parts"))
    store.save_model("p", model)
    same(out, store.load_model("p").predict(frame))
    for r in model.explain(frame).join(model.score(frame).select("id", F.col("score").alias("want")), "id").collect():
        assert abs(r.base_value + r.contribution_a + r.contribution_b - r.want) < 1e-9 and abs(r.score - r.want) < 1e-9
    with pytest.raises(ValueError):
        PartitionedModel().fit(frame, "answer", "id", ["a"], max_partitions=20)
    money = PartitionedModel(StepRegressor, StepParams(max_depth=3)).fit(frame, "money", "part", ["a", "b"])
    same(money.predict(frame), StepModel.from_json(money.to_json()).predict(frame))


def test_folds_are_stratified(frame):
    rows = with_folds(frame, "answer", "id", 5).collect()
    assert len(rows) == 400
    for label in ("yes", "no"):
        sizes = Counter(r.fold for r in rows if r.answer == label).values()
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    text = with_folds(frame.withColumn("id", F.concat(F.lit("k"), "id")), "part", "id", 3).collect()
    for part in ("x", "y", None):
        sizes = Counter(r.fold for r in text if r.part == part).values()
        assert max(sizes) - min(sizes) <= 1
    assert with_folds(frame.limit(0), "answer", "id", 5).count() == 0


def test_samples_and_dull_columns(frame):
    some = sample_rows(frame, "id", n=25, seed=4)
    same(some, sample_rows(frame.repartition(3), "id", n=25, seed=4))
    assert some.count() == 25 and 60 < sample_rows(frame, "id", fraction=0.25).count() < 140
    odd = frame.select("id", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"), F.when(F.col("id") > 3, 0).alias("zero"), F.when(F.col("id") > 3, 7).alias("seven"))
    assert uninformative(odd) == ["one", "none", "zero"] and uninformative(odd, zeros=False, keep=("one",)) == ["none"]
    assert drop_uninformative(odd).columns == ["id", "seven"] and uninformative(odd.limit(0)) == []
