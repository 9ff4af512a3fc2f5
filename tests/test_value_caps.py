"""Steps that learn values refuse more of them than they may keep."""

import pytest
from pyspark.sql import functions as F

from lumenstep.operators.prep import Pipeline


def spec(kind, **params):
    return Pipeline.compile({"steps": [{"type": kind, "columns": ["c"], "params": params}]})


def test_one_hot_drops_no_value(spark):
    df = spark.range(201).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 200 values"):
        spec("OneHot").fit_transform(df)
    assert len(spec("OneHot").fit_transform(df.where("c <> '7'")).columns) == 200
    assert len(spec("OneHot", max_values=201).fit_transform(df).columns) == 201


def test_cumulative_condense_keeps_the_share(spark):
    df = spark.range(10_500).select(F.format_string("v%05d", "id").alias("c"))
    with pytest.raises(ValueError, match="more than 10000 values"):
        spec("CategoryCondense", mode="cumulative", min_frequency=0.01).fit_transform(df)
    kept = spec("CategoryCondense", mode="cumulative", min_frequency=0.1).fit_transform(df)
    assert kept.where("c <> 'Other'").count() == 9450
