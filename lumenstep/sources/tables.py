"""Readers, writers and a versioned model store on any Hadoop file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstep.operators.models import StepModel
from lumenstep.operators.prep import Pipeline


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName().removesuffix(".parquet") for x in found if x.getPath().getName().endswith(".parquet"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, dates: list[str] | None = None, timestamp_format: str = "yyyy-MM-dd[ HH:mm:ss]", sep: str = ",") -> DataFrame:
    """A CSV with header; without a schema types are inferred, which reads the file twice. Bad dates become null."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(timestamp_format)) for c in dates or []})


def read_excel(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """All sheets (a workbook is small by its format) as one frame; needs an Excel reader for pandas."""
    import pandas as pd

    frames = [spark.createDataFrame(p.assign(sheet=s)) for s, p in pd.read_excel(path, sheet_name=sheets).items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _finite(c: Column, kind: T.DataType, fill) -> Column:
    """c with NaN and infinities as fill, inside arrays, structs and maps too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(fill)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType, fill))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _finite(x, kind.valueType, fill))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c.getField(f.name), f.dataType, fill).alias(f.name) for f in kind.fields]))
    return c


def _has_floats(kind: T.DataType) -> bool:
    return any(word in kind.simpleString() for word in ("double", "float"))


def json_safe(df: DataFrame, fill=None) -> DataFrame:
    """NaN and infinities as `fill` (null), nested ones included."""
    return df.withColumns({f.name: _finite(F.col(f"`{f.name}`"), f.dataType, fill) for f in df.schema.fields if _has_floats(f.dataType)})


def unnested(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """A row for each record of a JSON list in `column` (ddl describes a record), its fields beside the other columns.

    Texts that are null, no list or empty give one row of null fields.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.inline_outer(F.from_json(F.col(f"`{column}`"), f"array<struct<{ddl}>>")))


def records(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return json_safe(df).select(F.to_json(F.struct("*")).alias("record"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").json(path)


class ModelStore:
    """Versions of models and pipelines as Parquet rows (name, kind, version, body, saved_at) under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _save(self, name: str, kind: str, body: str) -> str:
        version = uuid.uuid4().hex
        row = self.spark.createDataFrame([(name, kind, version, body)], "name string, kind string, version string, body string")
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.folder)
        return version

    def save_model(self, name: str, model: StepModel) -> str:
        return self._save(name, "model", model.to_json())

    def save_pipeline(self, name: str, pipeline: Pipeline) -> str:
        return self._save(name, "pipeline", pipeline.to_json())

    def versions(self, name: str, kind: str = "model") -> DataFrame:
        return self.spark.read.parquet(self.folder).where((F.col("name") == name) & (F.col("kind") == kind))

    def _body(self, name: str, kind: str, version: str | None) -> str:
        rows = self.versions(name, kind)
        rows = rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("saved_at"), "version")
        found = rows.select("body").first()
        if found is None:
            raise KeyError(f"no {kind} {name} {version or ''}")
        return found.body

    def load_model(self, name: str, version: str | None = None) -> StepModel:
        return StepModel.from_json(self._body(name, "model", version))

    def load_pipeline(self, name: str, version: str | None = None) -> Pipeline:
        return Pipeline.compile(json.loads(self._body(name, "pipeline", version)))


class MetricHistory:
    """Measured values by name and time as Parquet rows (name, version, metrics, at) under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, name: str, metrics: dict[str, float], version: str = "") -> None:
        row = self.spark.createDataFrame([(name, version, {k: float(v) for k, v in metrics.items()})], "name string, version string, metrics map<string,double>")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.folder)

    def latest(self, keep: int = 10) -> DataFrame:
        """The last `keep` entries of each name."""
        newest = Window.partitionBy("name").orderBy(F.desc("at"))
        return self.spark.read.parquet(self.folder).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def score_file(spark: SparkSession, path: str, model: StepModel, threshold: float = 0.5, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Batch inference over a CSV."""
    df = read_csv(spark, path, schema, sep=sep)
    return model.predict(df, threshold) if not model.regression else model.predict(df)
