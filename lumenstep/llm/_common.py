"""Small helpers that several corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch of texts, unless the session says otherwise; ten thousand long texts would be hundreds of MB.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

#: Checkpoints between two collections of the driver's garbage.
TIDY_EVERY = 5
_calls = count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured and one machine does all (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenstep-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors cost no recomputation.

    Spark drops shuffles, broadcasts and checkpoints of past steps only when the driver's
    collectors find them unused; every TIDY_EVERY-th call starts these, for a chain of many
    small steps would else pile them up.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_calls) % TIDY_EVERY == 0:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def over_texts(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of a few MB; a limit that the session has set stays."""
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only if the side is counted and holds at most max_rows rows.

    Beyond that the join stays a shuffled one, which AQE splits where it is skewed.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also when body uses it often."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_sum(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str, max_broadcast: int = 200_000
) -> DataFrame:
    """Add `out`: the sum of `value` over all rows of the group that come before the row.

    Rows are ordered by (bucket, order); `bucket` is an integer column that rises with
    the wanted order and holds few rows each.  Only totals per bucket are summed along a
    group, rows are sorted within their bucket, so a hot group spreads over many tasks.
    Null group keys form a group of their own.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(small_side(settled(offsets), max_broadcast), same)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_offset", *[f"_o_{k}" for k in keys])
    )
