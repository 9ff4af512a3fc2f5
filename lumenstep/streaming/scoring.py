"""Stateless streaming scores, and statistics kept fresh from event time windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenstep.operators import stats
from lumenstep.operators.models import StepModel
from lumenstep.operators.stats import Stats


def scored_stream(stream: DataFrame, model: StepModel) -> DataFrame:
    """The stream plus score: a projection, so any output mode and no state."""
    return stream.withColumn("score", model.score_column(stream))


def value_counts_stream(stream: DataFrame, ts: str, feature: str, target: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, value, n, total per event-time window, final once the watermark has passed."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, window), F.col(feature).alias("value"))
        .agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("total"))
        .select(F.col("window.start").alias("window_start"), "value", "n", "total")
    )


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, started, ended, n for sessions parted by more than the gap; batch or stream."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


@dataclass
class LiveStats:
    """Statistics of a stream from which models are fitted again, without a scan of past rows.

    Counts and target sums by value add up, so each micro-batch writes its own, under its
    number, to `folder` (shared by all executors): a batch that runs again replaces what it
    wrote, and rows that come late simply count when they come.  `compact` adds up what has
    been written into one part.
    """

    folder: str
    target: str
    numeric: list[str]
    categorical: list[str]

    def _long(self, batch: DataFrame) -> DataFrame:
        """(feature, number, text, n, s): rows and target sum by value; both null for missing values."""
        known = batch.where(F.col(f"`{self.target}`").isNotNull())
        y = stats.target_column(known, self.target)
        nothing = F.lit(None)
        cells = [F.struct(F.lit(c).alias("feature"), stats.number(c).alias("number"), nothing.cast("string").alias("text")) for c in self.numeric]
        cells += [F.struct(F.lit(c).alias("feature"), nothing.cast("double").alias("number"), stats.category(known, c).alias("text")) for c in self.categorical]
        return known.select(y.alias("y"), F.explode(F.array(*cells)).alias("x")).select("y", "x.*").groupBy("feature", "number", "text").agg(F.count("*").alias("n"), F.sum("y").alias("s"))

    def absorb(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: write the sums of a micro-batch."""
        self._long(batch).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Absorb a stream; trigger as for writeStream.trigger."""
        writer = stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder).groupBy("feature", "number", "text").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def compact(self, spark: SparkSession, into: str) -> LiveStats:
        """The same statistics as one part of another folder, to go on from."""
        self.counts(spark).write.mode("overwrite").parquet(f"{into}/batch=-1")
        return LiveStats(into, self.target, self.numeric, self.categorical)

    def stats(self, spark: SparkSession) -> Stats:
        """As stats.collect gives for all rows so far; bounds as there, over them values are refused."""
        counts = self.counts(spark)
        sizes = {r.feature: r["count"] for r in counts.groupBy("feature").count().collect()}
        for names, most in ((self.numeric, stats.MAX_VALUES), (self.categorical, stats.MAX_CATEGORIES)):
            if wide := [c for c in names if sizes.get(c, 0) > most + 1]:
                raise ValueError(f"over {most} values in {wide}; round or condense them")
        rows, out = counts.toPandas(), Stats()
        for kind, names, column in (("numeric", self.numeric, "number"), ("categorical", self.categorical, "text")):
            for c in names:
                own = rows[rows["feature"] == c]
                null = own[column].isna()
                part = own[~null].sort_values(column)
                values = part[column].to_numpy(dtype=float if kind == "numeric" else object)
                out.features[c] = stats.FeatureStats(kind, values, part["n"].to_numpy(), part["s"].to_numpy(dtype=float), int(own["n"][null].sum()), float(own["s"][null].sum()))
                out.n, out.total = int(own["n"].sum()), float(own["s"].sum())
        return out

    def refit(self, model: StepModel, spark: SparkSession) -> StepModel:
        """The model on the statistics so far; a regressor's ridge step and a classifier's calibration need rows and stay."""
        model.target, model.stats = self.target, self.stats(spark)
        model.rebuild()
        return model
