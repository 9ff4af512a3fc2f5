"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / weight with u a fixed hash of its id, so the smallest
keys are a weighted sample without replacement and reruns agree.  A source first takes
as many complete epochs as its target holds; the rest goes to documents in key order as
long as the prefix sum of their sizes stays within it (the crossing document is taken if
that ends nearer).  Prefix sums are bucketed, so a source with a third of all rows
spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.llm._common import running_sum, settled, small_side

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKETS = 4096
#: Rows of the sides that may be broadcast: one a source, one a rated document.
MAX_SOURCES, MAX_RATED = 100_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id (null: as empty text)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target for sizes (source, size).

    Sources in code point order, null last, weigh `weights`, repeating.  They share `share`
    of all sizes; no target exceeds cap times its source's size, what is over is shared
    again by weight.  The level at which that ends is found from running sums in the order
    in which sources reach their cap.  Windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picks = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", picks[(place % len(weights)).cast("int")])
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(on)).withColumn("full", F.col("level") >= F.col("ratio"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("ratio"))).over(every)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size and whole (text hash) in place of the text."""
    return docs.withColumn("size", text_size(F.col("text"))).withColumn("whole", F.xxhash64("text")).drop("text")


def mixed(docs: DataFrame, weight: Column | None = None, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, whole (text hash), size, source_size, target, taken for each row of docs (doc_id, text, source).

    weight: a column of docs, above 0; null or none counts as 1.  A null source is a source
    of its own, a null text has size 0.  taken is a multiple of size, at most cap times it.
    Rows that repeat a doc_id have the same key; they stand next to each other and each
    counts.
    """
    return mixed_sizes(sized(docs), weight, seed, weights, share, cap)


def _keyed(rows: DataFrame, weight: Column | None, seed: int) -> DataFrame:
    """doc_id, source, size, whole, key and bucket of sized rows."""
    w = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    keyed = rows.select("doc_id", "source", "size", "whole", (-F.ln(uniform(F.col("doc_id"), seed)) / w).alias("key"))
    return keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))


def _taken(slim: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """Keyed rows with source_size, target, epochs and extra: whether the fractional epoch takes the row."""
    goal = settled(targets(slim.select("source", "size"), weights, share, cap).withColumnRenamed("source", "_source"))
    rows = slim.join(small_side(goal, MAX_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(cap)))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rows = running_sum(rows, ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("whole")], F.col("size"), "before")
    room = F.col("target") - F.col("epochs") * F.col("source_size")
    return rows.withColumn("extra", (2 * F.col("before") + F.col("size") <= 2 * room) & (F.col("epochs") + 1 <= cap))


def mixed_sizes(rows: DataFrame, weight: Column | None = None, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The same for rows that carry size and whole instead of the text."""
    copies = F.col("epochs") + F.when(F.col("extra"), 1).otherwise(0)
    taken = _taken(settled(_keyed(rows, weight, seed)), weights, share, cap).withColumn("copies", copies)
    return taken.select("doc_id", "source", "whole", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "copies")


def rating_weight(good: float, poor: float) -> Column:
    """The weight of a document by its _quality: good, poor, or 1 where there is no rating."""
    return F.when(F.col("_quality") > 0, good).when(F.col("_quality") == 0, poor).otherwise(1.0)


def rated_sizes(docs: DataFrame, rated: DataFrame, good: float, poor: float) -> DataFrame:
    """sized docs with _weight by rated (_rated, _quality; a row a document)."""
    slim = sized(docs.select("doc_id", "source", "text"))
    return slim.join(small_side(settled(rated), MAX_RATED), F.col("doc_id") == F.col("_rated"), "left").withColumn("_weight", rating_weight(good, poor))


def repeated(docs: DataFrame, rated: DataFrame | None = None, good: float = 1.0, poor: float = 1.0, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, 0 drops it; columns of docs only.

    The fractional epoch of a source is all that comes before a cut in key order, so each
    row finds its copies from its own key and a table of one row a source; texts do not
    move (but where ratings are too many to broadcast).  Nulls as in `mixed`; a row that
    repeats the one at the cut is taken with it.  Names of columns are free.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    if rated is not None:
        plain = plain.join(small_side(settled(rated), MAX_RATED), F.col(inner["doc_id"]) == F.col("_rated"), "left")
    rows = sized(plain.select("*", *[F.col(inner[c]).alias(c) for c in ("doc_id", "source", "text")]))
    weight = None if rated is None else rating_weight(good, poor)
    place = F.struct("key", "doc_id", "whole")
    cuts = _taken(settled(_keyed(rows, weight, seed)), weights, share, cap).groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(F.col("extra"), place)).alias("_cut"))
    cuts = settled(cuts.withColumnRenamed("source", "_from"))
    w = F.lit(1.0) if weight is None else weight
    keyed = rows.withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / w)
    out = keyed.join(small_side(cuts, MAX_SOURCES), F.col("source").eqNullSafe(F.col("_from")))
    copies = F.col("_epochs") + F.when(place <= F.col("_cut"), 1).otherwise(0)
    out = out.withColumn("_copies", copies.cast("int")).where("_copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()])


def digest(docs: DataFrame, rated: DataFrame, good: float, poor: float) -> DataFrame:
    """doc_id, size, source_size, target, taken; rated (_rated, _quality) gives documents their weight."""
    return mixed_sizes(rated_sizes(docs, rated, good, poor), F.col("_weight")).select("doc_id", "size", "source_size", "target", "taken")
