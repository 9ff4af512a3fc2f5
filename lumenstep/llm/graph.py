"""Connected components by alternating star contractions, all on DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstep.llm._common import settled, shared_dir, small_side

#: The least neighbour of a node with more links than this is broadcast to its links.
HOT_LINKS, MAX_BROADCAST_NODES = 128, 1_000_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m) of edges (u, v) and least (u, m, n links); the links of a hot node stay where they are.

    Hot nodes beyond MAX_BROADCAST_NODES are joined by a shuffle of two plain sides, which AQE can split.
    """
    hot = small_side(least.where(F.col("n") > HOT_LINKS).select("u", F.col("m").alias("hot")), MAX_BROADCAST_NODES)
    marked = edges.join(hot, "u", "left")
    few = marked.where("hot is null").join(least.where(F.col("n") <= HOT_LINKS), "u")
    return marked.where("hot is not null").select("u", "v", F.col("hot").alias("m")).union(few.select("u", "v", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settled(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _forest(edges: DataFrame) -> bool:
    """Whether each node has one link down at most and none of those linked to has one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or up = 1 and n > 1").isEmpty()


def _written(edges: DataFrame, folder: str) -> DataFrame:
    """The edges as a table in the folder: its size is that of its files.

    A checkpoint keeps the estimate of the plan it cuts, and the estimate of a join is the
    product of its sides.  From round to round that product would take the ninth power, in the
    end numbers of megabytes that fill the driver.
    """
    edges.write.parquet(folder)
    return edges.sparkSession.read.schema(edges.schema).parquet(folder)


def _drop(edges: DataFrame, folder: str) -> None:
    path = edges.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(edges.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of `edges` (u, v) that is not itself the smallest node reachable, its component.

    Self links and repeated links do no harm; null ends must not occur.
    A group of links never meets in one task: minima are pre-aggregated and broadcast to
    the links of hot nodes.  Each round is written to the shared folder; a round's table goes
    when the next one stands.
    """
    folder = f"{shared_dir(edges.sparkSession)}/components-{uuid.uuid4().hex}"
    edges = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/0")
    for k in range(max_rounds):
        if _forest(edges):
            found = settled(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
            _drop(edges, folder)
            return found
        following = _written(_small_star(_large_star(edges)), f"{folder}/{k + 1}")
        _drop(edges, f"{folder}/{k}")
        edges = following
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
