"""K-d tree sharding of documents.

A node splits at the weighted median (weights: bytes) of the metadata dimension that is
widest in it, until a leaf holds the bytes wanted.  A place on a dimension is a 52-bit
number, the value's cell in the upper 20 bits and a hash of the row below, so equal values
can be split too and a hot source is no obstacle.  All nodes of a level are split by two
histograms of sums, aggregated before they are shuffled.  The driver sees a few numbers
for each node, never rows; the cuts go back into the plan as literal arrays, by which each
row walks down the tree on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.llm._common import running_sum, settled

CELL, TIE = 20, 32
HALF = 16
SEGMENT = 8
SLOT_BUCKETS = 12
MAX_LONG = (1 << 63) - 1
#: A leaf adds some twenty bytes to the plan; 100 TB in leaves of a GB are 100,000.
MAX_SHARDS = 1 << 17


def _hash_cell(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.shiftrightunsigned(F.xxhash64(c), 64 - CELL))


def _description(c: dict[str, Column]) -> list[Column]:
    """size, tie and a cell for each dimension from the columns doc_id, text, source, lang."""
    size = (F.octet_length(F.coalesce(c["text"], F.lit(""))) + 1).cast("long")
    return [
        size.alias("size"),
        F.shiftrightunsigned(F.xxhash64(c["doc_id"], c["text"], F.lit(11)), 64 - TIE).alias("tie"),
        _hash_cell(c["source"]).alias("d0"),
        _hash_cell(c["lang"]).alias("d1"),
        F.least(F.log2(size) / 40 * (1 << CELL), F.lit((1 << CELL) - 1)).cast("long").alias("d2"),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, whole, text_crc32, size, tie and dimensions of docs (doc_id, text, source, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64("text").alias("whole"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *_description({k: F.col(k) for k in ("doc_id", "text", "source", "lang")}),
    )


def _numbers(values: list[int]) -> Column:
    """A literal array of longs; as one text it is quick to hand over and folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _place(dim: Column) -> Column:
    return F.shiftleft(F.when(dim == 0, F.col("d0")).when(dim == 1, F.col("d1")).otherwise(F.col("d2")), TIE) + F.col("tie")


def _node(levels: list[dict[int, tuple[int, int]]]) -> Column:
    """The node a described row falls into, below the cuts of each level: {node: (dimension, cut)}.

    The children of node n are 2n + 1 and 2n + 2; a node without a cut hands all rows to the first.
    """
    node = F.lit(0).cast("long")
    if not levels:
        return node
    steps = []
    for k, cuts in enumerate(levels):
        first = (1 << k) - 1
        flat = [cuts.get(n, (0, MAX_LONG)) for n in range(first, 2 * first + 1)]
        steps.append(F.struct(F.lit(first).alias("first"), _numbers([d for d, _ in flat]).alias("dim"), _numbers([c for _, c in flat]).alias("cut")))

    def down(at: Column, step: Column) -> Column:
        k = (at - step["first"]).cast("int")
        return 2 * at + F.when(_place(step["dim"][k]) >= step["cut"][k], 2).otherwise(1)

    return F.aggregate(F.array(*steps), node, down)


def _by_node(nodes: dict[int, int], first: int, other: int = MAX_LONG) -> Column:
    """A number for each node of the level that begins at `first`."""
    return F.get(_numbers([nodes.get(n, other) for n in range(first, 2 * first + 1)]), (F.col("node") - first).cast("int"))


def _crossing(rows: DataFrame) -> dict[int, tuple[int, int, int]]:
    """node: (b, sum before, sum in it) of the first bucket b at which the sum along the node exceeds its goal.

    Sums of segments are followed along a node first, then the buckets of the one segment
    that crosses: at most 2**(HALF - SEGMENT) and 2**SEGMENT rows a node meet in a task,
    whatever the number of rows.  The side broadcast has a row a node, at most MAX_SHARDS.
    """
    sums = rows.groupBy("node", "goal", "b").agg(F.sum("size").alias("s")).withColumn("segment", F.shiftright("b", SEGMENT))

    def first(parts: DataFrame, at: str, start: Column) -> DataFrame:
        along = Window.partitionBy("node").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        over = parts.withColumn("upto", start + F.sum("s").over(along)).where("goal < upto")
        return over.groupBy("node").agg(F.min(F.struct(F.col(at).alias("at"), (F.col("upto") - F.col("s")).alias("before"), "s")).alias("x"))

    crossed = first(sums.groupBy("node", "goal", "segment").agg(F.sum("s").alias("s")), "segment", F.lit(0)).select("node", F.col("x.at").alias("segment"), F.col("x.before").alias("start"))
    return {r.node: (r.x.at, r.x.before, r.x.s) for r in first(sums.join(F.broadcast(crossed), ["node", "segment"]), "b", F.col("start")).collect()}


def tree(base: DataFrame, shards: int) -> tuple[list[dict[int, tuple[int, int]]], dict[int, int]]:
    """The cuts of each level and the shard of each leaf, for described rows.

    The driver holds a few numbers for each node; three jobs a level find the cuts.
    """
    if shards > MAX_SHARDS:
        raise ValueError(f"at most {MAX_SHARDS} shards: the cuts are part of the plan")
    dims, low = ["d0", "d1", "d2"], CELL + TIE - HALF
    leaves, levels, whole = {0: (0, shards)}, [], None  # node: first shard, number of shards
    while any(n > 1 for _, n in leaves.values()):
        first = (1 << len(levels)) - 1
        state = base.withColumn("node", _node(levels))
        facts = state.groupBy("node").agg(F.sum("size").alias("size"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
        whole = whole or {d: max([1, *[r[d] for r in facts]]) for d in dims}
        dim, goal = {}, {}
        for r in facts:
            n = leaves[r.node][1]
            if n > 1:
                width = [r[d] / whole[d] for d in dims]
                dim[r.node], goal[r.node] = width.index(max(width)), r["size"] * (n // 2) // n
        open_ = state.withColumn("goal", _by_node(goal, first)).where(F.col("goal") < MAX_LONG).withColumn("place", _place(_by_node(dim, first, 0)))
        one = _crossing(open_.withColumn("b", F.shiftright("place", low)))
        fine = open_.where(F.shiftright("place", low) == _by_node({n: x[0] for n, x in one.items()}, first)).withColumn("goal", F.col("goal") - _by_node({n: x[1] for n, x in one.items()}, first, 0))
        cuts = {}
        for node, (b, before, mass) in _crossing(fine.withColumn("b", F.shiftright("place", low - HALF))).items():
            over = goal[node] - one[node][1] - before > mass / 2
            cuts[node] = (dim[node], (b + over) << (low - HALF))
        following = {}
        for node, (at, n) in leaves.items():
            following |= {2 * node + 1: (at, n // 2), 2 * node + 2: (at + n // 2, n - n // 2)} if n > 1 else {2 * node + 1: (at, 1)}
        leaves = following
        levels.append(cuts)
    return levels, {k: v[0] for k, v in leaves.items()}


def _shard(levels: list[dict[int, tuple[int, int]]], numbered: dict[int, int]) -> Column:
    """The shard of a described row."""
    first = (1 << len(levels)) - 1
    return F.get(_numbers([numbered.get(n, -1) for n in range(first, 2 * first + 1)]), (_node(levels) - first).cast("int")).cast("int")


def _leaves(base: DataFrame, shards: int | None, target_bytes: int | None) -> tuple[list[dict[int, tuple[int, int]]], dict[int, int]]:
    if shards is None:
        total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    return tree(base, shards)


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, whole, size, text_crc32, shard, slot for each row of docs.

    shards: number of leaves; else as many as leaves of target_bytes need.  Leaves hold
    near equal bytes.  A null text has size 1, the others their UTF-8 bytes plus 1; null
    dimensions count as a value.  Equal texts may lie in different shards.  An empty table
    gives an empty result.  slot counts the rows of a shard from 0 without a gap.  Rows that
    repeat both doc_id and text cannot be parted, so a shard may exceed its bytes by them.
    """
    base = settled(described(docs))
    levels, numbered = _leaves(base, shards, target_bytes)
    rows = base.withColumn("shard", _shard(levels, numbered)).withColumn("bucket", F.shiftright("tie", TIE - SLOT_BUCKETS).cast("int"))
    return running_sum(rows, ["shard"], "bucket", [F.col("tie"), F.col("doc_id"), F.col("whole")], F.lit(1), "slot").select("doc_id", "whole", "size", "text_crc32", "shard", F.col("slot").cast("long"))


def placed(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """docs with the column shard (replaced where docs has one); texts are not shuffled.

    The tree is found on sizes and dimensions only and then applied row by row.  Nulls, ties,
    repeated rows and empty tables as in `sharded`; other columns may have any names.
    """
    docs = docs.drop("shard")
    levels, numbered = _leaves(settled(described(docs)), shards, target_bytes)
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    known = {c: F.col(i) for i, c in zip(inner, docs.columns)}
    whole = plain.select("*", *_description(known))
    out = whole.withColumn("_shard", _shard(levels, numbered))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)], F.col("_shard").alias("shard"))


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    return sharded(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
