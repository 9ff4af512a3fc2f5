"""Prefix trie of conversations by an LCP-aware mergesort.

A turn becomes a symbol of 20 bytes: 128 bits of a SHA-256 of role and text, and the text's
length in UTF-8.  A conversation is its symbols in a row; equal conversations are counted
first, so a group of copies is one sequence.  Sequences are dealt out by ranges of their
order, which no common beginning can upset, as distinct ones can be told apart somewhere.
Within a task, sorted runs carry the common prefix (LCP) of each sequence with the one
before; a tree of losers merges them and compares only past what two contenders are known to
share with the last winner.  Of the merged stream a stack holds the open path; a node is
finished when the path leaves it.

Nodes on the first and last path of a task may go on in another task.  Their sums so far
(at most two paths a task) go through one more pass in the order of the ranges, a stack
again.  Children of such nodes take the node's name from there.

Order of turns: by turn (null first), then role, then text; null role and text are empty.
Rows without conv_id belong to no conversation.  Repeated rows are turns of their own.  An
empty table has no nodes.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.llm._common import over_texts, settled, small_side

SYMBOL = 20
#: A conversation repeats up to eight turns of the first of its group of five.
GROUP, HEADS = 5, 9
TURNS_PER_BUCKET, IDS_PER_CHUNK = 256, 4096
#: Rows of a run; bytes of sequences meant for a task.
RUN_ROWS, TASK_BYTES = 2048, 16 << 20
MAX_BROADCAST = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, symbols binary): each conversation's turns in order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    hashed = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.concat(hashed, F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0")).alias("symbol"),
        F.floor(F.col("turn") / TURNS_PER_BUCKET).cast("long").alias("bucket"),
    )
    within = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "bucket", F.row_number().over(within).alias("place"), "symbol")
    line = lambda items, what: F.array_join(F.transform(F.array_sort(items), lambda x: x[what]), "")
    pieces = placed.groupBy("conv_id", "bucket").agg(line(F.collect_list(F.struct("place", "symbol")), "symbol").alias("piece"))
    return pieces.groupBy("conv_id").agg(F.unhex(line(F.collect_list(F.struct("bucket", "piece")), "piece")).alias("symbols"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, symbols) with the first h turns of the group's first conversation in place of its own first h."""
    heads = convs.select(F.col("conv_id").alias("_head"), F.expr(f"substring(symbols, 1, {SYMBOL * (HEADS - 1)})").alias("head"))
    own = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("_head"), "left")
    head = F.coalesce(F.expr(f"substring(head, 1, {SYMBOL} * h)"), F.unhex(F.lit("")))
    return met.select("conv_id", F.concat(head, F.expr(f"substring(symbols, {SYMBOL} * h + 1)")).alias("symbols"))


def _hashed_ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sequence, ends_sha256) of chunks sorted by sequence and place; only one hash is open."""
    name, state = None, None
    for part in parts:
        done = []
        for sequence, chunk in zip(part["sequence"], part["chunk"], strict=True):
            if sequence == name:
                state.update(b"," + chunk.encode())
                continue
            if state is not None:
                done.append((name, state.hexdigest()))
            name, state = sequence, hashlib.sha256(chunk.encode())
        yield pd.DataFrame(done, columns=["sequence", "ends"])
    if state is not None:
        yield pd.DataFrame([(name, state.hexdigest())], columns=["sequence", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(symbols, n, first, ends) of (conv_id, symbols): each sequence with its number of conversations, the smallest, and the digest of all."""
    convs = convs.withColumn("sequence", F.sha2("symbols", 256))
    chunks = convs.groupBy("sequence", F.floor(F.col("conv_id") / IDS_PER_CHUNK).alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("chunk")
    )
    ends = chunks.repartition("sequence").sortWithinPartitions("sequence", "place").select("sequence", "chunk").mapInPandas(_hashed_ends, "sequence string, ends string")
    counted = convs.groupBy("symbols").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return counted.withColumn("sequence", F.sha2("symbols", 256)).join(ends, "sequence").select("symbols", "n", "first", "ends")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Symbols that a and b share at their start, at least `known`."""
    most = min(len(a), len(b)) // SYMBOL
    while known < most and a[known * SYMBOL : (known + 1) * SYMBOL] == b[known * SYMBOL : (known + 1) * SYMBOL]:
        known += 1
    return known


class Run:
    """Sorted rows, each with its LCP with the row before."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows)
        self.lcp = [0, *(common(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:]))]
        self.at = 0

    @property
    def row(self) -> tuple | None:
        return self.rows[self.at] if self.at < len(self.rows) else None


def merged(runs: list[Run]) -> Iterator[tuple[int, tuple]]:
    """(LCP with the row before, row) of all runs in order, by a tree of losers.

    shared[i]: LCP of run i's next row with the winner it lost to, or with the last winner
    for runs on the way up.  More of it means a smaller row; only equals are compared, and
    only past it.
    """
    k = len(runs)
    shared, loser = [0] * k, [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs whose shared is against the same row."""
        x, y = runs[a].row, runs[b].row
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        same = common(x[0], y[0], shared[a])
        past = slice(same * SYMBOL, (same + 1) * SYMBOL)
        a, b = (a, b) if x[0][past] <= y[0][past] else (b, a)
        shared[b] = same
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while k and (row := runs[winner].row) is not None:
        yield shared[winner], row
        run = runs[winner]
        run.at += 1
        shared[winner] = run.lcp[run.at] if run.row is not None else 0
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


class Open:
    """A node on the open path, with sums over what is finished below it."""

    __slots__ = ("symbol", "first", "convs", "children", "leaves", "saved", "ends", "border", "waiting", "names")

    def __init__(self, symbol: bytes, border: bool = False):
        self.symbol, self.border, self.first, self.ends = symbol, border, None, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.waiting: list[list] = []  # finished children, who lack only this node's smallest member
        self.names: list[tuple] = []

    def add(self, first: int | None, convs: int, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None) -> None:
        if first is not None:
            self.first = first if self.first is None else min(self.first, first)
        self.convs, self.children, self.leaves, self.saved = self.convs + convs, self.children + children, self.leaves + leaves, self.saved + saved
        self.ends = ends or self.ends

    def finish(self, depth: int) -> list:
        """The node's row, parent left open."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.convs - 1) * int.from_bytes(self.symbol[16:], "big")
        return [self.first, depth, None, self.convs, self.children, self.leaves, self.saved, self.ends or NO_ENDS]

    def take(self, child: Open, row: list) -> None:
        self.add(child.first, child.convs, 1, child.leaves, child.saved)
        self.waiting.append(row)


#: Of a task's output: nodes of known parent have no side; nodes below a border node have the task, side and depth
#: of that node; border nodes have kind 'sum', their symbol and sums without what is below other border nodes.
PARTIAL = f"{NODE}, kind string, task int, side int, at int, symbol binary"
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in PARTIAL.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _task_nodes(rows: Iterator[tuple[int, tuple]], task: int) -> Iterator[list]:
    """Rows as in PARTIAL of one task's sorted sequences."""
    path: list[Open] = []

    def closed() -> Iterator[list]:
        node, depth = path.pop(), len(path)
        if node.border:
            yield from border(node, depth, 0)
            return
        row = node.finish(depth)
        for child in node.waiting:
            yield [*child[:2], node.first, *child[3:], "node", None, None, None, None]
        path[-1].take(node, row)

    def border(node: Open, depth: int, side: int) -> Iterator[list]:
        yield [node.first, depth, None, node.convs, node.children, node.leaves, node.saved, node.ends, "sum", task, side, depth, node.symbol]
        for child in node.waiting:
            yield [*child, "node", task, side, depth, None]

    for lcp, (symbols, n, first, ends) in rows:
        opening = not path
        while len(path) > lcp + 1:
            yield from closed()
        for d in range(len(path), len(symbols) // SYMBOL + 1):
            path.append(Open(symbols[(d - 1) * SYMBOL : d * SYMBOL] if d else bytes(SYMBOL), opening))
        path[-1].add(first, n, ends=ends)
    while path:
        node, depth = path.pop(), len(path)
        yield from border(node, depth, 0 if node.border else 1)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: list[Run] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, RUN_ROWS):
            runs.append(Run(list(zip(*(c.to_pylist() for c in batch.slice(lo, RUN_ROWS).columns), strict=True))))
    some: list[list] = []
    for row in _task_nodes(merged(runs), TaskContext.get().partitionId()):
        some.append(row)
        if len(some) >= RUN_ROWS:
            yield _batch(some)
            some = []
    yield _batch(some)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border nodes in order of tasks, sides and depths: their rows, and the smallest member by (task, side, at) as kind 'name'."""
    path: list[Open] = []
    matching = True

    def closed() -> Iterator[list]:
        node, depth = path.pop(), len(path)
        row = node.finish(depth)
        for child in node.waiting:
            yield [*child[:2], node.first, *child[3:], "node", None, None, None, None]
        for name in node.names:
            yield [node.first, *[None] * 7, "name", *name, None]
        if path:
            path[-1].take(node, row)
        else:
            yield [*row, "node", None, None, None, None]

    for batch in batches:
        out: list[list] = []
        for first, depth, _, convs, children, leaves, saved, ends, _, task, side, at, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            matching |= depth == 0
            if not (side == 0 and matching and depth < len(path) and path[depth].symbol == symbol):
                matching = False
                while len(path) > depth:
                    out += closed()
                path.append(Open(symbol))
            path[depth].add(first, convs, children, leaves, saved, ends)
            path[depth].names.append((task, side, at))
        yield _batch(out)
    out = []
    while path:
        out += closed()
    yield _batch(out)


def trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of (conv_id, symbols), columns as in NODE."""
    distinct = settled(distinct_sequences(convs))
    spark = distinct.sparkSession
    total = distinct.agg(F.sum(F.octet_length("symbols") + 100)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    made = settled(over_texts(distinct.repartitionByRange(tasks, "symbols"), _tries, PARTIAL))
    sums = made.where("kind = 'sum'").repartition(1).sortWithinPartitions("task", "side", "at")
    border = settled(over_texts(sums, _stitched, PARTIAL))
    names = border.where("kind = 'name'").select(F.col("conv_id").alias("_name"), "task", "side", "at")
    nodes = made.where("kind = 'node'")
    hung = nodes.where("task is not null").join(small_side(names, MAX_BROADCAST), ["task", "side", "at"]).withColumn("parent_conv_id", F.col("_name"))
    columns = [x.split()[0] for x in NODE.split(", ")]
    return nodes.where("task is null").select(columns).union(hung.select(columns)).union(border.where("kind = 'node'").select(columns))
