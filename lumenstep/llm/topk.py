"""Exact top-k search by no-random-access aggregation.

A block of rows is kept as sorted lists, one for each dimension.  For a query each list is
read sequentially from the end that serves it, all lists down to one level of contribution
at a time.  What was read of a row is summed; where a list was not read as far as the row,
its contribution lies between the list's worst one and the level.  That gives a lower and
an upper bound of each row's score.  At each level the leaders so far are resolved, so the
k-th best score known, also from earlier blocks, is close to the final one.  Reading stops
once few rows can still reach it or the k-th best lower bound; only their scores are
resolved in full, and the rest of the lists is never read.

Queries are a bounded broadcast, released after their pass over the rows; the results of a
pass are written before the next begins.  Blocks are independent, so rows spread over any
number of tasks and each gives k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.llm._common import settled

K, SCALE = 10, 1024.0
BLOCK = 16_384
#: Queries of a pass, at most: what is broadcast is bounded by this times the dimensions.
PASS_QUERIES = 20_000
#: Rows that may be left when reading stops, k times this or this share of the block; leaders resolved at each level, k times this.
SPARE, SPARE_SHARE, LEADERS = 4, 1 / 8, 4
#: Levels as shares of the best contribution; the last ones are only needed where bounds stay wide.
LEVELS = (0.4, 0.2, 0.1, 0.05, 0.02, 0.0, -0.02, -0.05, -0.1, -0.3, -np.inf)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>, floor(1024 * x)) of rows with an id and only finite components."""
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull()
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


class Lists:
    """The sorted lists of a block: values and rows of each dimension, rising."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.rows = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(np.ascontiguousarray(x.T), self.rows.astype(np.int64), axis=1)

    def best(self, q: np.ndarray, own: int, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The k best ids and scores of this block and those known before; entries read and rows resolved."""
        n, used = len(self.x), np.flatnonzero(q)
        worst = np.minimum(q * self.values[:, 0], q * self.values[:, -1])
        level = np.maximum(q * self.values[:, 0], q * self.values[:, -1]).max(initial=0.0)
        top, done, read = level, np.zeros(len(q), np.int64), 0
        seen, count, least = np.zeros(n), np.full(n, len(used)), np.full(n, worst.sum())
        mine, resolved = self.ids == own, np.zeros(n, bool)
        for share in LEVELS:
            level = top * share if top > 0 or share < 0 else 0.0
            rows, gains, lows = [], [], []
            for d in used:
                c = q[d]
                if c > 0:
                    upto = n - (int(np.searchsorted(self.values[d], level / c)) if level > -np.inf else 0)
                    part = slice(n - max(upto, done[d]), n - done[d])
                else:
                    upto = int(np.searchsorted(self.values[d], level / c, "right")) if level > -np.inf else n
                    part = slice(done[d], max(upto, done[d]))
                if part.stop > part.start:
                    rows.append(self.rows[d, part])
                    gains.append(c * self.values[d, part])
                    lows.append(np.full(part.stop - part.start, worst[d]))
                    done[d] += part.stop - part.start
            if rows:
                rows, gains = np.concatenate(rows), np.concatenate(gains)
                read += len(rows)
                seen += np.bincount(rows, gains, n)
                least += np.bincount(rows, gains - np.concatenate(lows), n)
                count -= np.bincount(rows, minlength=n)
            upper = seen + np.where(count > 0, count * level, 0.0) if level > -np.inf else seen
            lower = np.where(mine, -np.inf, least)
            lead = np.argpartition(seen, n - LEADERS * k)[n - LEADERS * k :] if n > LEADERS * k else np.arange(n)
            lead = lead[~mine[lead] & ~resolved[lead]]
            resolved[lead] = True
            ids, scores = _keep(np.concatenate([ids, self.ids[lead]]), np.concatenate([scores, self.x[lead] @ q]), k)
            bound = max(scores[-1] if len(ids) == k else -np.inf, np.partition(lower, n - k)[n - k] if n > k else -np.inf)
            can = np.flatnonzero((upper + 1e-9 * np.abs(upper) >= bound) & ~mine & ~resolved)
            if len(can) <= max(SPARE * k, n * SPARE_SHARE):
                break
        ids, scores = _keep(np.concatenate([ids, self.ids[can]]), np.concatenate([scores, self.x[can] @ q]), k)
        return ids, scores, read, int(resolved.sum()) + len(can)


def _keep(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], scores[order]


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted length as a matrix, and which they are."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(fits), dims), fits


def _joined(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about BLOCK rows: matrix and ids."""
    held, n = [], 0
    for batch in batches:
        x, fits = _matrix(batch.column(1), dims)
        ids = batch.column(0).to_numpy(zero_copy_only=False)[fits]
        for lo in range(0, len(x), BLOCK):
            held.append((x[lo : lo + BLOCK], ids[lo : lo + BLOCK]))
            n += len(held[-1][0])
            if n >= BLOCK:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _search(queries, dims: int, k: int, counts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = queries.value
        best = [[np.zeros(0, np.int64), np.zeros(0)] for _ in matrix]
        for x, ids in _joined(batches, dims):
            lists = Lists(x, ids)
            for i, (qid, q) in enumerate(zip(query_ids, matrix)):
                *best[i], read, scored = lists.best(q, qid, k, *best[i])
                counts[0].add(read)
                counts[1].add(scored)
                counts[2].add(x.size)
        sizes = np.array([len(h) for h, _ in best], np.int64)
        if sizes.sum():
            columns = np.repeat(query_ids, sizes), np.concatenate([h for h, _ in best]), np.concatenate([s for _, s in best])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pass_queries: int = PASS_QUERIES, reading: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each of queries (vec_id, v).

    Both hold integer-valued components as `usable` returns them, whose sums must stay below
    2**53.  A row is compared with queries of its own length only and never with a query of
    its own id; equal scores go by the smaller vec_id.  Rows that repeat a vec_id count once
    (they must be equal); repeated queries are answered once.  No rows or no queries give an
    empty result.  `reading` gets the list entries read, the rows resolved and the entries there were.
    """
    spark = vectors.sparkSession
    queries = settled(queries.select("vec_id", "v").dropDuplicates(["vec_id"]).withColumn("dims", F.size("v")))
    counts, parts = [spark.sparkContext.accumulator(0) for _ in range(3)], []
    for r in queries.groupBy("dims").count().orderBy("dims").collect():
        passes = -(-r["count"] // pass_queries)
        for turn in range(passes):
            mine = queries.where((F.col("dims") == r.dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn)).select("vec_id", "v").toArrow()
            matrix, fits = _matrix(mine["v"].combine_chunks(), r.dims)
            shared = spark.sparkContext.broadcast((mine["vec_id"].to_numpy()[fits], matrix))
            found = vectors.where(F.size("v") == r.dims).select("vec_id", "v").mapInArrow(_search(shared, r.dims, k, counts), "query_id long, vec_id long, score long")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
            parts.append(settled(found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
            shared.destroy()
    if reading is not None:
        reading |= dict(zip(("read", "resolved", "all"), (c.value for c in counts)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.union, parts)
