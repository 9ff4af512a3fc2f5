"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score) with rising thresholds and one weight
vector over hashed text features shared by all grades.  Features are words, word
prefixes and bucketed shape figures of the text.  Only features whose document counts
differ between grades by `min_z` standard deviations get a weight, so the many
features of a long clean text do not add up to noise.

The fit sees a bounded sample, `fit_rows` labelled documents (the first by a hash of
the id); everything else reads all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstep.llm import _bytes as B
from lumenstep.llm._common import over_texts, settled, small_side

GRADES = 3
#: Hash space of the features; its last SHAPES places hold the shape figures.
SPACE, SHAPES = 1 << 18, 256
PREFIXES = (0, 3, 4, 5)
FIT_ROWS = 8000
MIN_Z, MIN_DOCS, MAX_FEATURES = 8.0, 4, 50_000

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MARK = ~_ALNUM & ~B.SPACE


def _features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a block of texts; wanted: mask of features to keep."""
    n, low = len(offs) - 1, B.LOWER[data]
    starts, ends, row = B.tokens(low, offs, _ALNUM)
    words, length = np.bincount(row, minlength=n), np.diff(offs)
    keys = []
    for size in PREFIXES:
        long = ends - starts >= size
        s, r = starts[long], row[long]
        h = B.span_hash(low, s, s + size if size else ends[long])
        f = ((B.mix(h + np.uint64(size)) >> np.uint64(20)) % np.uint64(SPACE - SHAPES)).astype(np.int64)
        if wanted is not None:
            r, f = r[wanted[f]], f[wanted[f]]
        keys.append(r * SPACE + f)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    _, unlike = B.distinct(B.span_hash(low, starts, ends), row)

    def per_row(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(member)])
        return sums[offs[1:]] - sums[offs[:-1]]

    share = lambda a, b: np.minimum(15, a * 16 // np.maximum(b, 1)).astype(np.int64)
    size = np.minimum(5, np.log2(words / 8 + 1)).astype(np.int64)
    shapes = [
        size * 16 + share(np.bincount(unlike, minlength=n), words),
        96 + share(2 * per_row((data >= 65) & (data <= 90)), length),
        128 + share(4 * per_row(_MARK[low]), length),
        160 + np.minimum(31, np.log2(words + 1)).astype(np.int64),
    ]
    rows = np.concatenate([key // SPACE, *[np.arange(n)] * len(shapes)])
    found = np.concatenate([key % SPACE, *[SPACE - SHAPES + s for s in shapes]])
    return rows, found, np.concatenate([np.log1p(count), np.ones(n * len(shapes))])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SPACE * GRADES, np.int64)
    for batch in batches:
        grade = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, _, data, offs in B.blocks(batch.column(1)):
            row, f, _ = _features(data, offs, None)
            total += np.bincount(f * GRADES + grade[lo + row], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at // GRADES), pa.array((at % GRADES).astype(np.int64)), pa.array(total[at])], names=["feature", "grade", "n"])


def _sparse_rows(wanted: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in B.blocks(batch.column(1)):
                row, f, value = _features(data, offs, wanted)
                order = np.argsort(row, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(cuts, pa.array(x[order]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(f.astype(np.int32)), lists(value.astype(np.float32))], names=["grade", "feature", "value"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(row: np.ndarray, f: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the class-balanced log likelihood."""
    n, w = len(grade), np.zeros(size)
    gap = np.array([-2.0] + [0.0] * (GRADES - 2))  # first threshold, then logs of the steps up
    first, second = np.zeros(size + len(gap)), np.zeros(size + len(gap))
    balance = (n / GRADES / np.maximum(np.bincount(grade, minlength=GRADES), 1))[grade] ** 0.5
    at = np.arange(n)
    for t in range(1, steps + 1):
        cuts = gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])
        score = np.bincount(row, w[f] * value, minlength=n)
        below = np.column_stack([np.zeros(n), _sigmoid(cuts[None, :] - score[:, None]), np.ones(n)])
        low, high = below[at, grade], below[at, grade + 1]
        dlow, dhigh, p = low * (1 - low), high * (1 - high), np.maximum(high - low, 1e-12)
        by_score = (dhigh - dlow) / p * balance
        by_cut = np.array([(np.where(grade == k + 1, dlow, 0) - np.where(grade == k, dhigh, 0)) @ (balance / p) / n for k in range(GRADES - 1)])
        by_gap = np.array([by_cut.sum(), *[by_cut[k:].sum() * np.exp(gap[k]) for k in range(1, GRADES - 1)]])
        slope = np.concatenate([(np.bincount(f, by_score[row] * value, minlength=size) + ridge * w) / n, by_gap])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, gap = w - step[:size], gap - step[size:]
    return w, gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])


@dataclass
class OrdinalModel:
    """weights: one per feature of the hash space (fixed size); cuts: rising thresholds."""

    weights: np.ndarray
    cuts: np.ndarray

    def score(self, docs: DataFrame) -> DataFrame:
        """docs plus expected_grade and tail_probability (of the top grade), which replace columns of
        these names; a null text counts as empty."""
        names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]
        weights, cuts, wanted = self.weights, self.cuts, self.weights != 0
        text_at = names.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.zeros(batch.num_rows)
                for lo, hi, data, offs in B.blocks(batch.column(text_at)):
                    row, f, value = _features(data, offs, wanted)
                    score[lo:hi] = np.bincount(row, weights[f] * value, minlength=hi - lo)
                above = _sigmoid(score[:, None] - cuts[None, :])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, -1])], names=[*batch.schema.names, "expected_grade", "tail_probability"])

        plain = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names])
        schema = plain.select("*", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability")).schema
        return over_texts(plain, run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good; the lowest where a document is rated twice."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), F.when(F.col("quality") > 0, 2).otherwise(1))
    return labels.select(F.col("doc_id").alias("_rated"), grade.cast("long").alias("grade")).where("_rated is not null and grade is not null").groupBy("_rated").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, min_z: float = MIN_Z, ridge: float = 0.3, steps: int = 200) -> OrdinalModel:
    """Fit on at most fit_rows rated documents; without any, weights are 0 and all score alike."""
    sample = graded(labels).orderBy(F.xxhash64("_rated"), "_rated").limit(fit_rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    rated = settled(texts.join(small_side(settled(sample), fit_rows), F.col("_id") == F.col("_rated")).select("grade", "text"))
    counts = over_texts(rated, _document_counts, "feature long, grade long, n long").groupBy("feature", "grade").agg(F.sum("n").alias("n"))
    sizes = {r.grade: r["count"] for r in rated.groupBy("grade").count().collect()}
    n = sum(sizes.values())
    total = counts.groupBy("feature").agg(F.sum("n").alias("df"), *[F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in range(GRADES - 1)])
    zs = [F.abs(F.col(f"g{g}") - F.col("df") * p) / F.sqrt(F.col("df") * (p * (1 - p)) + 1e-9) for g in range(GRADES - 1) if 0 < (p := sizes.get(g, 0) / max(n, 1)) < 1]
    weights, cuts = np.zeros(SPACE), np.arange(GRADES - 1) - (GRADES - 1.0)
    if not zs:
        return OrdinalModel(weights, cuts)
    best = F.greatest(*zs) if len(zs) > 1 else zs[0]
    telling = total.where((F.col("df") >= MIN_DOCS) & (best >= min_z)).orderBy(best.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
    wanted = np.zeros(SPACE, bool)
    wanted[[r.feature for r in telling]] = True
    wanted[SPACE - SHAPES :] = True
    table = over_texts(rated, _sparse_rows(wanted), "grade long, feature array<int>, value array<float>").toArrow()
    grade = table["grade"].to_numpy()
    lists = [table[c].combine_chunks() for c in ("feature", "value")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    row = np.repeat(np.arange(len(grade)), lists[0].value_lengths().to_numpy())
    places = np.flatnonzero(wanted)
    f = np.searchsorted(places, lists[0].flatten().to_numpy())
    w, cuts = _descend(row, f, lists[1].flatten().to_numpy().astype(float), grade, len(places), ridge, steps)
    weights[places] = w
    return OrdinalModel(weights, cuts)


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs with a tail probability of at least `least`; columns of docs only, whatever their names.

    A null text is judged as an empty one, repeated rows fare alike, null ids match no rating.
    """
    inner = {c: "text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = fit(docs, labels, **options).score(docs.toDF(*inner.values()))
    return judged.where(F.col("tail_probability") >= least).select(*inner.values()).toDF(*docs.columns)
