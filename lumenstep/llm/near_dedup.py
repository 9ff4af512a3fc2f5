"""MinHash near-duplicates with tensored banding and exact verification.

Two small collections of K groups of R minhashes are computed per document.  A band
is a pair of one group from each collection, so 2*K*R minhash evaluations serve K*K
bands of 2*R rows; flat banding would need K*K*2*R of them.  A pair of similarity s
is missed with probability near 2 * (1 - s**R)**K: 5e-4 at s = 0.75 and below 1e-5
from 0.84 up, with the defaults.

Candidates are confirmed on the full shingle sets.  Work per bucket stays linear:

1. documents with equal sets fold into one representative;
2. every member of a bucket is checked against the bucket's leader;
3. only buckets whose members are still in different components compare pairs, there
   only pairs across components, each where it first shares a group of the one collection
   and any of the other, and of those only pairs whose coarse and fine sketches could
   reach the threshold.

No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.llm import _bytes as B
from lumenstep.llm._common import over_texts, settled, small_side
from lumenstep.llm.graph import components

GROUPS, ROWS, SHINGLE = 10, 2, 5
#: Threshold as a fraction, 100 * intersection >= 75 * union.
PART, OF = 75, 100
#: Sketch bins, seven one-byte bins to a long so that sums never overflow.
BINS, PER = 126, 7
SIGMAS = 6.0
#: The fine sketch, made only for members of buckets that stay mixed; it loses 3e-7 of the links right at the threshold.
FINE_BINS, FINE_SIGMAS = 1008, 5.0
MAX_BROADCAST_IDS = 1_000_000
#: A document in more pairs than this is compared in several tasks.
HOT_PAIRS = 128

_SIGNATURE = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
)
_SIGNATURE_DDL = "doc_id long, n_shingles long, d1 long, d2 long, a array<long>, b array<long>, sketch array<long>"


def _row_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, row = B.word_hashes(data, offs)
    return B.distinct(*B.shingles(words, row, len(offs) - 1, SHINGLE))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _sketch(h: np.ndarray, row: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One byte a bin (0: empty) of the least hash in it, seven bins to a long."""
    none = np.iinfo(np.uint64).max
    g = B.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(n * bins, none, np.uint64)
    np.minimum.at(least, row * bins + (g >> np.uint64(32)).astype(np.int64) % bins, g)
    marks = np.where(least == none, np.uint64(0), np.uint64(1) + (least & np.uint64(0xFFFFFFF)) % np.uint64(255))
    shifts = np.uint64(8) * np.arange(PER, dtype=np.uint64)
    return (marks.reshape(n, bins // PER, PER) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in B.blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(_sketch(*_row_sets(data, offs), hi - lo, FINE_BINS))], names=["node", "fine"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_hash = 2 * GROUPS * ROWS
    odd = B.mix(np.arange(1, n_hash + 1, dtype=np.uint64) * B.MULT) | np.uint64(1)
    tag = B.mix(np.arange(1, 2 * GROUPS + 1, dtype=np.uint64) + np.uint64(977))
    for batch in batches:
        ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
        for lo, hi, data, offs in B.blocks(texts):
            n = hi - lo
            h, row = _row_sets(data, offs)
            count = np.bincount(row, minlength=n)
            salts = np.arange(1, 3, dtype=np.uint64) * B.MULT
            digests, groups = np.zeros((2, n), np.uint64), np.zeros((n, 2 * GROUPS), np.uint64)
            if len(h):
                full = np.flatnonzero(count)
                at = np.concatenate([[0], np.cumsum(count[full])[:-1]])
                for k in range(2):
                    digests[k, full] = np.add.reduceat(B.mix(h + salts[k]), at)
                for g in range(2 * GROUPS):
                    acc = np.zeros(len(full), np.uint64)
                    for r in range(ROWS):
                        acc = B.mix(acc * np.uint64(3) + np.minimum.reduceat(h * odd[g * ROWS + r], at))
                    groups[full, g] = B.mix(acc ^ tag[g])
            packed = _sketch(h, row, n, BINS)
            groups = groups.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n), pa.array(count.astype(np.int64)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), _lists(groups[:, :GROUPS]), _lists(groups[:, GROUPS:]), _lists(packed)],
                schema=_SIGNATURE,
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): set size, set digest, both minhash collections, sketch."""
    return over_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _signatures, _SIGNATURE_DDL)


_LOW, _ONE = (1 << 8 * PER) - 1, sum(0x7F << 8 * i for i in range(PER))


def _zeros(x: str) -> str:
    """SQL for the number of bytes of a long that are 0."""
    return f"bit_count(~(((({x}) & {_ONE}L) + {_ONE}L) | ({x}) | {_ONE}L) & {_LOW}L)"


def _allowed(bins: str, na: str, nb: str, sigmas: float) -> str:
    """SQL for the differing bins a pair at the threshold may show: used bins are a sample without replacement of its union."""
    p, union = 1 - PART / OF, f"({na} + {nb}) / {1 + PART / OF}D"
    return f"{p}D * {bins} + 1D + {sigmas * (p * (1 - p)) ** 0.5}D * sqrt({bins} * greatest(0D, ({union} - {bins}) / greatest(1D, {union} - 1D)))"


def could_match(sa: str, sb: str, na: str, nb: str) -> Column:
    """False only where sizes forbid the threshold or sketches miss it by SIGMAS deviations."""
    differ = " + ".join(f"({PER} - {_zeros(f'{sa}[{i}] ^ {sb}[{i}]')})" for i in range(BINS // PER))
    unused = " + ".join(_zeros(f"{sa}[{i}] | {sb}[{i}]") for i in range(BINS // PER))
    return F.expr(f"least({na}, {nb}) * {OF} >= greatest({na}, {nb}) * {PART} and ({differ}) <= {_allowed(f'({BINS} - ({unused}))', na, nb, SIGMAS)}")


def finely_match(fa: str, fb: str, na: str, nb: str) -> Column:
    """The same by the fine sketches, FINE_SIGMAS deviations."""
    total = lambda op: f"aggregate(zip_with({fa}, {fb}, (x, y) -> {_zeros(f'x {op} y')}), 0, (s, x) -> s + x)"
    return F.expr(f"exists(array({total('|')}), unused -> {FINE_BINS} - {total('^')} <= {_allowed(f'({FINE_BINS} - unused)', na, nb, FINE_SIGMAS)})")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            n = part.num_rows
            sides = []
            for c in (2, 3):
                (_, _, data, offs), = B.blocks(part.column(c), 1 << 62)
                sides.append(_row_sets(data, offs))
            size = sum(np.bincount(r, minlength=n) for _, r in sides)
            h, r = (np.concatenate(x) for x in zip(*sides))
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
            keep.append((both > 0) & (OF * both >= PART * (size - both)))
        mask = pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_())
        yield batch.select([0, 1]).filter(mask)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of doc_ids whose full shingle sets reach the threshold; a pair may be listed again.

    The pairs of a document in many of them are dealt out in parts, each with a copy of its
    text, so a large group of near copies does not meet in one task.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    hot = small_side(settled(ends.where(F.col("n") > HOT_PAIRS).select("id", F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("n"))), MAX_BROADCAST_IDS)
    dealt = pairs.select("u", "v")
    for end, other in (("u", "v"), ("v", "u")):
        parts = hot.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
        dealt = dealt.join(parts, end, "left").withColumn(f"p_{end}", F.coalesce(F.pmod(F.xxhash64(other), F.col(f"n_{end}")).cast("int"), F.lit(0)))
    need = dealt.select(F.explode(F.array(*[F.struct(F.col(e).alias("doc_id"), F.col(f"p_{e}").alias("part")) for e in "uv"])).alias("x")).select("x.*").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(small_side(settled(need), MAX_BROADCAST_IDS), "doc_id")
    texts = texts.repartition("doc_id", "part").dropDuplicates(["doc_id", "part", "text"])
    both = dealt
    for e in "uv":
        both = both.join(texts.select(F.col("doc_id").alias(e), F.col("part").alias(f"p_{e}"), F.col("text").alias(f"t_{e}")), [e, f"p_{e}"])
    return over_texts(both.select("u", "v", "t_u", "t_v"), _confirm, "u long, v long")


def _band_keys(reps: DataFrame) -> DataFrame:
    """(node, at_a, key) of each band of which at least two nodes share both groups."""
    rows = reps.select("node", F.posexplode(F.concat("a", "b")).alias("at", "value"))
    often = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    of = rows.join(often, "value").groupBy("node").agg(F.collect_set(F.struct("at", "value")).alias("groups"))
    half = lambda first: F.filter("groups", lambda g: (g["at"] < GROUPS) if first else (g["at"] >= GROUPS))
    bands = F.flatten(F.transform(half(True), lambda x: F.transform(half(False), lambda y: F.struct(x["at"].alias("at_a"), F.xxhash64(x["value"], y["value"]).alias("key")))))
    return of.select("node", F.explode(bands).alias("band")).select("node", "band.*")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    A-Z are lower-cased, words are runs without white space, the set holds the distinct
    five-word shingles (a shorter text: its whole word sequence).  Null or wordless texts
    have an empty set and link with nothing; rows with a null doc_id link with nothing,
    have a null component and are kept.  Rows that repeat doc_id and text get equal results;
    where one doc_id has several texts, a link of any of them is a link of the document and
    each row is grouped by its own text.  Other columns are not looked at.
    """
    sigs = settled(signatures(docs))
    reps = settled(
        sigs.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2", "n_shingles", "a", "b", "sketch")
        .agg(F.min("doc_id").alias("node"))
    )
    keys = settled(_band_keys(reps))
    leaders = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    shape = reps.select("node", "n_shingles", "sketch")
    ends = lambda k: shape.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    near = could_match("s_u", "s_v", "n_u", "n_v")

    stars = keys.join(leaders, "key").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    stars = settled(stars.join(ends("u"), "u").join(ends("v"), "v").where(near).select("u", "v"))
    links = settled(confirmed(stars, docs))
    first = components(links)

    of = settled(keys.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    members = settled(of.join(mixed, "key").groupBy("node").agg(F.min("component").alias("component"), F.collect_set("at_a").alias("ats")))
    fine = _fine_sketches(members.select("node"), docs)
    traits = settled(reps.select("node", "n_shingles", "sketch", "a", "b").join(fine, "node").join(members, "node"))
    # Dealt by the first half of the band: ten rows a node carry the sketches, not a hundred; the
    # other half is a condition.  Both sides have the same columns, so one exchange serves them.
    wide = traits.withColumn("at", F.explode("ats")).withColumn("key", F.expr("a[at]")).drop("ats")
    side = lambda s: wide.select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "node", "at", "component", "n_shingles", "sketch", "fine", "a", "b")])
    across = side("u").join(
        side("v"),
        (F.col("key_u") == F.col("key_v")) & (F.col("node_u") > F.col("node_v")) & (F.col("component_u") != F.col("component_v"))
        & could_match("sketch_u", "sketch_v", "n_shingles_u", "n_shingles_v")
        & ~F.arrays_overlap(F.slice("a_u", F.lit(1), F.col("at_u")), F.slice("a_v", F.lit(1), F.col("at_v"))) & F.arrays_overlap("b_u", "b_v")
        & finely_match("fine_u", "fine_v", "n_shingles_u", "n_shingles_v"),
    ).select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "component_u", "component_v")
    across = settled(across.join(stars, ["u", "v"], "left_anti"))
    component = F.coalesce("component", "node")
    of_set = reps.join(first, "node", "left").select("d1", "d2", "n_shingles", component.alias("_component"))
    if not across.isEmpty():
        # further links join whole components, so only their contraction is solved again
        more = settled(confirmed(across.select("u", "v"), docs)).join(across, ["u", "v"]).select(F.col("component_u").alias("u"), F.col("component_v").alias("v"))
        second = components(more).withColumnRenamed("node", "_component")
        of_set = of_set.join(second, "_component", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "_component").alias("_component"))
    return (
        sigs.select("doc_id", "n_shingles", "d1", "d2")
        .join(of_set, ["d1", "d2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _fine_sketches(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, fine) for the nodes, of which texts are read again."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(small_side(nodes, MAX_BROADCAST_IDS), "node", "left_semi")
    return over_texts(texts, _fine, "node long, fine array<long>").repartition("node").dropDuplicates(["node", "fine"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the documents of a near-duplicate group but its smallest doc_id; all columns stay.

    A doc_id with several texts goes if one of them is in a group with a smaller doc_id.
    Nulls, empty texts and repeats as in `near_duplicates`; names of columns are free.
    """
    gone = settled(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    left = docs.toDF(*inner.values())
    return left.join(small_side(gone, MAX_BROADCAST_IDS), F.col(inner["doc_id"]) == F.col("_gone"), "left_anti").toDF(*docs.columns)
