"""Language-model scores: context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each with its own tree over the preceding bytes, down
to `depth` of them.  A node holds zero and one counts; its Krichevsky-Trofimov estimate and
its children's weighted probability are mixed half and half, bottom up.  A prediction
walks down from the root with the resulting posterior weights, so all depths take part.

Training counts the grams of all training documents, a byte after its context, as 64-bit
keys.  Keys travel in arrays, a row for each bucket of contexts and flush of a task: a shuffle
of single keys costs more than all arithmetic on them.  Nodes below TOP bytes of context are
worked out where all grams of one such context lie together, those above as DataFrame
aggregations; every gram met gets its probability.  Scoring is a sum over a text's grams, and
over its words for the unigram base score.  Keys that are frequent enough for a bounded table
(`max_tokens`, `max_grams`) are looked up in a broadcast; the rest of a document's keys meets
its values bucket by bucket after a shuffle, so the model may grow with the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstep.llm import _bytes as B
from lumenstep.llm._common import over_texts, settled

#: Depth of the registered query; a context and its byte fit a signed 64-bit key up to MAX_DEPTH.
DEPTH, MAX_DEPTH = 6, 6
#: Bytes of context by which grams are dealt out, and rows worked on at once.
TOP, CHUNK = 3, 300_000
#: Buckets of gram keys, by their nearest TOP bytes; tokens have as many after these.  A row's arrays hold LONGEST entries at most.
BUCKETS, LONGEST = 4096, 100_000
END = np.uint64(0x1234567887654321)
#: Broadcast entries at most: of tokens and of grams, whose rare ones are joined.
MAX_TOKENS, MAX_GRAMS = 100_000, 2_000_000
#: Keys a task counts, and unsettled keys it holds, before it passes them on.
FLUSH, WANTS = 8_000_000, 500_000
ALPHA = 0.1
LOG2_10 = 3.321928094887362


def held_out(doc_id: int | None) -> bool:
    """Documents whose crc32 of the id as text ends on 0 are not learned from (null: as empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _keys(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys with rows (an end per row), gram keys with the place of each row's first (`depth` zero bytes before, one after).

    The byte is a gram's lowest, its context stands above it, the nearest byte highest, so
    grams that share a nearer context are neighbours.
    """
    n = len(offs) - 1
    words, row = B.word_hashes(data, offs)
    words, row = np.concatenate([words, np.full(n, END)]).view(np.int64), np.concatenate([row, np.arange(n)])
    # each row: depth zero bytes, its bytes, one zero byte; eight more behind all for the last reads
    first = offs[:-1] + np.arange(n) * (depth + 1)
    text, gram = np.ones(len(data) + n * (depth + 1), bool), np.ones(len(data) + n * (depth + 1), bool)
    for j in range(depth):
        text[first + j] = gram[first + j] = False
    text[offs[1:] + np.arange(1, n + 1) * (depth + 1) - 1] = False
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)][text] = B.LOWER[data]
    # the depth bytes before a place are the low bytes of the little-endian integer that starts there
    grams = np.ndarray(len(text), "<i8", padded, strides=(1,))[: max(0, len(text) - depth)] & ((1 << 8 * depth) - 1)
    grams <<= 8
    grams |= padded[depth : len(text)]
    return words, row, grams[gram[depth:]], offs[:-1] + np.arange(n)


def _bucket(keys: np.ndarray, depth: int) -> np.ndarray:
    """The bucket of each gram: equal for equal contexts of TOP bytes."""
    near = (keys >> (8 * (depth - min(TOP, depth) + 1))).view(np.uint64)
    return (B.mix(near * B.MULT) % np.uint64(BUCKETS)).astype(np.uint16)


def _token_bucket(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(BUCKETS) + np.uint64(BUCKETS)).astype(np.uint16)


def _packed(bucket: np.ndarray, **columns: np.ndarray | pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Buckets and arrays of their entries, for columns as long as `bucket`."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    starts = np.union1d(starts, np.arange(0, len(bucket), LONGEST))
    ends = pa.array(np.append(starts, len(bucket)).astype(np.int32))
    taken = {k: c.take(pa.array(order)) if isinstance(c, pa.Array) else pa.array(c[order]) for k, c in columns.items()}
    return bucket[starts].astype(np.int32), {k: pa.ListArray.from_arrays(ends, c) for k, c in taken.items()}


def _batch(schema: str, rows: int, /, **columns) -> pa.RecordBatch:
    """Rows of a schema, null where no column is given."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    made = [pa.nulls(rows, types[t]) if columns.get(k) is None else c if isinstance(c := columns[k], pa.Array) else pa.array(c, types[t]) for k, t in fields]
    return pa.RecordBatch.from_arrays(made, names=[k for k, _ in fields])


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """All entries of an array column."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    sizes = pc.binary_length(column) if pa.types.is_binary(column.type) else column.value_lengths()
    return sizes.fill_null(0).to_numpy(zero_copy_only=False)


def _joined(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Integers from the columns of their bytes, lowest first."""
    out = np.zeros((int(_sizes(batch, names[0]).sum()), 8), np.uint8)
    for i, name in enumerate(names):
        column = batch.column(name)
        offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]
        out[:, i] = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return out.reshape(-1).view("<i8")


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


#: Partial counts by byte: bytes of one place are much alike among the keys of a bucket, so a shuffle of these is half as long.
_KEY, _N = [f"key{i}" for i in range(8)], [f"n{i}" for i in range(5)]
_PARTS = ", ".join(["bucket int", *(f"{c} binary" for c in _KEY + _N)])
_COUNTS = "bucket int, keys array<long>, n array<long>"


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Partial counts; every gram of any document is listed, if with n = 0."""
    tokens, grams, filled = [], np.empty(FLUSH, np.int64), 0

    def out(bucket: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bytes_of = lambda x, names: {c: x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, i] for i, c in enumerate(names)}
        bucket, lists = _packed(bucket, **bytes_of(keys, _KEY), **bytes_of(n, _N))
        binary = {c: pa.Array.from_buffers(pa.binary(), len(x), [None, x.buffers()[1], x.values.buffers()[1]]) for c, x in lists.items()}
        return _batch(_PARTS, len(bucket), bucket=bucket, **binary)

    def of_tokens() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(tokens), return_counts=True)
        tokens.clear()
        return out(_token_bucket(keys), keys, n)

    def of_grams(every: np.ndarray) -> pa.RecordBatch:
        every.sort()
        learned = (every & 1 ^ 1).astype(np.int32)
        every >>= 1
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        keys = every[first]
        return out(_bucket(keys, depth), keys, np.add.reduceat(learned, first))

    for batch in batches:
        held = np.array([held_out(i) for i in batch.column(0).to_pylist()], np.int64)
        for lo, hi, data, offs in B.blocks(batch.column(1)):
            words, wrow, found, _ = _keys(data, offs, depth)
            tokens.append(words[held[lo:hi][wrow] == 0])
            found <<= 1  # the lowest bit tells held out from learned
            found |= np.repeat(held[lo:hi], np.diff(offs) + 1)
            if filled and filled + len(found) > FLUSH:
                yield of_grams(grams[:filled])
                filled = 0
            if len(found) > FLUSH:
                yield of_grams(found)
                continue
            grams[filled : filled + len(found)] = found
            filled += len(found)
            if sum(map(len, tokens)) > FLUSH // 4:
                yield of_tokens()
    if filled:
        yield of_grams(grams[:filled])
    if tokens:
        yield of_tokens()


def _log_gamma(x: str) -> str:
    """SQL for ln gamma(x), x > 0: Stirling's series after eight steps up."""
    y = f"({x} + 8D)"
    steps = " * ".join(f"({x} + {i}D)" for i in range(8))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.9189385332046727!r}D + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5)) - ln({steps}))"


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov estimate, by the series of _log_gamma."""

    def log_gamma(x: np.ndarray) -> np.ndarray:
        y, steps = x + 8, np.ones_like(x)
        for i in range(8):
            steps = steps * (x + i)
        return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)

    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 1.1447298858494002 - log_gamma(n0 + n1 + 1)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Rows of batches sorted by bucket, CHUNK entries of column `by` at a time, cut only where the bucket changes."""
    held, n, want = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        n += int(_sizes(batch, by).sum())
        if n < want:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bucket = rows.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
        n = int(_sizes(held[0], by).sum())
        want = max(CHUNK, 2 * n)
    if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rows.to_batches()[0]


def _levels(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Bits of rising grams, the place of their nodes among the deepest, and (nodes, parents' places, n0, n1, weighted, stay) from depth to top.

    A node is its context << 8 | the bits of the byte so far; nodes at `top` rise.  A gram with
    n = 0 adds nodes that change nothing: their weighted log is 0 and their estimate is a half.
    """
    byte, context = keys & 255, keys & ~255
    bit, inverse, parts, count = np.empty((len(keys), 8), bool), np.empty((len(keys), 8), np.int64), [], 0
    for k in range(8):
        node = context | (1 << k) | (byte >> (8 - k))  # rises with the keys
        fresh = np.ones(len(keys), bool)
        fresh[1:] = node[1:] != node[:-1]
        bit[:, k] = (byte >> (7 - k)) & 1
        inverse[:, k] = np.cumsum(fresh) + (count - 1)
        parts.append(node[fresh])
        count += len(parts[-1])
    nodes = np.concatenate(parts)
    if depth == top:
        order = np.argsort(nodes)
        nodes, place = nodes[order], np.empty(count, np.int64)
        place[order] = np.arange(count)
        inverse = place[inverse]
    times = np.repeat(n.astype(float), 8).reshape(bit.shape)
    n0, n1 = (np.bincount(inverse.ravel(), (times * x).ravel(), count) for x in (~bit, bit))
    weighted, stay, out = _kt(n0, n1), np.ones(count), []
    for _ in range(depth - top):
        up, parent = np.unique((nodes >> 16 << 8) | (nodes & 255), return_inverse=True)
        out.append((nodes, parent, n0, n1, weighted, stay))
        n0, n1, kids = (np.bincount(parent, x, len(up)) for x in (n0, n1, weighted))
        own, nodes = _kt(n0, n1), up
        weighted, stay = np.logaddexp(own, kids) - np.log(2), 1 / (1 + np.exp(np.minimum(700, kids - own)))
    return bit, inverse, [*out, (nodes, None, n0, n1, weighted, stay)]


def _summed(depth: int, top: int) -> Callable:
    """Whole counts from partial ones sorted by bucket, and the nodes at `top` with all below them weighed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, _KEY[0]):
            keys, n = _joined(rows, _KEY), _joined(rows, _N)
            token = np.repeat(rows.column("bucket").to_numpy() >= BUCKETS, _sizes(rows, _KEY[0]))
            for of, place in ((token, _token_bucket), (~token, lambda x: _bucket(x, depth))):
                k, m = _merged(keys[of], n[of])
                if not len(k):
                    continue
                at, lists = _packed(place(k), keys=k, n=m)
                yield _batch(_NODES, len(at), bucket=at, **lists)
                if of is token:
                    continue
                nodes, _, n0, n1, weighted, stay = _levels(k, m, depth, top)[2][-1]
                at = _bucket(nodes >> 8 << (8 * (depth - top + 1)), depth).astype(np.int32)
                yield _batch(_NODES, len(at), bucket=at, c=nodes >> 8, u=(nodes & 255).astype(np.int32), n0=n0, n1=n1, weighted=weighted, stay=stay)

    return run


_NODES = f"{_COUNTS}, c long, u int, n0 double, n1 double, weighted double, stay double"
_VALUES = f"{_COUNTS}, value array<double>"


def _leaves(depth: int, top: int) -> Callable:
    """Values of the grams, from them and the mixtures that reach their nodes at `top`, sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "keys"):
            keys, n = _flat(rows, "keys"), _flat(rows, "n")
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            entry = rows.filter(rows.column("u").is_valid())
            c, u, known, rest = (entry.column(x).to_numpy() for x in ("c", "u", "known", "rest"))
            order = np.argsort(c << 8 | u)
            known, rest = known[order], rest[order]
            bit, inverse, levels = _levels(keys, n, depth, top)
            for _, parent, n0, n1, _, stay in reversed(levels):
                if parent is not None:
                    known, rest = known[parent], rest[parent]
                known, rest = known + rest * stay * (n1 + 0.5) / (n0 + n1 + 1), rest * (1 - stay)
            one = known[inverse]
            at, lists = _packed(_bucket(keys, depth), keys=keys, n=n, value=np.log10(np.where(bit, one, 1 - one)).sum(axis=1))
            yield _batch(_VALUES, len(at), bucket=at, **lists)

    return run


def _near(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket", *order)


def gram_scores(table: DataFrame, depth: int) -> DataFrame:
    """bucket, keys, n, value (arrays): log10 probability of the last byte after its context, for the grams and nodes of _summed."""
    top = min(TOP, depth)
    levels = {top: table.where("u is not null").withColumnRenamed("c", f"c{top}").drop("keys", "n")}
    kt = f"({_log_gamma('(n0 + 0.5D)')} + {_log_gamma('(n1 + 0.5D)')} - {1.1447298858494002!r}D - {_log_gamma('(n0 + n1 + 1D)')})"
    for d in range(top - 1, -1, -1):
        up = levels[d + 1].withColumn(f"c{d}", F.shiftright(f"c{d + 1}", 8))
        node = up.groupBy(f"c{d}", "u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("kids")).withColumn("own", F.expr(kt))
        both = f"(greatest(own, kids) + ln(1D + exp(-abs(own - kids))) - {0.6931471805599453!r}D)"
        levels[d] = settled(node.withColumn("weighted", F.expr(both)).withColumn("stay", F.expr("1D / (1D + exp(least(700D, kids - own)))")).drop("own", "kids"))
    # top down: `known` is the mixture of the depths so far, `rest` the weight left for deeper ones
    chance = "(n1 + 0.5D) / (n0 + n1 + 1D)"
    way = settled(levels[0].selectExpr("c0", "u", f"stay * {chance} as known", "1D - stay as rest"))
    for d in range(1, top):
        node = levels[d].withColumn(f"c{d - 1}", F.shiftright(f"c{d}", 8))
        reach = node.join(way, [f"c{d - 1}", "u"]).selectExpr(f"c{d}", "u", f"known + rest * stay * {chance} as known", "rest * (1D - stay) as rest")
        way = settled(reach)
    entry = levels[top].withColumn(f"c{top - 1}", F.shiftright(f"c{top}", 8)).join(way, [f"c{top - 1}", "u"])
    entry = entry.selectExpr("bucket", "null as keys", "null as n", f"c{top} as c", "u", "known", "rest")
    grams = table.where(f"u is null and bucket < {BUCKETS}")
    both = grams.selectExpr("bucket", "keys", "n", "null as c", "null as u", "null as known", "null as rest").union(entry)
    return _near(both).mapInArrow(_leaves(depth, top), _VALUES)


class _Table:
    """Keys and their values side by side, found by open addressing; -1 marks a free place, so a key of -1 is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.zeros((1 << bits, 2), np.int64)
        self.slots[:, 0] = -1
        at, values = self._place(keys), values.view(np.int64)
        while len(keys):
            free = self.slots[at, 0] == -1
            self.slots[at[free], 0] = keys[free]
            mine = self.slots[at, 0] == keys
            self.slots[at[mine], 1] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * B.MULT) >> self.shift).view(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none, and whether there is one."""
        at = self._place(wanted)
        have = self.slots.take(at, axis=0)
        hit = have[:, 0] == wanted
        value = have[:, 1].copy()
        missed = np.flatnonzero(~hit)
        value[missed] = 0
        left = missed[have[missed, 0] != -1]
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            have = self.slots.take(at[left], axis=0)
            ok = have[:, 0] == wanted[left]
            hit[left[ok]], value[left[ok]] = True, have[ok, 1]
            left = left[~ok & (have[:, 0] != -1)]
        return value.view(np.float64), hit


#: Rows of the join of keys with values: in a bucket values come first.
VALUE, WANT, DOC = 0, 1, 2
_ROW = "bucket int, kind int, docs array<long>, wholes array<long>, keys array<long>, n array<long>, known array<long>, bytes array<long>, base array<double>, score array<double>"
_DOC = "doc_id long, whole long, times long, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def _score(tables, depth: int) -> Callable:
    """What the tables settle of each text, and the keys of each text that they do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, grams_of = (_Table(*t) for t in tables.value)
        wants, held = [], 0

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([w[0] for w in wants])
            whole, bucket, keys, times = (np.concatenate(x) for x in list(zip(*wants))[1:])
            wants.clear()
            at, lists = _packed(bucket, docs=ids, wholes=whole, keys=keys, n=times)
            return _batch(_ROW, len(at), bucket=at, kind=np.full(len(at), WANT, np.int32), **lists)

        for batch in batches:
            for lo, hi, data, offs in B.blocks(batch.column(1)):
                n = hi - lo
                words, wrow, grams, first = _keys(data, offs, depth)
                whole = B.span_hash(data, offs[:-1], offs[1:]).view(np.int64)
                value, hit = words_of.find(words)
                g, ghit = grams_of.find(grams)
                ids = batch.column(0).slice(lo, n)
                sums = {"n": np.bincount(wrow, minlength=n), "known": np.bincount(wrow[hit], minlength=n), "bytes": np.diff(offs).astype(np.int64)}
                sums |= {"base": np.bincount(wrow, value, minlength=n), "score": np.add.reduceat(g, first)}
                at, lists = _packed(np.full(n, int(whole[0]) % BUCKETS, np.uint16), docs=ids, wholes=whole, **sums)
                yield _batch(_ROW, len(at), bucket=at, kind=np.full(len(at), DOC, np.int32), **lists)
                missed = np.flatnonzero(~ghit)
                for kind, keys, rows in ((0, words[~hit], wrow[~hit]), (1, grams[missed], np.searchsorted(first, missed, "right") - 1)):
                    if len(keys):
                        order = np.lexsort((keys, rows))
                        keys, rows = keys[order], rows[order]
                        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
                        times = np.diff(np.concatenate([new, [len(keys)]]))
                        keys, rows = keys[new], rows[new]
                        wants.append((ids.take(pa.array(rows)), whole[rows], _bucket(keys, depth) if kind else _token_bucket(keys), keys, times))
                        held += len(keys)
                if held > WANTS:
                    yield out()
                    held = 0
        if wants:
            yield out()

    return run


def _met(unseen: float) -> Callable:
    """Sums of each text, from rows of _ROW sorted by bucket and kind; a text may have several."""

    def doc_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = _flat(batch, "wholes")
        columns = {"n_tokens": "n", "n_known": "known", "n_bytes": "bytes", "base_score": "base", "score": "score"}
        return _batch(_DOC, len(whole), doc_id=batch.column("docs").flatten(), whole=whole, times=np.ones(len(whole), np.int64), **{k: _flat(batch, c) for k, c in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None  # bucket, key and value of what the last bucket may still ask for
        for batch in batches:
            bucket, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            part = {k: batch.filter(pa.array(kind == k)) for k in (VALUE, WANT, DOC)}
            if part[DOC].num_rows:
                yield doc_rows(part[DOC])
            if part[VALUE].num_rows or have is None:
                b, k, v = np.repeat(bucket[kind == VALUE], _sizes(part[VALUE], "keys")), _flat(part[VALUE], "keys"), _flat(part[VALUE], "score")
                if have is not None:
                    b, k, v = (np.concatenate(x) for x in zip(have, (b, k, v)))
                order = np.argsort(k)
                have = b[order], k[order], v[order]
            if part[WANT].num_rows:
                yield wanted(part[WANT], bucket[kind == WANT], have)
            if len(have[0]) and (have[0] != bucket[-1]).any():
                have = tuple(x[have[0] == bucket[-1]] for x in have)

    def wanted(rows: pa.RecordBatch, bucket: np.ndarray, have: tuple) -> pa.RecordBatch:
        ids, whole, keys, n = rows.column("docs").flatten(), _flat(rows, "wholes"), _flat(rows, "keys"), _flat(rows, "n")
        token = np.repeat(bucket >= BUCKETS, _sizes(rows, "keys"))
        value, known = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for kind in (True, False):
            asked, mine = token == kind, (have[0] >= BUCKETS) == kind
            value[asked], known[asked] = _lookup(have[1][mine], have[2][mine], keys[asked])
        value[token & ~known] = unseen
        base, score = np.where(token, n * value, 0.0), np.where(token, 0.0, n * value)
        # entries of a text side by side; texts whose hashes fall together stay apart
        doc = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(B.mix(whole.view(np.uint64) + doc.view(np.uint64) * B.MULT))
        doc, null, whole = doc[order], ids.is_null().to_numpy(zero_copy_only=False)[order], whole[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (whole[1:] != whole[:-1])]))
        add = lambda x: np.add.reduceat(x[order], first)
        none = np.zeros(len(first), np.int64)
        sums = {"n_known": add(np.where(token & known, n, 0)), "base_score": add(base), "score": add(score)}
        return _batch(_DOC, len(first), doc_id=pa.array(doc[first], mask=null[first]), whole=whole[first], times=none, n_tokens=none, n_bytes=none, **sums)

    return run


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


def _frequent(counts: list, max_rows: int) -> int:
    """The least count n from which at most max_rows keys are left, from rows (n, count)."""
    found, left = 0, 0
    for r in sorted(counts, key=lambda r: -r.n):
        left += r["count"]
        if left > max_rows:
            return r.n + 1
        found = r.n
    return found


MOST = 100_000


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(MOST + 1, np.int64)
    for batch in batches:
        found += np.bincount(np.minimum(_flat(batch, "n"), MOST), minlength=MOST + 1)
    n = np.flatnonzero(found)
    yield _batch("n long, count long", len(n), n=n, count=found[n])


def _often(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _flat(batch, "n") >= least
            yield _batch("key long, value double", int(keep.sum()), key=_flat(batch, "keys")[keep], value=_flat(batch, "value")[keep])

    return run


def _pull(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = table.select("key", "value").toArrow()
    return got["key"].to_numpy(), got["value"].to_numpy()


def scored(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_grams: int = MAX_GRAMS, depth: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for each row of docs.

    Texts are A-Z lower-cased, null counts as empty; tokens are words without white space
    and one end.  score is the log10 probability of the text's bytes and its end under the
    trees of `depth`; bits_per_byte is their code length, spread over the bytes and the end.  Rows with equal doc_id and text score alike.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = _near(over_texts(rows, partial(_count, depth=depth), _PARTS))
    table = settled(parts.mapInArrow(_summed(depth, min(TOP, depth)), _NODES))
    tokens = table.where(f"u is null and bucket >= {BUCKETS}").selectExpr("bucket", "inline(arrays_zip(keys, n))").withColumnRenamed("keys", "key")
    total, vocabulary = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = total + ALPHA * (vocabulary + 1)
    of_token = F.log10((F.col("n") + ALPHA) / F.lit(floor))
    tokens = tokens.select("bucket", "key", "n", of_token.alias("value"))
    grams = settled(gram_scores(table, depth))
    common = _frequent(tokens.groupBy(F.least("n", F.lit(MOST)).alias("n")).count().collect(), max_tokens)
    often = _frequent(grams.mapInArrow(_histogram, "n long, count long").groupBy("n").agg(F.sum("count").alias("count")).collect(), max_grams)
    spark = docs.sparkSession
    frequent = tokens.where(F.col("n") >= common), grams.mapInArrow(_often(often), "key long, value double")
    tables = spark.sparkContext.broadcast(tuple(_pull(t) for t in frequent))
    named = [x.split(" ") for x in _ROW.split(", ")]
    as_rows = lambda df, **of: df.select(*[F.expr(of.get(k, "null")).cast(t).alias(k) for k, t in named])
    values = as_rows(tokens.where(F.col("n") < common), bucket="bucket", kind=f"{VALUE}", keys="array(key)", score="array(value)")
    values = values.union(as_rows(grams, bucket="bucket", kind=f"{VALUE}", keys="keys", score="value"))
    met = _near(over_texts(rows, _score(tables, depth), _ROW).union(values), "kind").mapInArrow(_met(math.log10(ALPHA / floor)), _DOC)
    per = met.groupBy("doc_id", "whole").agg(*[F.sum(c).alias(c) for c in ("times", "n_tokens", "n_bytes", "n_known", "base_score", "score")])
    each = lambda c: F.expr(f"{c} div times")
    return per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
        each("n_tokens").alias("n_tokens"),
        each("n_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("times")).alias("base_score"),
        (F.col("score") / F.col("times")).alias("score"),
        each("n_bytes").alias("n_bytes"),
        (F.col("score") * -LOG2_10 / (F.col("n_bytes") + F.col("times"))).alias("bits_per_byte"),
    )
