"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings one edit away: each deletion, each
replacement and each insertion of a letter of the observed alphabet.  Those that are words
themselves are its near words, found by a hash join with the vocabulary; no distance is
ever computed.  A word's form is its most frequent near word, if that is frequent enough;
following forms leads to its root.

Neighbours are made as 64-bit keys from prefix and suffix hashes, so a word of n letters
costs n times the alphabet and not n times more, and a bitmap of the vocabulary's keys drops
most of them at once.  What passes is joined by key and compared as text, so equal keys of
different texts do no harm.

A null text has no words, a null doc_id counts as empty, each of repeated rows counts, words
of any length are treated alike, ties go to the smallest word; empty tables have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.llm._bytes import MULT, mix
from lumenstep.llm._common import ascii_lower, over_texts, settled

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
LEAD = 2
#: One in so many occurrences loses a letter.
SLIP = 97
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the vocabulary's bitmap for each word, and at most (16 MB).
BITS_PER_WORD, MAX_BITS = 64, 1 << 27
#: Positions whose neighbours are made at once.
POSITIONS = 1 << 14


def slipped(docs: DataFrame) -> DataFrame:
    """(word) of each run of letters of documents (doc_id, text), A-Z lower-cased, some short of a letter."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = run.where(F.length("run") >= MIN_LENGTH).select("id", ascii_lower(F.col("run")).alias("run"))
    run = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return run.select(F.when(F.col("h") % SLIP == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words (word) that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    """BASE to the power 0 to n - 1, modulo 2^64."""
    steps = np.full(max(n, 1), BASE, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Letters:
    """A block of words as code points, with the hash of what lies before and from each place on.

    The hash of letters x1 ... xn is the sum of xi * BASE^(n-i), modulo 2^64.
    """

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(self.length)])
        self.power = _powers(int(self.length.max(initial=0)) + 2)
        size = len(codes) + len(words)  # one place more in each word: its end
        #: Of each place: its word, its place in the word, its letter (0 at the end), the letter before (0 at the start).
        self.word = np.repeat(np.arange(len(words)), self.length + 1)
        self.at = np.arange(size) - (first[:-1] + np.arange(len(words)))[self.word]
        self.rest = self.length[self.word] - self.at
        self.code = np.zeros(size, np.uint64)
        self.code[self.rest > 0] = codes
        self.prior = np.where(self.at > 0, np.concatenate([[np.uint64(0)], self.code[:-1]]), np.uint64(0))
        # sums of x * BASE^rest over whole blocks, then differences within the word
        weighed = np.concatenate([[np.uint64(0)], np.cumsum(self.code * self.power[np.maximum(self.rest - 1, 0)], dtype=np.uint64)])
        starts = (first[:-1] + np.arange(len(words)))[self.word]
        ends = starts + self.length[self.word]
        #: before: of the letters before the place, weighed as in the whole word; after: hash from the place on.
        self.before = weighed[np.arange(size)] - weighed[starts]
        self.after = weighed[ends] - weighed[np.arange(size)]

    def keys(self) -> np.ndarray:
        whole = self.at == 0
        return key(self.after[whole], self.length)


def key(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(hashes + length.astype(np.uint64) * MULT).view(np.int64)


def neighbours(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (key, word index, place, letters dropped there, code point put there or 0): each distinct neighbour once.

    Dropping any of equal letters in a row gives one string, as does putting a letter before
    or after its equal: the leftmost place stands for all.
    """
    x = Letters(words)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    for lo in range(0, len(x.word), POSITIONS):
        at = np.arange(lo, min(lo + POSITIONS, len(x.word)))
        length, rest = x.length[x.word[at]], x.rest[at]
        inside = rest > 0
        next_after = x.after[at] - x.code[at] * x.power[np.maximum(rest - 1, 0)]
        put = lambda drop, letters, i, hashes, size: (key(hashes, size), x.word[at[i]], x.at[at[i]], np.full(len(i), drop, np.int32), letters)
        i = np.flatnonzero(inside & (x.code[at] != x.prior[at]))
        yield put(1, np.zeros(len(i), np.int32), i, x.before[at[i]] * inverse + next_after[i], length[i] - 1)
        i, c = np.nonzero(inside[:, None] & (x.code[at][:, None] != alphabet[None, :]))
        yield put(1, alphabet[c].astype(np.int32), i, x.before[at[i]] + next_after[i] + alphabet[c] * x.power[rest[i] - 1], length[i])
        i, c = np.nonzero(x.prior[at][:, None] != alphabet[None, :])
        yield put(0, alphabet[c].astype(np.int32), i, x.before[at[i]] * BASE + x.after[at[i]] + alphabet[c] * x.power[rest[i]], length[i] + 1)


def keyed(vocab: DataFrame) -> DataFrame:
    """vocab (word, n) with the key of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(Letters(b.column(0).to_pylist()).keys())], ["word", "n", "key"])

    return over_texts(vocab.select("word", "n"), run, "word string, n long, key long")


def _bitmap(vocab: DataFrame, n: int) -> np.ndarray:
    """One bit for each key modulo a power of two; at most MAX_BITS bits reach the driver."""
    bits = min(MAX_BITS, max(64, 1 << ceil(log2(max(1, n * BITS_PER_WORD)))))
    slot = F.col("key").bitwiseAND(bits - 1)
    cells = vocab.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
    found = cells.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words of vocab (word, n) one edit apart."""
    vocab = settled(keyed(vocab))
    spark = vocab.sparkSession
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    # the letters of words: as many as the pattern of words allows
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint64)
    known = spark.sparkContext.broadcast(_bitmap(vocab, vocab.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value
        for b in batches:
            words = b.column(0).to_pylist()
            for keys, word, at, drop, code in neighbours(words, alphabet) if words else ():
                slot = keys & (len(bitmap) * 64 - 1)
                ok = np.flatnonzero((bitmap[slot >> 6] >> (slot & 63)) & 1)
                word = pa.array(word[ok])
                columns = [b.column(0).take(word), b.column(1).take(word), pa.array(keys[ok]), pa.array(at[ok].astype(np.int32)), pa.array(drop[ok]), pa.array([chr(c) if c else "" for c in code[ok].tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "key", "at", "drop", "letter"])

    made = over_texts(vocab.select("word", "n"), run, "word string, n long, key long, at int, drop int, letter string")
    text = F.concat(F.substr("word", F.lit(1), F.col("at")), "letter", F.substr("word", F.col("at") + F.col("drop") + 1))
    met = made.join(vocab.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    return met.where(text == F.col("near")).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form), by doubling the steps; counts at least double along a chain, so `most` bounds it."""
    at = settled(forms.select("word", F.col("form").alias("root")))
    for _ in range(ceil(log2(max(2, log2(max(2, most)))))):
        further = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        at = settled(at.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")))
    return at


def variants(vocab: DataFrame, lead: float = LEAD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of vocab (word, n): one row for each word."""
    vocab = settled(vocab.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(vocab).groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    led: Column = -F.col("best.less") >= lead * F.col("n")
    out = settled(
        vocab.join(near, F.col("word") == F.col("_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.less")).cast("long").alias("form_n"),
        )
    )
    most = out.agg(F.max("n")).first()[0] or 1
    roots = _roots(out.where("form is not null"), most).select(F.col("word").alias("_word"), "root")
    return out.join(roots, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
