"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Benchmark items become windows of WINDOW words (a shorter item is one window).  A
training text is split into words once.  Each place is first tested on two bits of a hash
of its window's first, middle and last word, in a bitmap that every task holds (BITS a window, at
most MAX_BITS, so its size is bounded).  The few places that pass carry their whole window
into a join with the set of windows: a broadcast hash set up to MAX_WINDOWS of them, a
shuffled join of these places beyond.  Equal words decide, so a full bitmap costs time only.

The work stays in DataFrame expressions throughout; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.llm._common import ascii_lower, let, settled, small_side

WINDOW = 10
MAX_WINDOWS, MAX_DIRTY = 500_000, 1_000_000
BITS, MIN_BITS, MAX_BITS = 32, 1 << 12, 1 << 25
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """array<string> of words; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


def _joined(parts: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(parts, start, size), " ")


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n, gram, ends: distinct windows of each item with a hash of first, middle and last word."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    each = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    word = lambda at: F.element_at("w", F.col("i") + at.cast("int"))
    ends = F.xxhash64(word(F.lit(0)), word(F.floor(F.col("n") / 2)), word(F.col("n") - 1), "n")
    return each.select("item_id", "n", _joined(F.col("w"), F.col("i"), F.col("n")).alias("gram"), ends.alias("ends")).distinct()


def _bitmap(grams: DataFrame) -> tuple[list[int], str, int]:
    """The lengths of windows, the bitmap of their ends as SQL (array<long>) and its number of bits."""
    lengths = {r.n: r["count"] for r in grams.groupBy("n").count().collect()}
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS * sum(lengths.values())):
        bits *= 2
    at = F.explode(F.array(*[F.expr(p) for p in _probes("ends", bits)]))
    held = grams.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    filled = [0] * (bits // 64)
    for r in held.collect():
        filled[r.word] = r.bits
    return sorted(lengths), f"cast(split('{','.join(map(str, filled))}', ',') as array<bigint>)", bits


def _probes(ends: str, bits: int) -> list[str]:
    return [f"({ends} & {bits - 1}L)", f"(shiftrightunsigned({ends}, 32) & {bits - 1}L)"]


def _candidates(grams: DataFrame) -> Column:
    """array<struct<at, n, gram>> of the places in the array of words w that the bitmap passes; at counts from 1."""
    lengths, bitmap, bits = _bitmap(grams)
    parts = ["cast(array() as array<struct<at:int,n:int,gram:string>>)"]
    for n in lengths:
        tests = " and ".join(f"getbit({bitmap}[cast(shiftright({p}, 6) as int)], cast({p} & 63 as int)) = 1" for p in _probes("h", bits))
        passes = f"exists(array(xxhash64(w[i - 1], w[i - 1 + {n // 2}], w[i + {n - 2}], {n})), h -> {tests})"
        at = f"filter(sequence(1, size(w) - {n - 1}), i -> {passes})"
        parts.append(f"if(size(w) < {n}, {parts[0]}, transform({at}, i -> struct(i as at, {n} as n, array_join(slice(w, i, {n}), ' ') as gram)))")
    return F.expr(f"concat({', '.join(parts)})")


def _whole(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def hits(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc_id, whole, n_words), and the distinct hits (doc_id, whole, n_words, at, n, gram, item).

    whole is a hash of the text; doc_id and whole tie hits to rows, also where ids are null
    or repeated.  A null text has no words.  An empty benchmark has no hits.
    """
    known = settled(windows(benchmark))
    slim = docs.select("doc_id", "text").select("doc_id", _whole(F.col("text")).alias("whole"), words(F.col("text")).alias("w"))
    rows = settled(slim.select("doc_id", "whole", F.size("w").cast("long").alias("n_words"), _candidates(known.select("n", "ends").distinct()).alias("found")))
    maybe = rows.where(F.size("found") > 0).select("doc_id", "whole", "n_words", F.explode("found").alias("x")).select("doc_id", "whole", "n_words", "x.*")
    named = known.select("n", "gram", F.col("item_id").cast("string").alias("item"))
    return rows.drop("found"), maybe.join(small_side(named, max_windows), ["n", "gram"]).distinct()


def _marked(docs: DataFrame, benchmark: DataFrame, **options) -> tuple[dict[str, str], DataFrame]:
    """Inner names of docs' columns, and docs under them plus _words (null without a hit) and _places, the hit ones."""
    every = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))
    found = hits(docs, benchmark, **options)[1].select("doc_id", "whole", "n_words", "at", "n").distinct()
    per = settled(found.groupBy("doc_id", "whole", "n_words").agg(every.alias("_places"))).select(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole"), F.col("n_words").alias("_words"), "_places")
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    same = [F.col(inner["doc_id"]).eqNullSafe(F.col("_id")), _whole(F.col(inner["text"])).eqNullSafe(F.col("_whole"))]
    return inner, plain.join(small_side(per, MAX_DIRTY), same, "left")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", max_share: float = 0.0, **options) -> DataFrame:
    """docs without contamination; columns of docs only, whatever their names.

    remove="documents" drops documents of which more than max_share of the words are hit;
    remove="spans" keeps every document and cuts the hit words out of it (the words left
    are joined by a space; texts without a hit stay as they are).  Rows that repeat a text
    fare alike, null and empty texts stay.
    """
    inner, out = _marked(docs, benchmark, **options)
    if remove == "documents":
        return out.where(F.col("_words").isNull() | (F.size("_places") <= max_share * F.col("_words"))).select(*inner.values()).toDF(*docs.columns)
    text = F.col(inner["text"])
    left = let(words(text), lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(w)), F.col("_places")), lambda i: w[i - 1]), " "))
    cut = out.withColumn("_text", F.when(F.col("_words").isNotNull(), left).otherwise(text))
    return cut.select(*["_text" if c == "text" else i for c, i in inner.items()]).toDF(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs, repeated rows too."""
    rows, found = hits(docs, benchmark, **options)
    every = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))
    per = found.groupBy("doc_id", "whole").agg(F.size(every).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    per = settled(per.withColumnsRenamed({"doc_id": "_id", "whole": "_whole"}))
    out = rows.join(small_side(per, MAX_DIRTY), [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("whole").eqNullSafe(F.col("_whole"))], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
