"""Spans of regular-expression matches as native expressions.

Java patterns here are written so that each text is read in linear time and without
deep recursion: possessive quantifiers, and a look behind where a failed run would
otherwise be tried again from each of its places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenstep.llm._common import let

EMPTY = "array<struct<start:int,end:int,match:string>>"


#: Items of an array that are walked through at once; results are gathered in pieces of so many.
PIECE = 128


def walked(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """struct<state, out>: array<kind> of a value for each item, from a state handed from item to item.

    step(state, item) gives the next state and the value.  Growing one array item by item
    would copy it as often; pieces keep the work near the number of items.
    """
    none, pieces = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        state, value = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    def piece(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items, k * PIECE + 1, F.lit(PIECE)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    whole = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")), F.struct(start.alias("state"), pieces.alias("out")), piece)
    empty = F.struct(start.alias("state"), none.alias("out"))
    return F.when(F.size(items) > 0, let(whole, lambda a: F.struct(a["state"].alias("state"), F.flatten(a["out"]).alias("out")))).otherwise(empty)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, left to right; code points, end exclusive.

    split() and regexp_extract_all() walk the same matches, so pieces and matches in turn
    add up to the places.
    """

    def placed(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            begin = at + F.length(x["p"])
            end = begin + F.length(x["m"])
            return end, F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("match"))

        places = let(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda pairs: walked(pairs, F.lit(0), step, "struct<start:int,end:int,match:string>")["out"])
        return F.when(F.size(found) > 0, places).otherwise(F.array().cast(EMPTY))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def untouched(spans: Column, by: Column) -> Column:
    """The spans (structs with start and end) that overlap none of `by`, by start: one walk forth, one back."""
    kind = "struct<start:int,end:int,own:boolean,i:int,free:boolean>"
    side = lambda own: lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), i.alias("i"))
    flag = lambda x, free: F.struct(*[x[c].alias(c) for c in ("start", "end", "own", "i")], free.alias("free"))
    forth = lambda far, x: (F.when(x["own"], far).otherwise(F.greatest(far, x["end"])), flag(x, x["start"] >= far))
    back = lambda near, x: (F.when(x["own"], near).otherwise(F.least(near, x["start"])), flag(x, x["free"] & (x["end"] <= near)))

    def kept(own: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(by, side(False)), F.transform(own, side(True))))
        once = let(both, lambda b: F.reverse(walked(b, F.lit(0), forth, kind)["out"]))
        twice = let(once, lambda b: F.reverse(walked(b, F.lit((1 << 31) - 1), back, kind)["out"]))
        return F.transform(F.filter(twice, lambda x: x["own"] & x["free"]), lambda x: own[x["i"]])

    return let(spans, lambda own: F.when((F.size(own) == 0) | (F.size(by) == 0), own).otherwise(kept(own)))


def best_of_runs(spans: Column) -> Column:
    """Of structs (start, end, kind, margin) the one of the highest margin where they overlap one after another; ties to the first."""
    kind = "struct<start:int,end:int,kind:int,margin:double>"
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("kind"), F.lit(0.0).alias("margin")).cast(kind)
    step = lambda best, x: (F.when((x["start"] >= best["end"]) | (x["margin"] > best["margin"]), x).otherwise(best), F.when(x["start"] >= best["end"], best))
    runs = let(F.array_sort(spans), lambda s: walked(s, none, step, kind))
    return let(runs, lambda r: F.filter(F.concat(r["out"], F.array(r["state"])), lambda x: x.isNotNull() & (x["start"] >= 0)))


def joined(spans: Column, kinds: list[str]) -> Column:
    """'kind:start:end' by start, then kind as listed, comma-joined, of array<struct<start, end, kind int>>."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))
