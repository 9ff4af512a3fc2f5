"""Chat formatting in budgeted windows.

Prefix sums of turn tokens lay a conversation's turns along a line of cells.  Turns that lie
within a cell make a window together; a turn that runs over the end of its cell has a window
of its own.  A window holds the system turn, limited history (the last turns before the
window, at most `history` tokens), then its new turns.  A cell is as wide as the budget less
history and system turn, so a window passes the budget only where one turn alone, or the
system turn, leaves no room: turns are never cut.  Only new assistant texts are under the
loss mask, so a target repeated as history is masked.

Template: one line per turn, "<role>text</role-end>" with the fixed marks below.  Inside
texts and roles "\\\\" and "<" are escaped, so no text can imitate a mark and every text
can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.llm._common import running_sum, settled

#: Tokens of a window, of the repeated turns among them, and the least width of a cell.
BUDGET, HISTORY, LEAST = 512, 128, 64
TURN_COST = 4
TURNS_PER_BUCKET = 256
OPEN, MID, CLOSE = "<turn ", "<says>", "<end>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\b", "\\")


def _costed(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(MID))
    return conversations.select(
        "conv_id", "turn", role.alias("role"), head.alias("head"), escaped(text).alias("body"),
        (F.regexp_count(text, F.lit(r"\S+")) + TURN_COST).cast("long").alias("tokens"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / TURNS_PER_BUCKET).cast("long").alias("bucket"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_context, loss (array<struct<start, end>>) of rows (conv_id, turn, role, text).

    Turns come by turn, then role and text; a null turn comes first, null role and text
    count as empty, repeated rows each count; other columns are not looked at.  n_context
    turns at the head of a window are repeats; loss gives code points, end exclusive.
    """
    turns = settled(_costed(conversations))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")]
    turns = settled(running_sum(turns, ["conv_id"], "bucket", order, F.col("tokens"), "before"))
    # the system turn: the first turn of a conversation, if its role says so
    system = turns.where("before = 0 and role = 'system'").groupBy(F.col("conv_id").alias("_conv")).agg(
        F.min(F.struct("tokens", "before", "turn", F.lit(False).alias("new"), "role", "head", "body")).alias("system")
    )
    cost = system.select("_conv", F.col("system.tokens").alias("cost"))
    turns = turns.join(cost, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    turns = turns.withColumn("width", F.greatest(F.lit(budget - history) - F.coalesce("cost", F.lit(0)), F.lit(LEAST)))
    cell = F.floor(F.col("before") / F.col("width"))
    # windows 2k: turns within cell k; 2k + 1: the turn that leaves it
    own = cell * 2 + (F.col("before") + F.col("tokens") > (cell + 1) * F.col("width")).cast("int")
    # later windows that may repeat the turn; those that start too far on drop it again below
    last = F.when(F.col("tokens") <= history, F.floor((F.col("before") + history) / F.col("width")) * 2 + 1).otherwise(own)
    copies = turns.withColumn("own", own).withColumn("window", F.explode(F.sequence(own, F.greatest(own, last)))).withColumn("new", F.col("window") == F.col("own"))
    line = F.struct("before", "turn", "new", "role", "head", "body")
    packed = copies.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.bool_or("new").alias("live")).where("live")
    near = lambda lines, start: F.filter(lines, lambda x: x["new"] | (x["before"] >= start - history))
    begin = F.array_min(F.transform(F.filter("lines", lambda x: x["new"]), lambda x: x["before"]))
    packed = packed.withColumn("begin", begin).withColumn("lines", near(F.col("lines"), F.col("begin"))).drop("begin")
    system = system.select("_conv", F.struct(*[F.col(f"system.{c}").alias(c) for c in ("before", "turn", "new", "role", "head", "body")]).alias("system"))
    packed = packed.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    absent = F.col("system").isNotNull() & (F.col("lines")[0]["before"] > 0)
    packed = packed.withColumn("lines", F.when(absent, F.concat(F.array("system"), "lines")).otherwise(F.col("lines")))
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        mark = F.when(x["new"] & (x["role"] == "assistant"), F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(acc["out"], mark).alias("out"))

    return packed.select(
        "conv_id", "window",
        F.array_join(F.transform("lines", whole), "").alias("formatted"),
        F.size(F.filter("lines", lambda x: ~x["new"])).alias("n_context"),
        F.aggregate("lines", start, step)["out"].alias("loss"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    turns = formatted.split(CLOSE)[:-1]
    return [tuple(unescape(x) for x in t[len(OPEN) :].split(MID, 1)) for t in turns]


def _read_back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of windows sorted by conversation; state is one conversation's hashes, never its texts."""
    conv, state = None, None

    def done() -> tuple:
        return (conv[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"])

    for part in parts:
        rows = []
        for c, formatted, n_context, loss in zip(part["conv_id"], part["formatted"], part["n_context"], part["loss"]):
            c = None if pd.isna(c) else int(c)
            if conv is None or conv[0] != c:
                if conv is not None:
                    rows.append(done())
                conv, state = (c,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
            for role, text in parse(formatted)[n_context:]:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            for s in loss:
                target = unescape(formatted[s["start"] : s["end"]])
                state["chars"] += len(target)
                state["loss"].update(target.encode())
            state["length"] += len(formatted)
        yield pd.DataFrame(rows, columns=DIGEST)
    if conv is not None:
        yield pd.DataFrame([done()], columns=DIGEST)


DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digest(conversations: DataFrame, **options) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    rows = windows(conversations, **options).select("conv_id", "window", "formatted", "n_context", "loss")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "formatted", "n_context", "loss").mapInPandas(_read_back, schema)
