"""Secret scans: multipart credential linking, in DataFrame expressions.

Base spans follow fixed patterns and always stay.  A credential often has several parts,
an access identifier, a secret and an endpoint, each too weak to report alone: a random
looking string, a host, an account name.  Such weak parts are reported only where
complementary parts lie within SCOPE characters in the same text: an interval join of
parts on (text, scope bucket).  Parts of a kind do not overlap, so a bucket holds fewer of
them than it has characters and no join partner list grows with the text.

Texts are never shuffled, only parts and the spans found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.llm._common import settled
from lumenstep.llm.spans import joined, matches

KINDS = ["assign", "access", "hex"]
#: Names of the linked weak parts; they follow the base kinds in order.
WEAK = ["weak_id", "weak_secret", "endpoint"]
SCOPE = 200

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

#: Weak parts: (kind, cheap test, pattern).
PARTS = [
    (0, r"(?i)(?:user|login|account|client|key)", r"(?i)(?<![a-z0-9])(?:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9_.@-]{3,64}+"),
    (1, r"[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,80}[0-9])(?=[a-z0-9+/_-]{0,80}[A-Z])(?=[A-Z0-9+/_-]{0,80}[a-z])[A-Za-z0-9+/_-]{20,80}+={0,2}(?![A-Za-z0-9+/_=-])"),
    (2, r"://|\.[a-z]", r"(?i)(?:(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,200}+|(?<![a-z0-9.-])(?:[a-z0-9-]{1,63}\.){1,6}(?:amazonaws\.com|azure\.com|googleapis\.com|internal|local)(?![a-z0-9-]))"),
]


def _kinds(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind>> of the base matches of all kinds."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_replace(x["match"], _VALUE, "")) >= 6)
    return F.concat(_kinds(assign, 0), _kinds(matches(text, ACCESS), 1), _kinds(matches(text, HEX), 2))


def _weak(text: Column) -> Column:
    none = matches(F.lit(""), "x")
    return F.concat(*[_kinds(F.when(text.rlike(test), matches(text, p)).otherwise(none), len(KINDS) + k) for k, test, p in PARTS])


def _roles(parts: DataFrame) -> DataFrame:
    """Role of each part: 0 identifier, 1 secret, 2 endpoint (base: access is one, the others are secrets)."""
    return parts.withColumn("role", F.when(F.col("kind") == 1, 0).when(F.col("kind") < len(KINDS), 1).otherwise(F.col("kind") - len(KINDS)))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: array<struct<start, end, kind>> for each row of docs (doc_id, text).

    A weak identifier or secret is added if a part of each of two roles, itself one of
    them, lies within SCOPE characters and no base span covers it; endpoints only support
    others.  A null text counts as empty; rows that repeat doc_id and text are scanned each
    and give equal results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("whole"), base_spans(text).alias("base"), _weak(text).alias("weak"))
    return linked(settled(scanned))  # spans only, no texts: each text is matched once


def linked(scanned: DataFrame) -> DataFrame:
    """The interval join: doc_id, base, added of scanned rows (doc_id, whole, base, weak)."""
    key = ["doc_id", "whole"]
    # only texts with a weak part that is reportable and some other part can link
    with_parts = scanned.where(F.exists("weak", lambda x: x["kind"] < len(KINDS) + 2) & (F.size("weak") + F.size("base") > 1))
    parts = _roles(with_parts.select(*key, F.explode(F.concat("base", "weak")).alias("p")).select(*key, "p.*").distinct())
    # the asking part stands in each bucket it touches, an offer one further on both sides: whatever is within SCOPE meets
    touched = F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)))
    ask = parts.where(F.col("kind").between(len(KINDS), len(KINDS) + 1)).withColumn("bucket", touched)
    near = F.explode(F.sequence(F.floor(F.col("start") / SCOPE) - 1, F.floor(F.col("end") / SCOPE) + 1))
    offer = parts.select(*[F.col(k).alias(f"o_{k}") for k in key], F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.col("kind").alias("o_kind"), near.alias("o_bucket"))
    same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in key]
    within = (F.col("o_start") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("o_end") + SCOPE)
    apart = (F.col("o_start") >= F.col("end")) | (F.col("start") >= F.col("o_end"))
    pairs = ask.join(offer, [*same, F.col("bucket") == F.col("o_bucket"), within, apart, F.col("role") != F.col("o_role")], "left_semi")
    covered = (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end")) & (F.col("o_kind") < len(KINDS))
    # a long part may meet the span that covers it in some of its buckets only
    part = [*key, "start", "end", "kind"]
    inside = ask.join(offer, [*same, F.col("bucket") == F.col("o_bucket"), covered], "left_semi").select(*[F.col(k).alias(f"i_{k}") for k in part]).distinct()
    alone = pairs.select(*part).distinct().join(inside, [F.col(k).eqNullSafe(F.col(f"i_{k}")) for k in part], "left_anti")
    added = alone.groupBy(*key).agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    added = added.select(*[F.col(k).alias(f"a_{k}") for k in key], "added")
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return scanned.join(added, [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in key], "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and n_added."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found(docs).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS + WEAK).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
