"""Personal data: candidate gradient boosting, all in DataFrame expressions.

Base spans follow fixed patterns and always stay.  Looser generators propose further,
overlapping candidates (no country code, spelled-out addresses, other separators).
Boosted trees over format and context features score them, with base spans as positives.
Looser candidates are positives or negatives only where context or a check speaks for it;
the others are unlabelled, and how many of them are positive is estimated with the trees
in turn.  Per kind a threshold reaches `min_precision` on documents held out from the trees;
a kind that cannot has none and is named in the result.  Of overlapping accepted candidates
the one of the highest margin stays.  The fit counts feature patterns over all documents;
trees become CASE expressions, texts are read once and never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.llm._common import let, settled
from lumenstep.llm.spans import best_of_runs, joined, matches, of_kind, untouched, walked

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, RATE, MIN_PRECISION = 12, 0.5, 0.9
#: How often trees are fitted again with what they say of unlabelled candidates.
TURNS = 8
#: One document in so many, by a hash of its text, only calibrates.
HELD_OUT = 5

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: The loose generators, (kind, cheap test, pattern).
GENERATORS = [
    (0, r"(?i)@|[(\[\x20]at[)\]\x20]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?(?:@|[(\[]at[)\]])\x20?|\x20at\x20)[a-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[a-z0-9-]{2,63}+){1,4}+"),
    (1, r"[0-9]\[\.\]|[0-9a-f]:[0-9a-f]", r"(?i)(?<![0-9a-f:.])(?:[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}|[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){7})(?![0-9a-f:])"),
    (2, r"[0-9]{4}[._/][0-9]", r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{2,7}(?![0-9])"),
    (3, r"[0-9)][\x20.-][0-9]", r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{2,4}\)|[0-9]{2,4}+)(?:[\x20.-]{1,2}+[0-9]{2,5}+){2,4}+(?![0-9A-Za-z])"),
]


def base_spans(text: Column) -> list[Column]:
    """Base matches of each kind, checked."""
    digits = lambda x: F.regexp_replace(x["match"], "[^0-9]", "")
    none = matches(F.lit(""), "x")
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none)
    ip = F.filter(matches(text, IP), lambda x: x["match"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    card = F.filter(matches(text, CARD), lambda x: _is_card(digits(x)))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: F.length(digits(x)).between(10, 15))).otherwise(none)
    return [email, ip, card, phone]


def _is_card(number: Column) -> Column:
    return F.length(number).between(14, 19) & F.call_function("luhn_check", number)


#: Format and context features of a candidate (match, before, after), each a yes or no.
FEATURES = [
    ("context names the kind", r"before", r"(?i)(?:mail|e-?mail|contact|write|ip|host|server|addr|card|visa|credit|pay|tel|phone|call|fax|mobile|reach)[^\n]{0,20}$"),
    ("context names a number of another sort", r"before", r"(?i)(?:order|invoice|version|isbn|id|no|page|date|ref|total|price|year)[.:#\x20]{0,3}$"),
    ("letters or digits touch it", r"around", r"^[^|]*[A-Za-z0-9]\|"),
    ("it looks like a date", r"match", r"^(?:[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-][0-9]{2,4}|[0-9]{4}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2})$"),
    ("at least ten digits", r"match", r"(?:[0-9][^0-9]*){10}"),
    ("over fifteen digits", r"match", r"(?:[0-9][^0-9]*){16}"),
    ("one digit all through", r"match", r"^[^0-9]*([0-9])(?:[^0-9]|\1)*$"),
    ("starts with zero", r"match", r"^[^0-9A-Za-z]*0"),
    ("brackets", r"match", r"[()\[\]]"),
    ("ends on a known domain", r"match", r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"),
    ("groups end on four digits", r"match", r"[^0-9][0-9]{4}$"),
    ("a group of over five digits", r"match", r"[0-9]{6}"),
]
#: Places of features that say a loose candidate is none (another number, touched, a date, one digit); the last feature is _checked.
CONTRARY, NAMED, BRACKETS, DOMAIN, CHECKED = (1, 2, 3, 6), 0, 8, 9, len(FEATURES)


def _checked(match: Column, kind: Column) -> Column:
    """Whether a loose candidate passes what can be checked of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    ip = match.contains(":") | match.rlike(rf"^{_OCTET}(?:\[\.\]{_OCTET}){{3}}$")
    return F.when(kind == 1, ip).when(kind == 2, _is_card(digits)).when(kind == 3, F.length(digits).between(7, 15)).otherwise(F.lit(True))


def _verdict(kind: int, f: tuple) -> int:
    """What a loose candidate's features say: 1 one of its kind, 0 none, -1 nothing for certain."""
    if any(f[i] for i in CONTRARY) or not f[CHECKED]:
        return 0
    clear = f[DOMAIN] and (f[NAMED] or f[BRACKETS]) if KINDS[kind] == "email" else f[NAMED] or KINDS[kind] == "ip" and f[BRACKETS]
    return 1 if clear else -1


def _described(text: Column, spans: Column, base: bool) -> Column:
    """Spans (start, end, match, kind) as (start, end, kind, f) with their features."""

    def one(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - 31, F.lit(1)), F.least(x["start"], F.lit(32)))
        fields = {"before": before, "match": x["match"], "around": F.concat(F.substring(before, -1, 1), F.lit("|"), F.substring(text, x["end"] + 1, F.lit(1)))}
        f = F.array(*[fields[f].rlike(p) for _, f, p in FEATURES], F.lit(True) if base else _checked(x["match"], x["kind"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), f.alias("f"))

    return F.transform(spans, one)


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), F.lit(kind).alias("kind")))


def candidates(text: Column, base: Column) -> Column:
    """Loose candidates that touch no base span, with their features; they may overlap each other."""
    none = matches(F.lit(""), "x")
    parts = [_tagged(F.when(text.rlike(test), matches(text, pattern)).otherwise(none), kind) for kind, test, pattern in GENERATORS]
    return _described(text, untouched(F.concat(*parts), base), False)


@dataclass
class Boosted:
    """Trees of depth two: (feature, (no: feature, no, yes), (yes: feature, no, yes)); a threshold per kind."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, f: tuple) -> float:
        return self.bias + sum(side[1 + f[side[0]]] for root, no, yes in self.trees for side in [(no, yes)[f[root]]])

    def column(self, x: Column) -> Column:
        out = F.lit(self.bias)
        for root, no, yes in self.trees:
            leaf = lambda s: F.when(x["f"][s[0]], F.lit(s[2])).otherwise(F.lit(s[1]))
            out = out + F.when(x["f"][root], leaf(yes)).otherwise(leaf(no))
        return out

    def least(self, kind: Column) -> Column:
        """The margin a candidate of the kind needs; null where none will do."""
        out = F.lit(None).cast("double")
        for k, least in self.thresholds.items():
            out = F.when(kind == k, F.lit(least)).otherwise(out)
        return out

    def chosen(self, spans: Column) -> Column:
        """The accepted candidates, array<struct<start, end, kind>>."""
        scored = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), self.column(x).cast("double").alias("margin")))
        alone = best_of_runs(F.filter(scored, lambda x: x["margin"] >= self.least(x["kind"])))
        return F.transform(alone, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    @property
    def off(self) -> str:
        """The kinds without a threshold, comma-joined."""
        return ",".join(k for i, k in enumerate(KINDS) if i not in self.thresholds)


Counts = list[tuple[int, tuple, int, int]]


def estimated(counts: Counts, held: Counts = (), turns: int = TURNS, min_precision: float = MIN_PRECISION, **options) -> Boosted:
    """Trees over (kind, features, base spans, loose candidates), the unlabelled among the latter shared out by expectation.

    They begin half and half; each turn fits trees and shares them out by their margins.
    Thresholds come from the held-out counts, for a kind that has no positives there from all;
    only loose candidates count there, as base spans stay in any case and must not buy room
    for wrong ones.  Where no cut is precise enough, base_floors sets it.
    """
    said = [_verdict(kind, f) for kind, f, _, _ in counts]
    share = [0.5 if v < 0 else float(v) for v in said]
    chance = lambda f: 1 / (1 + math.exp(-max(-40.0, min(40.0, model.margin(f)))))
    for turn in range(turns):
        model = boost([(kind, f, base + loose * s, loose * (1 - s)) for (kind, f, base, loose), s in zip(counts, share)], **options)
        if all(v >= 0 for v in said):
            break
        if turn < turns - 1:
            share = [chance(f) if v < 0 else s for (_, f, _, _), v, s in zip(counts, said, share)]
    for rows in ([*counts, *held], held):
        patterns = []
        for kind, f, _, loose in rows:
            v = _verdict(kind, f)
            s = chance(f) if v < 0 else v
            patterns.append((kind, f, loose * s, loose * (1 - s)))
        calibrate(model, patterns, min_precision)
    if min_precision <= 1:
        base_floors(model, [*counts, *held])
    return model


def base_floors(model: Boosted, rows: Counts) -> None:
    """Thresholds of kinds left without: the least margin of base spans above all loose candidates.

    It adds none of the candidates seen here; other texts may hold what looks like a base span.
    """
    for kind in {r[0] for r in rows if r[2]} - model.thresholds.keys():
        top = max((model.margin(f) for k, f, _, loose in rows if k == kind and loose), default=-math.inf)
        above = [m for k, f, base, _ in rows if k == kind and base and (m := model.margin(f)) - 1e-9 > top]
        if above and model.trees:
            model.thresholds[kind] = min(above) - 1e-9


def calibrate(model: Boosted, patterns: list[tuple[int, tuple, float, float]], min_precision: float) -> None:
    """Set the threshold of each kind that has positives here: the least margin from which precision holds, or none."""
    by_kind = defaultdict(list)
    for kind, f, pos, neg in patterns:
        by_kind[kind].append((model.margin(f), pos, neg))
    for kind, rows in by_kind.items():
        if not sum(pos for _, pos, _ in rows) or not model.trees:
            continue
        model.thresholds.pop(kind, None)
        right = wrong = 0.0
        for m, pos, neg in sorted(rows, reverse=True):
            right, wrong = right + pos, wrong + neg
            if right and right / (right + wrong) >= min_precision:
                model.thresholds[kind] = m - 1e-9


def boost(patterns: list[tuple[int, tuple, float, float]], rounds: int = ROUNDS) -> Boosted:
    """Newton boosting over (kind, features, positives, others); at most 2**features patterns a kind."""
    pos, neg = sum(p[2] for p in patterns), sum(p[3] for p in patterns)
    model = Boosted(bias=math.log((pos + 1) / (neg + 1)))
    if not pos:
        return model
    margins, n_f = [model.bias] * len(patterns), len(patterns[0][1])

    def leaf(rows: list[int]) -> tuple[float, float]:
        """Step and gain of one leaf."""
        g = h = 0.0
        for i in rows:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, margins[i]))))
            _, _, a, b = patterns[i]
            g, h = g + a * (1 - p) - b * p, h + (a + b) * p * (1 - p)
        return RATE * g / (h + 1.0), g * g / (h + 1.0)

    def split(rows: list[int]) -> tuple[int, float, float, float]:
        """Best feature with its two steps and gain."""
        best = (0, 0.0, 0.0, -1.0)
        for k in range(n_f):
            no, yes = leaf([i for i in rows if not patterns[i][1][k]]), leaf([i for i in rows if patterns[i][1][k]])
            if no[1] + yes[1] > best[3]:
                best = (k, no[0], yes[0], no[1] + yes[1])
        return best

    for _ in range(rounds):
        root = split(list(range(len(patterns))))[0]
        sides = [split([i for i, p in enumerate(patterns) if bool(p[1][root]) == side])[:3] for side in (False, True)]
        model.trees.append((root, *sides))
        for i, p in enumerate(patterns):
            k, no, yes = sides[bool(p[1][root])]
            margins[i] += yes if p[1][k] else no
    return model


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, whole (text hash), base and loose: array<struct<start, end, kind, f>>, for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", "text", F.concat(*[_tagged(s, k) for k, s in enumerate(base_spans(text))]).alias("base"))
    return found.select("doc_id", F.xxhash64(text, F.length(text)).alias("whole"), _described(text, F.col("base"), True).alias("base"), candidates(text, F.col("base")).alias("loose"))


def fit(docs: DataFrame) -> Boosted:
    """Fit on all documents (doc_id, text); what reaches the driver are counts of feature patterns."""
    return fitted(scanned(docs))


def fitted(spans: DataFrame) -> Boosted:
    """The same for scanned documents."""
    held = F.pmod("whole", F.lit(HELD_OUT)) == 0
    sides = F.array(*[F.struct(F.lit(own).alias("is_base"), F.col(c).alias("of")) for own, c in ((True, "base"), (False, "loose"))])
    every = spans.select(held.alias("held"), F.explode(sides).alias("side")).select("held", "side.is_base", F.explode("side.of").alias("c")).select("held", "is_base", "c.kind", "c.f")
    counts = every.groupBy("held", "kind", "f").agg(F.count_if("is_base").alias("pos"), F.count_if(~F.col("is_base")).alias("neg")).orderBy("held", "kind", "f").collect()
    part = lambda held: [(r.kind, tuple(r.f), r.pos, r.neg) for r in counts if r.held == held]
    return estimated(part(False), part(True))


def found(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs plus pii_base and pii_added: array<struct<start, end, kind>>, kind an index into KINDS.

    A null text counts as empty; other columns stay, columns of these names are replaced.
    """
    model = model or fit(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[of_kind(s, k) for k, s in enumerate(base_spans(text))])
    docs = docs.drop("pii_base", "pii_added").withColumn("pii_base", base)
    if not model.thresholds:
        return docs.withColumn("pii_added", F.filter("pii_base", lambda x: F.lit(False)))
    return docs.withColumn("pii_added", model.chosen(candidates(text, F.col("pii_base"))))


def redacted(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets; null stays null, names of columns are free."""
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values()).withColumns({"doc_id": F.col(inner["doc_id"]), "text": F.col(inner["text"])})
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.transform(F.concat("pii_base", "pii_added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.concat(F.substring("text", at + 1, x["start"] - at), marks[x["kind"]])
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, gap).otherwise(F.lit(""))

    parts = let(spans, lambda all_: walked(all_, F.lit(0), step, "string"))
    whole = let(parts, lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text", a["state"] + 1, F.length("text"))))
    out = found(plain, model).withColumn("_text", F.when(F.col("text").isNotNull(), whole))
    return out.select(*["_text" if c == "text" else i for c, i in inner.items()]).toDF(*docs.columns)


def digest(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added and kinds_off (kinds for which nothing could be added)."""
    rows = settled(scanned(docs))  # spans only: each text is matched once
    model = model or fitted(rows)
    place = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    added = model.chosen(F.col("loose")) if model.thresholds else F.filter(place("base"), lambda x: F.lit(False))
    out = rows.select("doc_id", place("base").alias("base"), added.alias("added"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.lit(model.off).alias("kinds_off"),
    )
