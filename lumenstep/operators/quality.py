"""Data-quality scan: one row for each column, from aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstep.operators import ranks
from lumenstep.operators.written import settled

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
NUMERIC = ["min", "q25", "mean", "median", "q75", "max", "std", "skewness", "kurtosis", "variance"]


def skewness(x: Column) -> Column:
    """Bias-corrected."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(x))


def kurtosis(x: Column) -> Column:
    """Excess, bias-corrected."""
    n = F.count(x).cast("double")
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def moments(x: Column) -> dict[str, Column]:
    return {"min": F.min(x), "mean": F.avg(x), "max": F.max(x), "std": F.stddev_samp(x), "skewness": skewness(x), "kurtosis": kurtosis(x), "variance": F.var_samp(x)}


def _upper(x: Column) -> Column:
    return F.trim(x).rlike(r"\p{Lu}") & ~F.trim(x).rlike(r"^\p{Lu}+$")


def _digit(x: Column) -> Column:
    return F.trim(x).rlike(r"\d") & ~F.trim(x).rlike(r"^\d+$")


def mixed_case(x: Column) -> Column:
    return F.avg(_upper(x).cast("double"))


def mixed_type(x: Column) -> Column:
    return F.avg(_digit(x).cast("double"))


def imbalance(df: DataFrame, name: str) -> DataFrame:
    """One row: mean over values of |share - 1/k| / (1/k), shares of all rows."""
    per = df.groupBy(name).count()
    whole = per.agg(F.sum("count").alias("n"), F.count(name).alias("k"))
    return per.where(F.col(name).isNotNull()).join(F.broadcast(whole)).agg(F.avg(F.abs(F.col("count") / F.col("n") * F.col("k") - 1)).alias("category_imbalance"))


def _by_value(df: DataFrame, columns: dict[str, Column], rows: int) -> dict[str, dict]:
    """Facts of columns from the counts of their values, which are made for all columns at once and written."""
    if not columns:
        return {}
    names = list(columns)
    long = df.select(*[c.cast("string").alias(f"v{i}") for i, c in enumerate(columns.values())]).unpivot([], [f"v{i}" for i in range(len(names))], "f", "v")
    counts = settled(long.where("v is not null").groupBy("f", "v").agg(F.count("*").alias("n")))
    v, n = F.col("v"), F.col("n")
    share = lambda test: (F.sum(F.when(test, n).otherwise(0)) / F.sum("n")).cast("double")
    facts = counts.groupBy("f").agg(
        F.count("*").alias("n_unique"), F.min(F.struct((-n).alias("less"), "v"))["v"].alias("mode"), F.bool_or(v.contains(" ")).alias("spaced"),
        share(_upper(v)).alias("mixed_case"), share(_digit(v)).alias("mixed_type"),
    )
    found = {names[int(r.f[1:])]: r.asDict() for r in facts.collect()}
    width = F.create_map(*[x for i, c in enumerate(names) if c in found for x in (F.lit(f"v{i}"), F.lit(found[c]["n_unique"]))]) if found else None
    if found:
        for r in counts.groupBy("f").agg(F.avg(F.abs(n / rows * F.element_at(width, F.col("f")) - 1)).alias("i")).collect():
            found[names[int(r.f[1:])]]["category_imbalance"] = r.i
    return found


def scan(df: DataFrame, exact: bool = True, exact_distinct: bool = True) -> DataFrame:
    """column, kind, missing_pct, n_unique, cardinality and the measures of its kind, null where they do not apply.

    kind: empty, id, numeric, nlp, categorical or date.  The number of jobs does not depend on
    the number of columns: one aggregation, one count of values of all columns, a few passes for
    the quantiles.  exact=False takes approximate quantiles, exact_distinct=False approximate
    distinct counts of numbers and dates, whose values are then not shuffled.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    of = lambda *types: [c for c, t in fields.items() if isinstance(t, types)]
    text, num, date = of(T.StringType, T.BooleanType), of(T.NumericType), of(T.DateType, T.TimestampType)
    plain = {c: (F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double") + F.lit(0.0)) if c in num else F.col(f"`{c}`").cast("string")) for c in fields}
    aggs = []
    for i, (c, x) in enumerate(plain.items()):
        own = {"present": F.count(x)} | (moments(x) if c in num else {}) | ({"first_date": F.min(x), "last_date": F.max(x)} if c in date else {})
        if c in num and not exact:
            own |= {k: F.percentile_approx(x, p, 10_000).cast("double") for k, p in QUARTILES.items()}
        if c not in text and not exact_distinct:
            own["n_unique"] = F.approx_count_distinct(x)
        aggs += [v.alias(f"{k}:{i}") for k, v in own.items()]
    whole = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first().asDict()
    rows, facts = whole.pop("n"), {c: {} for c in fields}
    for k, v in whole.items():
        what, i = k.split(":")
        facts[list(fields)[int(i)]][what] = v
    counted = _by_value(df, {c: x for c, x in plain.items() if c in text or exact_distinct}, rows)
    parts = ranks.quantiles(df, {c: plain[c] for c in num}, list(QUARTILES.values())) if exact else {}
    schema = "column string, kind string, missing_pct double, n_unique long, cardinality double, " + ", ".join(f"{c} double" for c in NUMERIC) + ", mode string, mixed_case double, mixed_type double, category_imbalance double, first_date string, last_date string"
    out = []
    for c, r in facts.items():
        own = counted.get(c, {"n_unique": 0} if exact_distinct else {})
        r |= own if c in text else {"n_unique": own["n_unique"]} if "n_unique" in own else {}
        r |= dict(zip(QUARTILES, parts[c])) if c in parts else {}
        share = round(r["n_unique"] / r["present"], 4) if r["present"] else 0.0
        if not r["present"]:
            kind = "empty"
        elif c in num:
            kind = "id" if share == 1 and r["present"] == rows else "numeric"
        elif c in text:
            kind = ("nlp" if r["spaced"] else "id") if share == 1 else "nlp" if share > 0.9 else "categorical"
        else:
            kind = "date" if c in date else "other"
        r |= {"column": c, "kind": kind, "missing_pct": 1 - r["present"] / rows if rows else 0.0, "cardinality": share}
        if kind != "categorical":
            r |= {"category_imbalance": None, "mode": None}
        out.append(tuple(r.get(p.split()[0]) for p in schema.split(", ")))
    return df.sparkSession.createDataFrame(out, schema)


def uninformative(df: DataFrame, zeros: bool = True, keep: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold nothing but nulls, one value all through, or (zeros) only zeros and nulls; one pass.

    A column of one value and nulls stays, for its nulls tell rows apart.
    """
    plain = [f.name for f in df.schema.fields if f.name not in keep and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    number = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    facts = []
    for i, c in enumerate(plain):
        x = F.col(f"`{c}`")
        facts += [F.count(x).alias(f"n{i}"), F.min(x).eqNullSafe(F.max(x)).alias(f"s{i}")]
        if zeros and c in number:
            facts.append((F.count_if(x != 0) == 0).alias(f"z{i}"))
    if not plain:
        return []
    r = df.agg(F.count("*").alias("n"), *facts).first().asDict()
    same = lambda i: r[f"n{i}"] == 0 or (r[f"s{i}"] and r[f"n{i}"] == r["n"])
    return [c for i, c in enumerate(plain) if r["n"] and (same(i) or r.get(f"z{i}", False))]


def drop_uninformative(df: DataFrame, zeros: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """df without its uninformative columns."""
    return df.drop(*uninformative(df, zeros, keep))
