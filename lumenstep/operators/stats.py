"""Sufficient statistics of all features in one pass: counts and target sums per value.

Refits, folds and partitions only ever read these.  What reaches the driver is bounded: the
values of a numeric feature with more than about `max_values` of them stay in a written table
in which exact splits are searched (see splits); with keys (folds, partitions) they are grouped
between approximate quantiles (`KEYED_VALUES` of them at most).  A text feature with more than
`max_categories` values is refused and should be condensed first (see prep).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstep.operators import splits

MAX_VALUES, MAX_CATEGORIES = 20_000, 100_000
#: Values of a numeric feature for each key.
KEYED_VALUES = 10_000
#: In place of the values of a wide feature in statistics that were saved.
ABSENT = "absent"


@dataclass
class FeatureStats:
    """Distinct values in order with counts and target sums; nulls apart."""

    kind: str
    values: np.ndarray
    count: np.ndarray
    total: np.ndarray
    null_count: int = 0
    null_total: float = 0.0
    edges: np.ndarray | None = None
    #: Values in a table (splits.WideValues); then `count` and `total` hold one number, all rows with a value.
    wide: splits.WideValues | str | None = None

    def minus(self, other: FeatureStats | None) -> FeatureStats:
        """What is left without `other`, whose values are among these (leave one fold out)."""
        if other is None or not len(other.values):
            return FeatureStats(self.kind, self.values, self.count, self.total, self.null_count - (other.null_count if other else 0), self.null_total - (other.null_total if other else 0.0), self.edges)
        at = {v: i for i, v in enumerate(self.values)}
        count, total = self.count.copy(), self.total.copy()
        where = np.array([at[v] for v in other.values])
        count[where] -= other.count
        total[where] -= other.total
        left = count > 0
        return FeatureStats(self.kind, self.values[left], count[left], total[left], self.null_count - other.null_count, self.null_total - other.null_total, self.edges)


@dataclass
class Stats:
    n: int = 0
    total: float = 0.0
    features: dict[str, FeatureStats] = field(default_factory=dict)

    @property
    def base(self) -> float:
        return self.total / self.n if self.n else 0.0

    def plain(self) -> dict:
        """As lists and numbers, for JSON."""
        listed = lambda x: x.tolist() if isinstance(x, np.ndarray) else x
        plain = lambda f: vars(f) | {"wide": None if f.wide is None else ABSENT}
        return {"n": self.n, "total": self.total, "features": {k: {c: listed(v) for c, v in plain(f).items()} for k, f in self.features.items()}}

    @staticmethod
    def of_plain(d: dict) -> Stats:
        out = Stats(d["n"], d["total"])
        for k, f in d["features"].items():
            kinds = {"values": float if f["kind"] == "numeric" else object, "count": np.int64, "total": float} | ({"edges": float} if f["edges"] is not None else {})
            out.features[k] = FeatureStats(**f | {c: np.array(f[c], dtype=t) for c, t in kinds.items()})
        return out

    def minus(self, other: Stats) -> Stats:
        return Stats(self.n - other.n, self.total - other.total, {k: v.minus(other.features.get(k)) for k, v in self.features.items()})

    @staticmethod
    def merged(parts: list[Stats]) -> Stats:
        out = Stats(sum(p.n for p in parts), sum(p.total for p in parts))
        for name in {k: None for p in parts for k in p.features}:
            own = [p.features[name] for p in parts if name in p.features]
            values, inverse = np.unique(np.concatenate([f.values for f in own]), return_inverse=True)
            sums = [np.bincount(inverse, np.concatenate([getattr(f, c) for f in own]), minlength=len(values)) for c in ("count", "total")]
            out.features[name] = FeatureStats(own[0].kind, values, sums[0].astype(np.int64), sums[1], sum(f.null_count for f in own), sum(f.null_total for f in own), own[0].edges)
        return out


def roles(df: DataFrame, features: list[str] | None, leave: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features; other types are refused."""
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    features = [c for c in df.columns if c not in leave] if features is None else features
    missing = [c for c in features if c not in types]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    numeric = [c for c in features if isinstance(types[c], T.NumericType)]
    categorical = [c for c in features if isinstance(types[c], (T.StringType, T.BooleanType))]
    odd = set(features) - {*numeric, *categorical}
    if odd:
        raise ValueError(f"neither numeric, text nor boolean: {sorted(odd)}")
    return numeric, categorical


def number(name: str) -> Column:
    """As double, NaN as null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def category(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(c, "True").when(~c, "False") if isinstance(df.schema[name].dataType, T.BooleanType) else c.cast("string")


def target_column(df: DataFrame, target: str) -> Column:
    """Booleans and numbers as double; a text target of two values as 0 and 1 in their order."""
    if isinstance(df.schema[target].dataType, T.StringType):
        raise ValueError("encode a text target first (encode_target)")
    return F.col(f"`{target}`").cast("double")


def encode_target(df: DataFrame, target: str, out: str) -> tuple[DataFrame, dict]:
    """Text target as 0 and 1 in the order of its two values, with the map back."""
    found = sorted(r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().limit(3).collect())
    if len(found) > 2:
        raise ValueError("only two classes can be learned")
    back = dict(enumerate(found))
    return with_codes(df, target, out, back), back


def with_codes(df: DataFrame, target: str, out: str, back: dict) -> DataFrame:
    """df plus `out`, the codes of a text target by the map back; other values have none."""
    code = F.coalesce(*[F.when(F.col(target) == v, float(k)) for k, v in back.items()]) if back else F.lit(None).cast("double")
    return df.withColumn(out, code)


def _wide(df: DataFrame, numeric: list[str], max_values: int) -> list[str]:
    """Features whose values should not all be collected; an estimate will do, as results do not depend on it."""
    sizes = df.agg(*[F.approx_count_distinct(number(c)).alias(str(i)) for i, c in enumerate(numeric)]).first() if numeric else {}
    return [c for i, c in enumerate(numeric) if sizes[str(i)] > max_values]


def _quantile_edges(df: DataFrame, wide: list[str], max_values: int) -> dict[str, np.ndarray]:
    if not wide:
        return {}
    shares = [(i + 1) / max_values for i in range(max_values - 1)]
    found = df.agg(*[F.percentile_approx(number(c), shares, 10 * max_values).alias(str(i)) for i, c in enumerate(wide)]).first()
    return {c: np.unique(np.array(found[str(i)])) for i, c in enumerate(wide)}


def _wide_stats(base: DataFrame, columns: dict[str, str]) -> dict[str, FeatureStats]:
    """Statistics of features (name -> column) whose values stay in one written table."""
    names = list(columns)
    long = base.select("_y", *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns.values())]).unpivot(["_y"], [f"v{i}" for i in range(len(names))], "f", "v")
    groups = long.groupBy(F.substring("f", 2, 10).cast("int").alias("f"), "v").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
    sums = long.groupBy("f").agg(F.count("v").alias("n"), F.sum(F.when(F.col("v").isNotNull(), F.col("_y"))).alias("s"), F.count_if(F.col("v").isNull()).alias("n0"), F.sum(F.when(F.col("v").isNull(), F.col("_y"))).alias("s0")).collect()
    table, sizes = splits.cumulated(groups.where("v is not null"))
    return {
        names[i]: FeatureStats("numeric", np.zeros(0), np.array([r.n]), np.array([r.s]), r.n0, float(r.s0 or 0.0), None, splits.WideValues(table, i, sizes[i]))
        for r in sums for i in [int(r.f[1:])]
    }


def collect(
    df: DataFrame, target: str, numeric: list[str], categorical: list[str], keys: list[str] | None = None,
    max_values: int = MAX_VALUES, max_categories: int = MAX_CATEGORIES,
) -> dict[tuple, Stats]:
    """Stats by values of `keys` (one entry, (), without keys); rows without a target are left out."""
    keys = keys or []
    df = df.where(F.col(f"`{target}`").isNotNull())
    most = min(max_values, KEYED_VALUES) if keys else max_values
    wide = _wide(df, numeric, most)
    edges = _quantile_edges(df, wide, most) if keys else {}
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(
        *[F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(keys, names)], target_column(df, target).alias("_y"),
        *[number(c).alias(f"_n{i}") for i, c in enumerate(numeric)], *[category(df, c).alias(f"_c{i}") for i, c in enumerate(categorical)],
    )
    for i, c in enumerate(numeric):
        if c in edges:
            cut = Bucketizer(splits=[-np.inf, *edges[c].tolist(), np.inf], inputCol=f"_n{i}", outputCol="_cell", handleInvalid="keep")
            base = cut.transform(base).withColumn(f"_n{i}", F.when(F.col(f"_n{i}").isNotNull(), F.col("_cell"))).drop("_cell")
    out: dict[tuple, Stats] = {}
    if wide and not keys:
        apart = _wide_stats(base, {c: f"_n{numeric.index(c)}" for c in wide})
        first = apart[wide[0]]
        out[()] = Stats(int(first.count.sum()) + first.null_count, float(first.total.sum()) + first.null_total, apart)
    for kind, prefix, columns in (("numeric", "_n", numeric), ("categorical", "_c", categorical)):
        if not [c for c in columns if keys or c not in wide]:
            continue
        long = base.unpivot([*names, "_y"], [f"{prefix}{i}" for i, c in enumerate(columns) if keys or c not in wide], "_f", "_v")
        groups = long.groupBy(*names, "_f", "_v").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
        if kind == "categorical":
            widest = groups.groupBy("_f").count().agg(F.max("count")).first()[0] or 0
            if widest > max_categories * max(1, len(keys) and 10):
                raise ValueError(f"a text feature has {widest} values, more than {max_categories}; condense it first")
        rows = groups.toArrow().to_pandas()
        for key, part in rows.groupby(["_f", *names], dropna=False, sort=True) if len(rows) else []:
            name = columns[int(key[0][2:])]
            stats = out.setdefault(tuple(None if x != x else x for x in key[1:]), Stats())
            null = part["_v"].isna()
            own = part[~null].sort_values("_v")
            values = own["_v"].to_numpy(dtype=float if kind == "numeric" else object)
            stats.features[name] = FeatureStats(kind, values, own["n"].to_numpy(), own["s"].to_numpy(dtype=float), int(part["n"][null].sum()), float(part["s"][null].sum()), edges.get(name))
            if len(stats.features) == 1:
                stats.n, stats.total = int(part["n"].sum()), float(part["s"].sum())
    return out


def candidates(f: FeatureStats, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split points with the count and target sum at or below each; thinned by alpha."""
    count, total = np.cumsum(f.count)[:-1], np.cumsum(f.total)[:-1]
    if f.edges is not None:  # cells [edge, next edge): below an edge means at most the number before it
        return np.nextafter(f.edges[f.values[1:].astype(int) - 1], -np.inf), count, total
    n = len(f.values)
    if n < 2:
        return np.zeros(0), count, total
    step = splits.candidate_step(n, alpha)
    return ((f.values[:-1] + f.values[1:]) / 2)[::step], count[::step], total[::step]
