"""Preprocessing pipelines described by JSON: fit learns constants, transform is a projection.

A spec is {"target_column": ..., "steps": [{"id", "type", "columns", "params", "description"}]}.
The grouped, lag, rolling and scaling steps have a contract of our own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.operators import ranks

#: type -> (fit(df, columns, params) -> state or None, apply(df, columns, params, state))
STEPS: dict[str, tuple[Callable | None, Callable]] = {}


def step(name: str, fit: Callable | None = None):
    def add(apply: Callable) -> Callable:
        STEPS[name] = (fit, apply)
        return apply

    return add


def _each(df: DataFrame, columns: list[str], f: Callable[[str], Column]) -> DataFrame:
    return df.withColumns({c: f(c) for c in columns})


TEXT_OPERATIONS = {
    "lowercase": F.lower, "uppercase": F.upper, "strip": F.trim, "collapse_spaces": lambda c: F.regexp_replace(c, r"\s+", " "),
    "remove_punctuation": lambda c: F.regexp_replace(c, r"[\p{Punct}]", ""), "remove_digits": lambda c: F.regexp_replace(c, r"\d", ""),
}


@step("TextClean")
def _text_clean(df, columns, params, _):
    return _each(df, columns, lambda c: reduce(lambda x, op: TEXT_OPERATIONS[op](x), params.get("operations", ["lowercase"]), F.col(c)))


@step("DropColumns")
def _drop(df, columns, params, _):
    return df.drop(*columns)


@step("RenameColumns")
def _rename(df, columns, params, _):
    return df.withColumnsRenamed(params["mapping"])


@step("TypeCast")
def _cast(df, columns, params, _):
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in params["dtypes"].items()})


@step("Expression")
def _expression(df, columns, params, _):
    return df.withColumns({c: F.expr(e) for c, e in params["expressions"].items()})


def _fit_fill(df, columns, params):
    own = params.get("strategies") or dict.fromkeys(columns, params.get("strategy", "median"))
    measures = {"mean": lambda c: F.avg(F.col(c).cast("double")), "mode": lambda c: F.mode(c, True), "min": F.min, "max": F.max, "constant": lambda c: F.lit(params.get("value"))}
    middle = ranks.quantiles(df, {c: F.col(c) for c, s in own.items() if s == "median"}, [0.5])
    rest = {c: s for c, s in own.items() if s != "median"}
    found = df.agg(*[measures[s](c).alias(c) for c, s in rest.items()]).first().asDict() if rest else {}
    return {c: middle[c][0] if c in middle else found[c] for c in own}


@step("FillMissing", _fit_fill)
def _fill(df, columns, params, state):
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None)) if types[c] in ("double", "float") else F.col(c), F.lit(v)) for c, v in state.items() if v is not None})


def _bounded(column: str, rows: DataFrame, most: int) -> list:
    """Sorted values of one-column rows; more than `most` of them are refused, none is dropped."""
    found = [r[0] for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values to keep; condense it first or raise max_values")
    return sorted(found)


def _fit_condense(df, columns, params):
    """Values kept: share of at least min_frequency each, or, cumulative, the largest that make up 1 - min_frequency."""
    out, least = {}, params["min_frequency"]
    n = df.count() or 1
    for c in columns:
        per = df.where(F.col(c).isNotNull()).groupBy(c).count()
        if params.get("mode") == "cumulative":
            upto = F.sum("count").over(Window.orderBy(F.desc("count"), c).rowsBetween(Window.unboundedPreceding, -1))
            top = per.orderBy(F.desc("count"), c).limit(params.get("max_values", 10_000) + 1)  # one more than may be kept
            rows = top.withColumn("b", F.coalesce(upto, F.lit(0))).where(F.col("b") < n * (1 - least))
        else:
            rows = per.where(F.col("count") >= n * least)
        out[c] = _bounded(c, rows.select(c), params.get("max_values", 10_000))
    return out


@step("CategoryCondense", _fit_condense)
def _condense(df, columns, params, state):
    other = params.get("other", "Other")
    return df.withColumns({c: F.when(F.col(c).isNull() | F.col(c).isin(v), F.col(c)).otherwise(F.lit(other)) for c, v in state.items()})


COMPONENTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "dayofyear": F.dayofyear, "weekofyear": F.weekofyear,
    "hour": F.hour, "minute": F.minute, "day_name": lambda c: F.date_format(c, "EEEE"),
}


@step("DateTimeExtract")
def _dates(df, columns, params, _):
    df = df.withColumns({f"{c}_{p}": COMPONENTS[p](F.col(c)) for c in columns for p in params["components"]})
    return df.drop(*columns) if params.get("drop_original") else df


@step("Clip")
def _clip(df, columns, params, _):
    low, high = params.get("lower"), params.get("upper")
    up = lambda c: c if low is None else F.greatest(c, F.lit(low))
    return _each(df, columns, lambda c: F.when(F.col(c).isNotNull(), up(F.col(c)) if high is None else F.least(up(F.col(c)), F.lit(high))))


@step("LogTransform")
def _log(df, columns, params, _):
    return _each(df, columns, lambda c: F.when(F.col(c) > -1, F.log1p(c)))


@step("ChangeCase")
def _case(df, columns, params, _):
    return _each(df, columns, lambda c: (F.upper if params.get("case") == "upper" else F.lower)(F.col(c)))


@step("MapValues")
def _map(df, columns, params, _):
    pairs = [F.lit(x) for kv in params["mapping"].items() for x in kv]
    return _each(df, columns, lambda c: F.try_element_at(F.create_map(*pairs), F.col(c)))


def _by(params: dict) -> Window:
    w = Window.partitionBy(*params["by"])
    return w.orderBy(*params["order"]) if params.get("order") else w


@step("GroupByAgg")
def _group(df, columns, params, _):
    """Adds <column>_<function> over rows of equal `by`; groups are aggregated, then joined back."""
    per = df.groupBy(*params["by"]).agg(*[getattr(F, f)(c).alias(f"{c}_{f}") for c in columns for f in params["functions"]])
    return df.join(per, params["by"], "left")


@step("GroupedLag")
def _lag(df, columns, params, _):
    k = params.get("lag", 1)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(_by(params)) for c in columns})


@step("RollingAgg")
def _rolling(df, columns, params, _):
    n, f = params["window"], params.get("function", "avg")
    w = _by(params).rowsBetween(-(n - 1), 0)
    return df.withColumns({f"{c}_{f}{n}": F.when(F.count(c).over(w) >= params.get("min_periods", 1), getattr(F, f)(c).over(w)) for c in columns})


def _fit_scale(df, columns, params):
    if params.get("method", "standard") == "standard":
        r = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"b_{c}"))]).first()
    else:
        r = df.agg(*[x for c in columns for x in (F.min(c).alias(f"a_{c}"), (F.max(c) - F.min(c)).alias(f"b_{c}"))]).first()
    return {c: [float(r[f"a_{c}"] or 0), float(r[f"b_{c}"] or 1) or 1.0] for c in columns}


@step("Scale", _fit_scale)
def _scale(df, columns, params, state):
    return _each(df, list(state), lambda c: (F.col(c) - F.lit(state[c][0])) / F.lit(state[c][1]))


def _fit_one_hot(df, columns, params):
    return {c: _bounded(c, df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct(), params.get("max_values", 200)) for c in columns}


@step("OneHot", _fit_one_hot)
def _one_hot(df, columns, params, state):
    return df.withColumns({f"{c}_{v}": F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("int") for c, vs in state.items() for v in vs}).drop(*state)


#: Steps with an inverse: (df, columns, params, state) -> df.
INVERSES = {
    "LogTransform": lambda df, columns, params, _: _each(df, columns, lambda c: F.expm1(c)),
    "Scale": lambda df, columns, params, state: _each(df, list(state), lambda c: F.col(c) * F.lit(state[c][1]) + F.lit(state[c][0])),
    "RenameColumns": lambda df, columns, params, _: df.withColumnsRenamed({v: k for k, v in params["mapping"].items()}),
}


@dataclass
class StepSpec:
    type: str
    columns: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    id: str = ""
    description: str = ""
    state: dict | None = None

    @staticmethod
    def of(d: dict) -> StepSpec:
        kind = (d.get("type") or d.get("transformer") or d.get("action")).removesuffix("Transformer")
        if kind not in STEPS:
            raise ValueError(f"unknown step {kind}; known: {sorted(STEPS)}")
        return StepSpec(kind, list(d.get("columns") or []), dict(d.get("params") or {}), d.get("id", ""), d.get("description", ""), d.get("state"))


@dataclass
class Pipeline:
    steps: list[StepSpec]
    target_column: str | None = None

    @staticmethod
    def compile(spec: str | dict) -> Pipeline:
        d = json.loads(spec) if isinstance(spec, str) else spec
        return Pipeline([StepSpec.of(s) for s in d["steps"]], d.get("target_column"))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            fit, apply = STEPS[s.type]
            s.state = fit(df, s.columns, s.params) if fit else None
            df = apply(df, s.columns, s.params, s.state)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = STEPS[s.type][1](df, s.columns, s.params, s.state)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Undoes the steps that have an inverse, last first; the others are left as they are."""
        for s in reversed(self.steps):
            if s.type in INVERSES:
                df = INVERSES[s.type](df, s.columns, s.params, s.state)
        return df

    def to_json(self) -> str:
        return json.dumps({"target_column": self.target_column, "steps": [vars(s) for s in self.steps]})
