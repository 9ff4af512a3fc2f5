"""Additive step-function models: classifier, regressor, partitioned and surrogate forms."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.operators import calibration, gram, scoring, stats, tree
from lumenstep.operators.params import StepParams
from lumenstep.operators.stats import Stats
from lumenstep.operators.tree import Node

PROFILE_DDL = "feature string, kind string, node_id int, lower double, upper double, category string, is_null boolean, score double, mean double, freq double, raw double"


@dataclass
class StepModel:
    """Fitted state shared by both models; `stats` make refits free of scans."""

    params: StepParams = field(default_factory=StepParams)
    alpha: float = 0.1
    target: str = ""
    own_params: dict[str, StepParams] = field(default_factory=dict)
    stats: Stats | None = None
    profile: dict[str, list[Node]] = field(default_factory=dict)
    base: float = 0.0
    meta: dict = field(default_factory=dict)
    regression = False

    @property
    def features(self) -> list[str]:
        return list(self.profile)

    def params_of(self, feature: str) -> StepParams:
        return self.own_params.get(feature, self.params)

    def fit(self, df: DataFrame, target: str, features: list[str] | None = None, id_columns: tuple[str, ...] = ()):
        began = time.time()
        self.target, self.own_params = target, {}
        numeric, categorical = stats.roles(df, features, [target, *id_columns])
        found = stats.collect(df, target, numeric, categorical)
        self.stats = found.get((), Stats())
        order = [c for c in (features or df.columns) if c in self.stats.features]
        self.stats.features = {c: self.stats.features[c] for c in order}
        self.rebuild()
        self._finish(df)
        self.meta = {"observations": self.stats.n, "features": len(order), "fit_seconds": time.time() - began}
        return self

    def rebuild(self) -> None:
        """Profile from the cached statistics alone."""
        s = self.stats
        self.base = s.base
        grown = tree.wide_leaves(s.features, s.n, s.base, self.params_of, self.alpha) if s.n else {}
        self.profile = {k: tree.nodes(k, f, s.n, s.base, self.params_of(k), self.alpha, self.regression, grown.get(k)) for k, f in s.features.items()} if s.n else {}
        self._normalise()

    def _normalise(self) -> None:
        pass

    def _finish(self, df: DataFrame | None) -> None:
        pass

    def refit(self, features: list[str] | None = None, df: DataFrame | None = None, **changes):
        """New parameters for some features (all: None); df recalibrates or solves again."""
        if self.stats is None:
            raise ValueError("this model was saved without its statistics and cannot be refitted")
        if features is None:
            self.params, self.own_params = self.params.updated(**changes), {k: p.updated(**changes) for k, p in self.own_params.items()}
        else:
            self.own_params |= {k: self.params_of(k).updated(**changes) for k in features}
        self.rebuild()
        self._finish(df)
        return self

    def score_column(self, df: DataFrame) -> Column:
        """The score as one expression, for streams and plain projections."""
        out = F.lit(self.base)
        for k, v in self.profile.items():
            out = out + scoring.lookup(df, k, v, lambda n: n.score)
        return out

    def explain(self, df: DataFrame) -> DataFrame:
        """df plus contribution_<feature>, base_value and score."""
        out = scoring.with_contributions(df, self.profile).withColumn("base_value", F.lit(self.base))
        return out.withColumn("score", scoring.total(self.base, self.features))

    def score(self, df: DataFrame) -> DataFrame:
        out = self.explain(df)
        return out.drop("base_value", *[f"contribution_{k}" for k in self.features])

    def leaf_ids(self, df: DataFrame) -> DataFrame:
        return scoring.with_contributions(df, self.profile, lambda n: n.node_id, "leaf_")

    def importances(self) -> dict[str, float]:
        return tree.importances(self.profile)

    def profile_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(n).values()) for v in self.profile.values() for n in v], PROFILE_DDL)

    def nested_profile(self) -> dict:
        """base_value, numeric and categorical: the nodes of each feature as dicts, the null node last; no nodes where only one is left."""
        out: dict = {"base_value": self.base, "numeric": {}, "categorical": {}}
        for k, nodes in self.profile.items():
            kind = "numeric" if any(n.kind == "numeric" for n in nodes) else "categorical"
            edges = ("lower", "upper") if kind == "numeric" else ("category",)
            out[kind][k] = [{name: getattr(n, name) for name in (*edges, "score", "mean", "freq")} for n in nodes] if len(nodes) > 1 else []
        return out

    def plot_data(self, spark, rounding: int = 5) -> DataFrame:
        """Chart rows: a label for each leaf with contribution, mean and frequency."""
        edge = lambda c: F.round(c, rounding).cast("string")
        label = F.when(F.col("is_null"), "Null").when(F.col("kind") == "numeric", F.concat(edge(F.col("lower")), F.lit(" - "), edge(F.col("upper")))).otherwise(F.col("category"))
        return self.profile_frame(spark).select("feature", "node_id", label.alias("value"), F.col("score").alias("contribution"), "mean", F.col("freq").alias("frequency"), F.round(F.col("score") * 100, 1).alias("score_label"))

    def to_json(self, statistics: bool = True) -> str:
        """The whole model; infinities as null, the null node last.  Without statistics it scores but cannot be refitted."""
        safe = lambda x: None if isinstance(x, float) and not np.isfinite(x) else x
        nodes = [{k: safe(v) for k, v in asdict(n).items()} for v in self.profile.values() for n in v]
        return json.dumps({"kind": type(self).__name__, "target": self.target, "base": self.base, "alpha": self.alpha, "params": asdict(self.params), "own_params": {k: asdict(p) for k, p in self.own_params.items()}, "profile": nodes, "extra": self._extra(), "stats": self.stats.plain() if statistics and self.stats else None})

    def _extra(self) -> dict:
        return {}

    @staticmethod
    def from_json(text: str) -> StepModel:
        d = json.loads(text)
        if d["kind"] == "PartitionedModel":
            return PartitionedModel.from_json(text)
        kind = {"StepClassifier": StepClassifier, "StepRegressor": StepRegressor}[d["kind"]]
        model = kind(params=StepParams(**d["params"]), alpha=d["alpha"], target=d["target"], base=d["base"], own_params={k: StepParams(**p) for k, p in d["own_params"].items()})
        for n in d["profile"]:
            if n["kind"] == "numeric" and not n["is_null"]:
                n |= {"lower": -np.inf if n["lower"] is None else n["lower"], "upper": np.inf if n["upper"] is None else n["upper"]}
            model.profile.setdefault(n["feature"], []).append(Node(**n))
        for k, v in d["extra"].items():
            setattr(model, k, dict(enumerate(v)) if k == "classes" else v)
        model.stats = Stats.of_plain(d["stats"]) if d.get("stats") else None
        return model


@dataclass
class StepClassifier(StepModel):
    """Two classes; scores lie in [0, 1]."""

    calibrate: bool = True
    calibration: list[float] = field(default_factory=list)
    support: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)
    named_target: str = ""

    def fit(self, df, target, features=None, id_columns=()):
        self.classes, self.named_target = {}, target
        if dict(df.dtypes)[target] == "string":
            df, self.classes = stats.encode_target(df, target, "_encoded_target")
            id_columns, target = (*id_columns, target), "_encoded_target"
        return super().fit(df, target, features, id_columns)

    def _normalise(self) -> None:
        self.profile = tree.normalised(self.profile, self.base, {k: self.params_of(k) for k in self.profile})

    def _finish(self, df: DataFrame | None) -> None:
        if self.calibrate and df is not None:
            if self.target not in df.columns and self.classes and self.named_target in df.columns:
                df = stats.with_codes(df, self.named_target, self.target, self.classes)
            if self.target not in df.columns:
                raise ValueError(f"no column {self.named_target or self.target} to calibrate on")
            known = df.where(F.col(f"`{self.target}`").isNotNull())
            rows = calibration.bins(known, self.score_column(known), F.col(f"`{self.target}`")).collect()
            self.support = {str(r.bin): r.n for r in rows}
            self.calibration = calibration.smoothed([(r.bin, r.n, r["mean"]) for r in rows])

    def _extra(self) -> dict:
        return {"calibration": self.calibration, "support": self.support, "classes": [self.classes[k] for k in sorted(self.classes)], "named_target": self.named_target}

    def predict(self, df: DataFrame, threshold: float = 0.5, use_prob: bool = False) -> DataFrame:
        """df plus score, proba and prediction (strictly above the threshold is the second class)."""
        out = self.score(df)
        out = out.withColumn("proba", calibration.probability(F.col("score"), self.calibration) if self.calibration else F.lit(None).cast("double"))
        hit = F.col("proba" if use_prob else "score") > threshold
        named = F.when(hit, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])) if len(self.classes) == 2 else hit.cast("int")
        return out.withColumn("prediction", named)

    def predict_explain(self, df: DataFrame) -> DataFrame:
        """Contributions with score, proba, multiplier (proba over base) and the support of the score's bin."""
        out = self.explain(df).withColumn("proba", calibration.probability(F.col("score"), self.calibration) if self.calibration else F.lit(None).cast("double"))
        seen = F.array(*[F.lit(int(self.support.get(str(b), 0))) for b in range(calibration.BINS)])
        return out.withColumn("multiplier", F.try_divide("proba", F.lit(self.base))).withColumn("support", F.element_at(seen, calibration.bin_of(F.col("score")) + 1))


@dataclass
class StepRegressor(StepModel):
    """Leaf scores are re-weighted by a ridge fit over leaf indicators."""

    ridge: float = 1.0
    prediction_range: tuple = (-np.inf, np.inf)
    regression = True

    def _normalise(self) -> None:
        self.profile = {k: [replace(n, score=n.raw) for n in v] for k, v in self.profile.items()}

    def _finish(self, df: DataFrame | None) -> None:
        if df is not None and self.profile:
            self.solve(gram.leaf_sums(df, self.target, {None: self.profile})[None])

    def solve(self, sums: gram.LeafSums) -> None:
        """Normal equations from counts of leaf pairs; the driver sees leaves, never rows."""
        flat = [n for v in self.profile.values() for n in v]
        at, count, total, both = len(flat), sums.count, sums.total, sums.both
        n, raw = self.stats.n, np.array([x.raw for x in flat])
        mean_y, mean_x = self.stats.base, raw * count / n
        normal = both * np.outer(raw, raw) - n * np.outer(mean_x, mean_x) + self.ridge * np.eye(at)
        weights = np.linalg.solve(normal, raw * total - n * mean_x * mean_y)
        self.base = float(mean_y - mean_x @ weights)
        scores = iter(raw * weights)
        self.profile = {k: [replace(x, score=float(next(scores))) for x in v] for k, v in self.profile.items()}

    def _extra(self) -> dict:
        return {"prediction_range": [None if not np.isfinite(x) else x for x in self.prediction_range]}

    def predict(self, df: DataFrame) -> DataFrame:
        """df plus prediction, clipped to prediction_range."""
        low, high = (x if x is not None else s * np.inf for x, s in zip(self.prediction_range, (-1, 1)))
        return self.score(df).withColumn("prediction", F.least(F.greatest("score", F.lit(float(low))), F.lit(float(high)))).drop("score")

    def tune_tails(self, df: DataFrame, low: float = 1.0, high: float = 2.0, rounds: int = 6) -> StepRegressor:
        """Bounded ternary search of tail_sensitivity by mean absolute error; one scan a trial."""

        def error(t: float) -> float:
            self.refit(None, df, tail_sensitivity=t)
            return self.predict(df).agg(F.avg(F.abs(F.col("prediction") - F.col(f"`{self.target}`")))).first()[0]

        for _ in range(rounds):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if error(a) <= error(b) else (a, high)
        return self.refit(None, df, tail_sensitivity=(low + high) / 2)


@dataclass
class PartitionedModel:
    """A model for each value of a column and one for all rows; statistics of all come from one job."""

    kind: type = StepClassifier
    params: StepParams = field(default_factory=StepParams)
    column: str = ""
    models: dict[str, StepModel] = field(default_factory=dict)
    classes: dict = field(default_factory=dict)
    ALL = "__dataset__"

    @property
    def regression(self) -> bool:
        return self.kind is StepRegressor

    @property
    def features(self) -> list[str]:
        return list({k: None for m in self.models.values() for k in m.features})

    def fit(self, df: DataFrame, target: str, column: str, features: list[str] | None = None, max_partitions: int = 200) -> PartitionedModel:
        """Values of `column` are compared as text; more than max_partitions are refused (they become plan text)."""
        self.column, self.classes, named = column, {}, target
        if df.select(column).distinct().limit(max_partitions + 1).count() > max_partitions:
            raise ValueError(f"more than {max_partitions} partitions")
        if not self.regression and dict(df.dtypes)[target] == "string":
            df, self.classes = stats.encode_target(df, target, "_encoded_target")
            target = "_encoded_target"
        numeric, categorical = stats.roles(df, features, [target, named, column])
        order = features or [c for c in df.columns if c in {*numeric, *categorical}]
        found = stats.collect(df, target, numeric, categorical, [column])
        parts = {k[0]: s for k, s in found.items() if k[0] is not None} | {self.ALL: Stats.merged(list(found.values()))}
        for value, s in parts.items():
            model = self.kind(params=self.params, target=target)
            if not model.regression:
                model.classes, model.named_target = self.classes, named
            model.stats = s
            s.features = {c: s.features[c] for c in order if c in s.features}
            model.rebuild()
            self.add(value, model)
        if self.regression:
            profiles = {None if value == self.ALL else value: m.profile for value, m in self.models.items() if m.profile}
            for value, sums in gram.leaf_sums(df, target, profiles, column).items():
                self.models[self.ALL if value is None else value].solve(sums)
        if self.kind is StepClassifier:
            scored = df.select(F.col(f"`{target}`").cast("double").alias("_y"), self._score(df).alias("_s"), self._route(df).alias("_p")).where("_y is not null")
            rows = scored.select("_p", "_y", calibration.bin_of(F.col("_s")).alias("bin")).where("bin is not null").groupBy("_p", "bin").agg(F.count("*").alias("n"), F.avg("_y").alias("mean")).collect()
            for value, model in self.models.items():
                own = [(r.bin, r.n, r["mean"]) for r in rows if r._p == value]
                model.calibration = calibration.smoothed(own) if own else []
            self.models[self.ALL]._finish(df)
        return self

    def add(self, value, model: StepModel) -> None:
        classes = {json.dumps(getattr(m, "classes", {})) for m in [model, *self.models.values()]}
        if len(classes) > 1:
            raise ValueError("partitions must map their targets alike")
        self.models[str(value)] = model

    def drop(self, value) -> None:
        self.models.pop(str(value))

    def _route(self, df: DataFrame) -> Column:
        key = F.col(f"`{self.column}`").cast("string")
        return F.when(key.isin(*[k for k in self.models if k != self.ALL]), key).otherwise(F.lit(self.ALL))

    def _by_part(self, df: DataFrame, of: Callable[[StepModel], Column]) -> Column:
        key, out = F.col(f"`{self.column}`").cast("string"), of(self.models[self.ALL])
        for value, model in self.models.items():
            if value != self.ALL:
                out = F.when(key == value, of(model)).otherwise(out)
        return out

    def _score(self, df: DataFrame) -> Column:
        return self._by_part(df, lambda m: m.score_column(df))

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self._score(df))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Classes by `>=` of the threshold, or values clipped to each model's range; unknown partitions use all rows' model."""
        out = self.score(df)
        if self.kind is StepRegressor:
            edge = lambda m, i: m.prediction_range[i] if m.prediction_range[i] is not None else (-np.inf, np.inf)[i]
            low, high = (self._by_part(df, lambda m, i=i: F.lit(float(edge(m, i)))) for i in (0, 1))
            return out.withColumn("prediction", F.least(F.greatest("score", low), high)).drop("score")
        proba = self._by_part(df, lambda m: calibration.probability(F.col("score"), m.calibration) if m.calibration else F.lit(None).cast("double"))
        hit = F.col("score") >= threshold
        named = F.when(hit, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])) if len(self.classes) == 2 else hit.cast("int")
        return out.withColumn("proba", proba).withColumn("prediction", named)

    def explain(self, df: DataFrame) -> DataFrame:
        """df plus contribution_<feature>, base_value and score, each by the row's own model; 0 for features it has not."""
        part = lambda k: lambda m: scoring.lookup(df, k, m.profile[k], lambda n: n.score) if k in m.profile else F.lit(0.0)
        out = df.withColumns({f"contribution_{k}": self._by_part(df, part(k)) for k in self.features} | {"base_value": self._by_part(df, lambda m: F.lit(m.base))})
        return out.withColumn("score", sum((F.col(f"`contribution_{k}`") for k in self.features), F.col("base_value")))

    def to_json(self, statistics: bool = True) -> str:
        parts = {k: json.loads(m.to_json(statistics)) for k, m in self.models.items()}
        return json.dumps({"kind": "PartitionedModel", "of": self.kind.__name__, "column": self.column, "params": asdict(self.params), "classes": [self.classes[k] for k in sorted(self.classes)], "models": parts})

    @staticmethod
    def from_json(text: str) -> PartitionedModel:
        d = json.loads(text)
        kind = {"StepClassifier": StepClassifier, "StepRegressor": StepRegressor}[d["of"]]
        models = {k: StepModel.from_json(json.dumps(m)) for k, m in d["models"].items()}
        return PartitionedModel(kind, StepParams(**d["params"]), d["column"], models, dict(enumerate(d["classes"])))


def surrogate(kind: type, df: DataFrame, predict: Callable[[DataFrame], DataFrame] | Column, features: list[str] | None = None, **options) -> StepModel:
    """Explain a black box: fit a model of `kind` on its predictions (a Column, or df -> df with `prediction`)."""
    out = df.withColumn("prediction", predict) if isinstance(predict, Column) else predict(df)
    return kind(**options).fit(out, "prediction", features or [c for c in df.columns if c != "prediction"])
