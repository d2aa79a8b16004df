"""Models of the remaining demand, and the registry of what can be fitted."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadtide.functions.metrics import score
from leadtide.operators import boosting, frames
from leadtide.operators.features import FEATURES, inference_frame, training_frame
from leadtide.operators.order import quantiles as exact_quantiles
from leadtide.sources.artifacts import digest, read_json, verify, write_json, write_table
from leadtide.sources.shared import written
from leadtide.sources.tables import Log

#: The source's bands of horizons; fixed values.
BANDS = ((1, 14), (15, 30))
#: The source's model: 400 trees of 127 leaves, 40 rows a leaf, step 0.06, 0.9 of the rows and 0.8 of the features a tree; fixed values.
PRODUCTION = {"trees": 400, "leaves": 127, "step": 0.06, "least": 40, "rows": 0.9, "columns": 0.8}


def in_band(bands: tuple[tuple[int, int], ...]) -> Column:
    """The place of the band that holds a row's horizon."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(bands):
        out = F.when(F.col("days_to_checkin").between(a, b), i).otherwise(out)
    return out


@dataclass
class BandedModel:
    """One model for each band of horizons; a horizon outside of all is an error."""

    bands: tuple[tuple[int, int], ...]
    models: list[boosting.Model]
    log_target: bool = True

    @property
    def features(self) -> tuple[str, ...]:
        return self.models[0].features

    def predict(self, frame: DataFrame) -> DataFrame:
        """Adds model_demand: what is seen and what the band's model expects on top, never less."""
        return demanded({0: self}, frame, F.lit(0))

    def importances(self) -> list[tuple[str, float]]:
        """Mean share of each feature in the gains of the bands."""
        shares = [m.gains() for m in self.models]
        mean = sum(s / max(s.sum(), 1e-12) for s in shares) / len(shares)
        return sorted(zip(self.features, map(float, mean), strict=True), key=lambda x: (-x[1], x[0]))

    def drivers(self, frame: DataFrame, keys: list[str]) -> DataFrame:
        """keys, base, contributions: the parts of the raw prediction by feature; they and the base add up to it."""
        return boosting.explained(frame.withColumn("_band", in_band(self.bands)), dict(enumerate(self.models)), "_band", keys)


def demanded(models: dict[int, BandedModel], frame: DataFrame, which: Column, name: str = "model_demand") -> DataFrame:
    """Adds the demand that the row's model (``which``: its number) expects."""
    any_model = next(iter(models.values()))
    width = len(any_model.bands)
    flat = {k * width + i: m for k, x in models.items() for i, m in enumerate(x.models)}
    band = F.coalesce(in_band(any_model.bands), F.raise_error(F.lit("a horizon lies in no band")).cast("int"))
    out = boosting.predicted(frame.withColumn("_number", which * width + band), flat, "_number", "_raw")
    more = F.expm1("_raw") if any_model.log_target else F.col("_raw")
    return out.withColumn(name, F.col("observed_total") + F.greatest(more, F.lit(0.0))).drop("_raw", "_number")


def head_name(alpha: float) -> str:
    """The column of a quantile's demand: demand_10 for 0.1, demand_2_5 for 0.025. A dot would be read as a field of a struct."""
    return f"demand_{100 * alpha:.6g}".replace(".", "_")


def ordered_heads(heads: dict[float, BandedModel], frame: DataFrame) -> DataFrame:
    """Adds a demand for each quantile; where heads cross, a row's demands are put in order."""
    names = {a: head_name(a) for a in sorted(heads)}
    for a, name in names.items():
        frame = demanded({0: heads[a]}, frame, F.lit(0), name)
    ordered = F.array_sort(F.array(*names.values()))
    return frame.withColumns({name: ordered[i] for i, name in enumerate(names.values())})


def fit_groups(training: DataFrame, group: Column, groups: int, bands: tuple[tuple[int, int], ...] = BANDS, log_target: bool = True, features: tuple[str, ...] = FEATURES, alphas: tuple[float, ...] = (0.5,), **params) -> dict[float, list[BandedModel]]:
    """By quantile the models of ``groups`` groups of rows (folds, say), whose trees all grow in the same jobs."""
    target = F.col("remaining_demand").cast("double")
    rows = training.withColumn("_band", in_band(bands)).filter("_band IS NOT NULL")
    rows = rows.select((group * len(bands) + F.col("_band")).cast("int").alias("model"), (F.log1p(target) if log_target else target).alias("label"), *features)
    return _banded(boosting.fit(rows, features, groups * len(bands), boosting.with_params(**params), alphas), groups, bands, log_target, alphas)


def _banded(found: dict, groups: int, bands: tuple, log_target: bool, alphas: tuple[float, ...]) -> dict[float, list[BandedModel]]:
    return {a: [BandedModel(bands, [found[g * len(bands) + i, a] for i in range(len(bands))], log_target) for g in range(groups)] for a in alphas}


def fit_logs(logs: list[Log], bands: tuple[tuple[int, int], ...] = BANDS, log_target: bool = True, features: tuple[str, ...] = FEATURES, alphas: tuple[float, ...] = (0.5,), extra: DataFrame | None = None, **params) -> dict[float, list[BandedModel]]:
    """`fit_groups` on the training frames of logs, a group each, of which none is written. extra: further features of a city."""
    lessons = frames.CityLessons(logs, bands, features, log_target, extra)
    return _banded(boosting.fit(lessons, features, len(logs) * len(bands), boosting.with_params(**params), alphas), len(logs), bands, log_target, alphas)


def fit_bands(training: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, log_target: bool = True, features: tuple[str, ...] = FEATURES, **params) -> BandedModel:
    return fit_groups(training, F.lit(0), 1, bands, log_target, features, **params)[0.5][0]


def save_bundle(model: BandedModel, training: DataFrame, path: str, **about) -> None:
    """A fitted model below a path, with what it was fitted on: its trees as a table, and a manifest with its features, bins and the data's digest."""
    spark = training.sparkSession
    rows = [(i, k, *([x.item() for x in getattr(t, c)] for c in boosting.NODE)) for i, m in enumerate(model.models) for k, t in enumerate(m.trees)]
    kinds = ", ".join(f"{c} array<{'double' if boosting.KINDS[c] is np.float64 else 'long'}>" for c in boosting.NODE)
    write_table(spark.createDataFrame(rows, f"band int, tree int, {kinds}"), f"{path}/trees")
    bins = [{"base": m.base, "alpha": m.alpha, "edges": [[float(x) for x in e if np.isfinite(x)] for e in m.edges], "width": m.edges.shape[1]} for m in model.models]
    write_json(spark, {"bands": [list(b) for b in model.bands], "log_target": model.log_target, "features": list(model.features), "bins": bins, "digest": digest(training), **about}, f"{path}/manifest.json")


def load_bundle(spark: SparkSession, path: str, training: DataFrame | None = None, features: tuple[str, ...] = FEATURES) -> BandedModel:
    """A saved model; with ``training`` only if it was fitted on these rows. Other features than those asked for are refused."""
    about = read_json(spark, f"{path}/manifest.json")
    if about["features"] != list(features):
        raise ValueError(f"{path} was fitted on other features")
    if training is not None:
        verify(training, about["digest"], "the training table")
    trees: dict[int, list[boosting.Tree]] = {}
    for r in spark.read.parquet(f"{path}/trees").orderBy("band", "tree").collect():
        trees.setdefault(r.band, []).append(boosting.Tree(**{c: np.array(r[c], boosting.KINDS[c]) for c in boosting.NODE}))
    models = []
    for i, x in enumerate(about["bins"]):
        edges = np.full((len(features), x["width"]), np.inf)
        for j, e in enumerate(x["edges"]):
            edges[j, : len(e)] = e
        models.append(boosting.Model(tuple(features), edges, x["base"], x["alpha"], trees.get(i, [])))
    return BandedModel(tuple(tuple(b) for b in about["bands"]), models, about["log_target"])


Spec = Callable[[DataFrame, DataFrame], DataFrame]


def model_backtest(logs: list[Log], specs: dict[str, Spec], actual: DataFrame) -> tuple[DataFrame, list[dict]]:
    """model, fold_cutoff, city_code, checkin, horizon, observed, actual, prediction of every spec in every fold, and the failures.

    A spec takes the training and inference frames of all folds, told apart by fold_cutoff, and returns the latter with
    `prediction`; it must learn a fold's model from that fold's lessons only. The frames are written once and read by all
    specs, that of lessons only if a spec has no `from_logs`, which takes the logs instead; one spec that fails doesn't end the run.
    actual: fold_cutoff, city_code, checkin, actual.
    """
    united = lambda parts: written(reduce(DataFrame.unionByName, parts))
    lessons = None if all(hasattr(x, "from_logs") for x in specs.values()) else united([training_frame(x) for x in logs])
    ahead = united([inference_frame(x) for x in logs])
    out, failures = None, []
    for name, spec in specs.items():
        try:
            own = spec.from_logs(logs, ahead) if hasattr(spec, "from_logs") else spec(lessons, ahead)
            own = written(own.select(F.lit(name).alias("model"), "fold_cutoff", "city_code", "checkin", F.col("days_to_checkin").alias("horizon"), F.col("observed_total").alias("observed"), F.col("prediction").cast("double").alias("prediction")))
        except Exception as e:  # noqa: BLE001  what a model raises is its result here
            failures.append({"model": name, "reason": f"{type(e).__name__}: {e}"[:500]})
            continue
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise RuntimeError(f"every model failed: {failures[:5]}")
    return out.join(actual, ["fold_cutoff", "city_code", "checkin"]), failures


def suite_scores(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores of a suite by model (and fold, horizon bucket, ...), the least WAPE first in `rank`."""
    out = predictions.groupBy("model", *by).agg(*score("actual", "prediction"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("wape", "model")))


def baseline_spec(lessons: DataFrame, ahead: DataFrame) -> DataFrame:
    """The pickup baseline: demand seen by its expected share; needs no fit."""
    return ahead.withColumn("prediction", F.col("pickup_baseline_prediction"))


baseline_spec.from_logs = lambda logs, ahead: baseline_spec(ahead, ahead)


def gbt_spec(**params) -> Spec:
    """Boosted trees, a model for each fold and band; all grow in the same jobs."""

    def spec(lessons: DataFrame, ahead: DataFrame) -> DataFrame:
        folds = [r[0] for r in ahead.select("fold_cutoff").distinct().orderBy("fold_cutoff").collect()]  # a few dates
        number = place(folds)
        found = fit_groups(lessons, number, len(folds), **params)[0.5]
        return demanded(dict(enumerate(found)), ahead, number, "prediction")

    def from_logs(logs: list[Log], ahead: DataFrame, extra: DataFrame | None = None) -> DataFrame:
        found = fit_logs(logs, extra=extra, **params)[0.5]
        return demanded(dict(enumerate(found)), ahead, place([x.cfg.cutoff for x in logs]), "prediction")

    def place(folds: list) -> Column:
        number = F.lit(None).cast("int")
        for i, cutoff in enumerate(folds):
            number = F.when(F.col("fold_cutoff") == F.lit(cutoff), i).otherwise(number)
        return number

    spec.from_logs = from_logs
    return spec


def wants_log(df: DataFrame, target: str = "y") -> DataFrame:
    """Whether a target is better learned in logs: over 0.4 zeros, or spread over 1.5 times its mean."""
    d = F.col(target).cast("double")
    out = df.agg(F.avg((d == 0).cast("double")).alias("zero_ratio"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"))
    return out.withColumn("use_log", (F.col("zero_ratio") > 0.4) | (F.col("std") > 1.5 * F.col("mean")))


def encoded_static(entities: DataFrame, columns: list[str], most: int = 200) -> tuple[DataFrame, list[str]]:
    """Texts with 2 to ``most`` values as numbers; others are left out. Needs one small aggregate."""
    counts = entities.agg(*(F.countDistinct(c).alias(c) for c in columns)).first()
    keep = [c for c in columns if 1 < counts[c] <= most]
    if not keep:
        return entities, []
    indexer = StringIndexer(inputCols=keep, outputCols=[f"{c}_code" for c in keep], stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(entities).transform(entities), keep


def tweedie(features: list[str], label: str, power: float = 1.2) -> Pipeline:
    """A linear model of counts with many zeros."""
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, featuresCol="_x", labelCol=label, predictionCol="prediction", maxIter=25, regParam=0.01)])


def dependence(frame: DataFrame, feature: str, value: str, bins: int = 10) -> DataFrame:
    """Mean of a value by quantile bin of a feature."""
    points = tuple(i / bins for i in range(1, bins))
    edges = F.broadcast(exact_quantiles(frame, [], feature, points).select(F.col("q").alias("_e")))  # one row
    rows = frame.crossJoin(edges).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(feature))))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.avg(feature).alias("feature_mean"), F.avg(value).alias("value_mean"))


DRIVERS = (("market_", "market"), ("province_", "province"), ("pickup_", "pickup"), ("days_", "lead time"), ("observed", "pickup"), ("active", "activity"), ("mean_daily", "activity"), ("jalali", "calendar"), ("checkin_weekday", "calendar"), ("is_weekend", "calendar"), ("city_", "city"), ("lat", "city"), ("long", "city"), ("expected", "curve"), ("checkin_day", "calendar"), ("max_daily", "activity"), ("std_daily", "activity"), ("search_span", "activity"))


def driver(feature: str) -> str:
    """The group of drivers a feature belongs to."""
    return next((group for start, group in DRIVERS if feature.startswith(start)), "other")


def rolled_up(parts: DataFrame, features: tuple[str, ...], keys: list[str]) -> DataFrame:
    """keys, driver, up, down, contribution: sums of a row's contributions by group of drivers, above and below 0 and together."""
    groups = F.array(*(F.lit(driver(c)) for c in features))
    long = parts.select(*keys, F.inline(F.arrays_zip(groups.alias("driver"), F.col("contributions").alias("part"))))
    return long.groupBy(*keys, "driver").agg(F.sum(F.greatest("part", F.lit(0.0))).alias("up"), F.sum(F.least("part", F.lit(0.0))).alias("down"), F.sum("part").alias("contribution"))


@dataclass
class Entry:
    name: str
    is_baseline: bool
    build: Callable | None
    needs: tuple[str, ...] = field(default=())

    @property
    def reason(self) -> str | None:
        """Why the model can't be used here."""
        lacking = [m for m in self.needs if importlib.util.find_spec(m) is None]
        return f"needs {', '.join(lacking)}" if lacking else None


REGISTRY = {
    e.name: e
    for e in (
        *(Entry(n, True, None) for n in ("naive", "seasonal_naive", "moving_average", "historical_mean", "seasonal_mean")),
        Entry("gbt", False, fit_bands),
        Entry("tweedie", False, tweedie),
        Entry("lightgbm", False, None, ("lightgbm",)),
        Entry("catboost", False, None, ("catboost",)),
        Entry("chronos", False, None, ("chronos", "torch")),
        Entry("nhits", False, None, ("neuralforecast",)),
    )
}


def candidates(names: list[str]) -> list[str]:
    """Learned models; baselines too where fewer than two are left."""
    usable = [n for n in names if n in REGISTRY and REGISTRY[n].reason is None]
    learned = [n for n in usable if not REGISTRY[n].is_baseline]
    return learned if len(learned) >= 2 else usable


def time_folds(cutoff, days: int, folds: int, gap: int = 0) -> list[tuple]:
    """(last training date, first and last test date) of rolling origins, the latest last."""
    from datetime import timedelta

    out = []
    for k in range(folds, 0, -1):
        end = cutoff - timedelta(days=days * (k - 1))
        start = end - timedelta(days=days - 1)
        out.append((start - timedelta(days=1 + gap), start, end))
    return out


def search(training: DataFrame, day: str, split, grid: list[dict], fit: Callable[[DataFrame, dict], object], error: Callable[[object, DataFrame], float]) -> tuple[dict, float]:
    """The parameters with the least error on the dates after ``split``; never a random split."""
    past, later = training.filter(F.col(day) <= F.lit(split)), training.filter(F.col(day) > F.lit(split))
    scored = [(error(fit(past, p), later), i) for i, p in enumerate(grid)]
    best, at = min(scored)
    return grid[at], best
