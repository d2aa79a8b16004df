"""Calibration of the remaining demand, intervals from residuals, stability of repeated forecasts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.config import Config
from leadtide.functions.metrics import score
from leadtide.operators.asof import bucket_label, complete_grid, pair_state, seen
from leadtide.operators.curves import FOLD, with_fraction, with_zero_prior
from leadtide.operators.order import order_statistics
from leadtide.operators.order import quantiles as exact_quantiles
from leadtide.sources.shared import drop, written
from leadtide.sources.tables import Log

#: The grid of scale factors and the guards.
ALPHAS = [round(0.80 + 0.01 * i, 2) for i in range(161)]
METHODS = ("none", "global", "horizon", "horizon_shrunk", "bias_global", "bias_horizon_shrunk", "guarded_bias_horizon")


def scaled(observed: Column, predicted: Column, alpha: Column) -> Column:
    """Only what is still to come is scaled."""
    return observed + alpha * F.greatest(predicted - observed, F.lit(0.0))


def best_alpha(frame: DataFrame, *by: str) -> DataFrame:
    """by, alpha (the factor with the least absolute error, the smaller of equals), unbiased (matches
    the totals), demand.

    A row's error is piecewise linear in the factor, with its kink at (actual - observed) / remainder. So
    rows are summed by the first factor at or above their kink, and errors of all factors follow from
    these at most 162 sums: each row below a factor adds factor * remainder - (actual - observed), each
    above it the opposite. Errors are compared to six decimals, so the order of summation doesn't choose.
    """
    a, o, p = (F.col(c).cast("double") for c in ("actual", "observed", "predicted_demand"))
    step, last = ALPHAS[1] - ALPHAS[0], len(ALPHAS)
    left = F.greatest(p - o, F.lit(0.0))
    kink = F.greatest(F.least(F.ceil(((a - o) / left - ALPHAS[0]) / step), F.lit(last)), F.lit(0)).cast("int")
    cells = frame.withColumns({"_a": a, "_real": a - o, "_left": left, "_cell": F.when(left > 0, kink).otherwise(-1)})
    cells = cells.groupBy(*by, "_cell").agg(F.sum("_a").alias("_a"), F.sum("_real").alias("_real"), F.sum("_left").alias("_left"), F.sum(F.abs("_real")).alias("_still"))
    moves = F.col("_cell") >= 0
    sums = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(moves, F.struct("_cell", F.struct("_left", "_real"))))).alias("_m"),
        F.coalesce(F.sum(F.when(~moves, F.col("_still"))), F.lit(0.0)).alias("_still"),
        F.coalesce(F.sum(F.when(moves, F.col("_real"))), F.lit(0.0)).alias("_moving"),
        F.sum("_real").alias("_real"), F.sum("_left").alias("_left"), F.sum("_a").alias("demand"),
    )
    none = F.struct(F.lit(0.0).alias("_left"), F.lit(0.0).alias("_real"))

    def through(acc: Column, x: Column) -> Column:
        own = F.coalesce(F.try_element_at("_m", x["i"]), none)
        w, d = acc["w"] + own["_left"], acc["d"] + own["_real"]
        error = F.round(x["alpha"] * (2 * w - F.col("_left")) - (2 * d - F.col("_moving")) + F.col("_still"), 6)
        return F.struct(w.alias("w"), d.alias("d"), F.concat(acc["e"], F.array(error)).alias("e"))

    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("alpha")) for i, x in enumerate(ALPHAS)))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("d"), F.array().cast("array<double>").alias("e"))
    sums = sums.withColumn("_e", F.aggregate(grid, start, through)["e"])
    at = F.array_position("_e", F.array_min("_e"))
    unbiased = F.least(F.greatest(F.when(F.col("_left") > 1e-9, F.try_divide(F.col("_real"), F.col("_left"))).otherwise(1.0), F.lit(ALPHAS[0])), F.lit(ALPHAS[-1]))
    empty = F.col("demand") < 1e-9
    return sums.select(*by, F.when(empty, 1.0).otherwise(F.element_at(F.array(*map(F.lit, ALPHAS)), at.cast("int"))).alias("alpha"), F.when(empty, 1.0).otherwise(unbiased).alias("unbiased"), "demand")


def calibrator(frame: DataFrame, cfg: Config, method: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bucket, factor: what each horizon bucket's remainder is scaled by; one small frame."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    guarded, bias = method == "guarded_bias_horizon", method.startswith("bias") or method == "guarded_bias_horizon"
    labels = [f"{a}-{b}" for a, b in cfg.horizon_buckets]
    buckets = F.explode(F.array(*map(F.lit, labels))).alias("bucket")
    frame = frame.withColumn("bucket", bucket_label(F.col("horizon"), cfg.horizon_buckets, "other"))
    overall = best_alpha(frame, *by).select(*by, F.col("unbiased" if bias else "alpha").alias("_g"))
    if guarded:
        overall = overall.withColumn("_g", F.least(F.greatest("_g", F.lit(0.95)), F.lit(1.10)))
    out = overall.select(*by, "_g", buckets)
    if method == "none":
        return out.select(*by, "bucket", F.lit(1.0).alias("factor"))
    if method in ("global", "bias_global"):
        return out.select(*by, "bucket", F.col("_g").alias("factor"))
    own = best_alpha(frame, *by, "bucket").select(*by, "bucket", F.col("unbiased" if bias else "alpha").alias("_a"), "demand")
    out = out.join(own, [*by, "bucket"], "left")
    weight = F.coalesce(F.try_divide(F.col("demand"), F.col("demand") + cfg.calibration_shrinkage), F.lit(0.0))
    if guarded:
        high = F.split("bucket", "-")[1].cast("int")
        most = F.when(high <= 21, 1.12).otherwise(1.08)
        factor = F.when(F.col("_a").isNull(), F.col("_g")).when(high <= 7, 1.0).otherwise(F.least(F.greatest(1 + weight * (F.col("_a") - 1), F.lit(0.95)), most))
    elif method.endswith("shrunk"):
        factor = F.coalesce(weight * F.col("_a") + (1 - weight) * F.col("_g"), F.col("_g"))
    else:
        factor = F.coalesce("_a", "_g")
    return out.select(*by, "bucket", factor.alias("factor"))


def calibrated(frame: DataFrame, factors: DataFrame, cfg: Config, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds calibrated_demand, never below what is seen."""
    rows = frame.withColumn("bucket", bucket_label(F.col("horizon"), cfg.horizon_buckets, "other"))
    rows = rows.join(F.broadcast(factors), [*by, "bucket"], "left")  # a row for each bucket (and fold)
    out = F.greatest(scaled(F.col("observed").cast("double"), F.col("predicted_demand"), F.coalesce("factor", F.lit(1.0))), F.col("observed").cast("double"))
    return rows.withColumn("calibrated_demand", out)


def cross_fitted(frame: DataFrame, cfg: Config, method: str) -> DataFrame:
    """Each fold calibrated on folds whose windows had closed at its cutoff; the first ones stay raw."""
    folds = F.array(*map(F.lit, cfg.fold_cutoffs))
    lessons = frame.withColumn("_of", F.explode(F.filter(folds, lambda c: F.date_add(F.col(FOLD), cfg.target_days) <= c)))
    factors = calibrator(lessons.drop(FOLD).withColumnRenamed("_of", FOLD), cfg, method, (FOLD,))
    return calibrated(frame, factors, cfg, (FOLD,))


def fold_bootstrap(scores: DataFrame, folds: int, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """The interval of the pooled WAPE over all ways to draw folds with replacement.

    ``folds`` counts the folds; where their number to its own power is above 100,000, 20,000 draws by hash count.
    """
    if folds < 2:
        raise ValueError("a bootstrap needs 2 folds at least")
    one = scores.select(F.col("actual_total").alias("a"), (F.col("wape") * F.col("actual_total")).alias("e"))
    if folds**folds > 100_000:
        numbered = one.withColumn("_k", F.row_number().over(Window.orderBy("a", "e")) - 1)  # a row for each fold
        draws = scores.sparkSession.range(20_000).select("id", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("_i"))
        picked = draws.withColumn("_k", F.pmod(F.xxhash64(F.lit(seed), "id", "_i"), F.lit(folds)).cast("int"))
        drawn = picked.join(F.broadcast(numbered), "_k").groupBy("id").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    else:
        drawn = reduce(lambda x, y: x.crossJoin(F.broadcast(y)).select((F.col("a") + F.col("a2")).alias("a"), (F.col("e") + F.col("e2")).alias("e")), [one.toDF("a2", "e2")] * (folds - 1), one)
    tail = (1 - confidence) / 2
    q = drawn.agg(F.percentile(F.col("e") / F.col("a"), F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count(F.lit(1)).alias("samples"))
    return q.select(F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "samples")


def ranked(rows: DataFrame, by: list[str], value: str, want: Callable[[Column], Column], n: str, name: str) -> DataFrame:
    """by, the number of values as ``n``, and as ``name`` the value of rank want(n), counted from the least."""
    found = order_statistics(rows, by, value, lambda size: F.array(want(size)))
    return found.select(*by, F.col("n").alias(n), F.col("values")[0].alias(name))


def residual_bands(history: DataFrame, current: DataFrame, coverage: float = 0.8, min_support: int = 100) -> DataFrame:
    """Adds lower, upper, support and band_source: intervals from relative errors of the past.

    The radius is the value of rank ceil((n + 1) * coverage) of a city's errors in a horizon bucket, of
    all in the bucket where those are too few, else of all.
    """
    past = history.withColumn("_r", F.abs(F.col("actual") - F.col("prediction")) / F.greatest(F.col("prediction"), F.lit(1.0)))
    out = current
    levels = (("city/horizon", ["city_code", "horizon_bucket"]), ("horizon", ["horizon_bucket"]), ("global", []))
    picks = []
    for i, (_, by) in enumerate(levels):
        n, rank = f"_n{i}", f"_v{i}"
        level = ranked(past, by, "_r", lambda size: F.ceil((size + 1) * coverage), n, rank)
        # Levels above the city are a few rows.
        out = out.join(level, by, "left") if i == 0 else out.join(F.broadcast(level), by or F.lit(True), "left")
        picks.append((F.col(n) >= min_support, F.col(rank), F.col(n)))
    choose = lambda i: F.when(picks[0][0], picks[0][i]).when(picks[1][0], picks[1][i]).when(picks[2][0], picks[2][i])
    out = out.withColumns({"_rad": choose(1), "support": choose(2)})
    source = F.when(F.col("_rad").isNull(), "unavailable").when(picks[0][0], "city/horizon").when(picks[1][0], "horizon").otherwise("global")
    width = F.col("_rad") * F.greatest(F.col("prediction"), F.lit(1.0))
    seen_now = F.col("observed").cast("double")
    out = out.withColumns({"band_source": source, "support": F.when(F.col("_rad").isNotNull(), F.col("support")).otherwise(0), "lower": F.when(F.col("_rad").isNotNull(), F.greatest(seen_now, F.col("prediction") - width)), "upper": F.when(F.col("_rad").isNotNull(), F.greatest(seen_now, F.col("prediction") + width))})
    return out.drop("_rad", *(f"_{x}{i}" for x in "nv" for i in range(3)))


def conformal_offsets(frame: DataFrame, buckets: tuple[tuple[int, int], ...], quantiles: tuple[float, ...] = (0.1, 0.9), least: int = 30) -> DataFrame:
    """bucket and residual quantiles; buckets with fewer than ``least`` rows take those of all rows."""
    residual = (F.col("actual") - F.col("predicted_demand")).alias("_r")
    last = f"{buckets[-1][0]}-{buckets[-1][1]}"
    rows = frame.filter("actual IS NOT NULL AND predicted_demand IS NOT NULL").select(F.coalesce(bucket_label(F.col("horizon"), buckets, None), F.lit(last)).alias("bucket"), residual)
    rows = written(rows)
    own = exact_quantiles(rows, ["bucket"], "_r", quantiles).select("bucket", "n", F.col("q").alias("_q"))
    pooled = F.broadcast(exact_quantiles(rows, [], "_r", quantiles).select(F.col("q").alias("_all")))  # one row
    drop(rows)
    labels = pooled.select("_all", F.explode(F.array(*(F.lit(f"{a}-{b}") for a, b in buckets))).alias("bucket"))
    chosen = labels.join(own, "bucket", "left").withColumn("_q", F.when(F.col("n") >= least, F.col("_q")).otherwise(F.col("_all")))
    return chosen.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), *(F.col("_q")[i].alias(f"q{int(100 * x)}") for i, x in enumerate(quantiles)))


def monotone(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quantile columns in ascending order within each row."""
    ordered = F.array_sort(F.array(*columns))
    return df.withColumn("_o", ordered).withColumns({c: F.col("_o")[i] for i, c in enumerate(columns)}).drop("_o")


def confidence(width: Column, level: Column, error: Column, horizon: Column, longest: int, history: Column, least_history: int = 90) -> Column:
    """1 less four weighted penalties, each between 0 and 1."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    penalty = 0.35 * clip(width / F.greatest(F.abs(level), F.lit(1e-6))) + 0.35 * clip(error) + 0.15 * clip(horizon / max(longest, 1)) + 0.15 * clip(1 - history / max(least_history, 1))
    return clip(1 - penalty)


def confidence_label(score_column: Column) -> Column:
    return F.when(score_column >= 0.66, "high").when(score_column >= 0.4, "medium").otherwise("low")


def snapshots(log: Log) -> DataFrame:
    """The pickup forecast of the days up to the cutoff as it would have been at each horizon.

    Curves and priors know nothing after the earliest snapshot: they are fitted at its date.
    """
    from datetime import timedelta

    cfg = log.cfg
    start = cfg.cutoff - timedelta(days=cfg.target_days - 1)
    anchor = start - timedelta(days=max(cfg.snapshot_horizons))
    early = Log.__new__(Log)
    early.__dict__ |= {k: v for k, v in log.__dict__.items() if k not in ("pairs", "sums")} | {"cfg": cfg.at(anchor), "folds": (anchor,)}
    grid = complete_grid(log.cities.select("city_code", "province_code"), start, cfg.cutoff)
    state = pair_state(grid, log.all.filter(F.col("checkin").between(F.lit(start), F.lit(cfg.cutoff))))
    rows = state.withColumns({FOLD: F.lit(anchor), "horizon": F.explode(F.array(*map(F.lit, cfg.snapshot_horizons)))})
    rows = rows.withColumns({"observed": seen("cum", F.col("horizon")), "actual": F.element_at("cum", 1)}).drop("daily", "cum")
    rows = with_zero_prior(with_fraction(rows, early), early)
    known = F.greatest(F.col("observed") / F.col("completion_fraction"), F.col("observed").cast("double"))
    return rows.withColumn("prediction", F.when(F.col("observed") > 0, known).otherwise(F.col("zero_level"))).select("city_code", "checkin", "horizon", "observed", "actual", "prediction")


def revisions(rows: DataFrame) -> DataFrame:
    """Changes between consecutive snapshots of a pair."""
    order = Window.partitionBy("city_code", "checkin").orderBy(F.desc("horizon"))
    out = rows.withColumns({"previous": F.lag("prediction").over(order), "_h": F.lag("horizon").over(order)}).filter("_h IS NOT NULL")
    change = F.abs(F.col("prediction") - F.col("previous"))
    error = lambda c: F.abs(F.col(c) - F.col("actual"))
    return out.withColumns({"absolute_revision": change, "relative_revision": change / (F.abs("previous") + 1), "step": F.concat_ws("->", "_h", "horizon"), "converged": error("prediction") <= error("previous")}).drop("_h")


def stability_by_step(revised: DataFrame) -> DataFrame:
    return revised.groupBy("step").agg(F.avg("absolute_revision").alias("mean_absolute_revision"), F.avg("relative_revision").alias("mean_relative_revision"), F.avg(F.col("converged").cast("double")).alias("convergence_rate"), F.count(F.lit(1)).alias("n"))


def stability_score(revised: DataFrame) -> DataFrame:
    mean = F.avg("relative_revision")
    return revised.agg(F.least(F.greatest(1 - mean, F.lit(0.0)), F.lit(1.0)).alias("stability_score"), F.avg(F.col("converged").cast("double")).alias("convergence_rate"))


def blend(frame: DataFrame, weights: dict[str, float], name: str = "blended") -> DataFrame:
    """The weighted mean of the members that a row has, weights adding up to 1 again."""
    top = reduce(Column.__add__, (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()))
    bottom = reduce(Column.__add__, (F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()))
    return frame.withColumn(name, F.when(bottom > 0, top / bottom))


def ensemble_weights(scores: dict[str, float], worst: float = 1.35, top: int = 5, least: float = 0.02) -> dict[str, float]:
    """Weights that fall with a model's error over the best one's; those far behind get none."""
    import math

    known = {k: v for k, v in scores.items() if v is not None and math.isfinite(v) and v > 0}
    if not known:
        return {}
    best = min(known.values())
    ratio = {k: v / best for k, v in sorted(known.items(), key=lambda x: (x[1], x[0])) if v / best <= worst}
    raw = {k: math.exp(-4 * (r - 1)) for k, r in list(ratio.items())[:top]}
    share = {k: v / sum(raw.values()) for k, v in raw.items()}
    kept = {k: v for k, v in share.items() if v >= least} or share
    return {k: v / sum(kept.values()) for k, v in kept.items()}


def shock_share(scores: DataFrame, fold: str) -> DataFrame:
    """The error a fold stands for, and the pooled WAPE with and without it."""
    error = F.col("wape") * F.col("actual_total")
    other = F.col(FOLD) != fold
    return scores.agg((F.sum(error) / F.sum("actual_total")).alias("all_wape"), (F.sum(F.when(other, error)) / F.sum(F.when(other, F.col("actual_total")))).alias("without_wape"), (F.sum(F.when(~other, error)) / F.sum(error)).alias("error_share"))


def scores_of(frame: DataFrame, prediction: str, *by: str) -> DataFrame:
    return frame.groupBy(*by).agg(*score("actual", prediction))


def prequential(scores: dict[str, dict[str, tuple[float, float]]], fallback: str) -> tuple[list[tuple[str, str]], float]:
    """Which method each fold would have used, chosen on the folds before it, and the WAPE that gives.

    scores: by method and fold (folds sort by time) the WAPE and the demand. The first fold uses ``fallback``.
    """
    folds = sorted(next(iter(scores.values())))
    chosen, error, demand = [], 0.0, 0.0
    for i, fold in enumerate(folds):
        before = folds[:i]
        pooled = {m: sum(s[f][0] * s[f][1] for f in before) / max(sum(s[f][1] for f in before), 1e-9) for m, s in scores.items()}
        best = min(pooled, key=lambda m: (pooled[m], m != fallback, m)) if before else fallback
        wape, total = scores[best][fold]
        chosen.append((fold, best))
        error, demand = error + wape * total, demand + total
    return chosen, error / max(demand, 1e-9)


def safe_choice(candidate: dict[str, float], baseline: dict[str, float], most_worse: int = 1, least_gain: float = 0.01) -> bool:
    """Whether a candidate may replace the baseline: better on average by ``least_gain``, and worse on at most
    ``most_worse`` folds."""
    mean = lambda x: sum(x.values()) / len(x)
    worse = sum(candidate[f] > baseline[f] for f in baseline)
    return worse <= most_worse and mean(candidate) <= (1 - least_gain) * mean(baseline)


def interval_choice(gaps: dict[str, tuple[float, float]], nominal: float = 0.8, margin: float = 0.02) -> str:
    """The method whose coverage lies closest to the nominal one; within ``margin`` of each other the narrower.

    gaps: by method its coverage on folds held out and its mean width.
    """
    best = min(abs(c - nominal) for c, _ in gaps.values())
    near = {m: w for m, (c, w) in gaps.items() if abs(c - nominal) <= best + margin}
    return min(near, key=lambda m: (near[m], m))


def calibration_cutoffs(cutoff, days: int, windows: int) -> list:
    """Simulated cutoffs whose windows close at or before ``cutoff``, the latest first."""
    from datetime import timedelta

    return [cutoff - timedelta(days=days * k) for k in range(1, windows + 1)]
