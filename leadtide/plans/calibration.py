"""Calibration, intervals, bootstrap, stability, blends."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.operators import backtest, calibration
from leadtide.plans.backtest import _S, FOLDS, QUANTILES, SEGMENTS
from leadtide.plans.base import buckets_sql, fold_sql, folds, log, rounded, sql
from leadtide.registry import query
from leadtide.sources.shared import written

_OVERALL = "SELECT alpha, round(sum(abs(observed + alpha * greatest(predicted - observed, 0) - actual)), 6) AS err FROM folds, al GROUP BY alpha"
AL = f"al AS (SELECT unnest({calibration.ALPHAS})::DOUBLE AS alpha)"
_UNB = "least(greatest(CASE WHEN sum(greatest(predicted - observed, 0)) > 1e-9 THEN sum(actual - observed) / sum(greatest(predicted - observed, 0)) ELSE 1 END, 0.8), 2.4)"
BA = f"""ba AS (SELECT bucket, arg_min(alpha, (err, alpha)) AS alpha FROM (SELECT {buckets_sql('horizon', other="'other'")} AS bucket, alpha, round(sum(abs(observed + alpha * greatest(predicted - observed, 0) - actual)), 6) AS err FROM folds, al GROUP BY ALL) GROUP BY bucket)"""
BU = f"bu AS (SELECT {buckets_sql('horizon')} AS bucket, {_UNB} AS unbiased, sum(actual)::DOUBLE AS demand FROM folds GROUP BY ALL)"
GA = f"ga AS (SELECT (SELECT alpha FROM ({_OVERALL}) ORDER BY err, alpha LIMIT 1) AS alpha, (SELECT {_UNB} FROM folds) AS unbiased)"


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.scored_frame(folds(spark, sf_dir))


@query("calibration_alpha", sql("SELECT bucket, round(alpha, 2) AS alpha, round(unbiased, 6) AS unbiased, round(demand, 2) AS demand FROM ba JOIN bu USING (bucket)", FOLDS, AL, BA, BU, folds=True))
def calibration_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadtide.operators.asof import bucket_label

    rows = _frame(spark, sf_dir).withColumn("bucket", bucket_label(F.col("horizon"), C.horizon_buckets, "other"))
    return rounded(calibration.best_alpha(rows, "bucket"), demand=2)


_W = f"demand / (demand + {C.calibration_shrinkage})"
_FACTORS = {
    "global": "ga.alpha",
    "horizon": "ba.alpha",
    "horizon_shrunk": f"{_W} * ba.alpha + (1 - {_W}) * ga.alpha",
    "bias_global": "ga.unbiased",
    "bias_horizon_shrunk": f"{_W} * bu.unbiased + (1 - {_W}) * ga.unbiased",
    "guarded_bias_horizon": f"CASE WHEN CAST(split_part(bucket, '-', 2) AS INTEGER) <= 7 THEN 1.0 ELSE least(greatest(1 + {_W} * (bu.unbiased - 1), 0.95), CASE WHEN CAST(split_part(bucket, '-', 2) AS INTEGER) <= 21 THEN 1.12 ELSE 1.08 END) END",
}


@query("calibration_factors", sql(" UNION ALL ".join(f"SELECT '{m}' AS method, bucket, round({f}, 6) AS factor FROM bu JOIN ba USING (bucket), ga" for m, f in _FACTORS.items()), FOLDS, AL, BA, BU, GA, folds=True))
def calibration_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = written(_frame(spark, sf_dir))  # every method reads it
    out = None
    for method in _FACTORS:
        own = calibration.calibrator(frame, C, method).withColumn("method", F.lit(method))
        out = own if out is None else out.unionByName(own)
    return rounded(out)


_CF = f"""cf AS (SELECT f.fold_cutoff, {buckets_sql('l.horizon')} AS bucket, {_UNB.replace('predicted', 'l.predicted').replace('observed', 'l.observed').replace('actual', 'l.actual')} AS unbiased, sum(l.actual)::DOUBLE AS demand
    FROM (SELECT DISTINCT fold_cutoff FROM folds) f JOIN folds l ON CAST(l.fold_cutoff AS DATE) + {C.target_days} <= CAST(f.fold_cutoff AS DATE) GROUP BY ALL)"""
_CFF = f"cff AS (SELECT fold_cutoff, bucket, {_FACTORS['guarded_bias_horizon'].replace('bu.', '')} AS factor FROM cf)"
_CAL = f"cal AS (SELECT folds.*, greatest(observed + coalesce(factor, 1) * greatest(predicted - observed, 0), observed) AS calibrated FROM (SELECT *, {buckets_sql('horizon')} AS bucket FROM folds) folds LEFT JOIN cff USING (fold_cutoff, bucket))"


@query("cross_fitted_scores", sql(f"SELECT fold_cutoff, {_S.replace('predicted)', 'calibrated)').replace('- predicted', '- calibrated').replace('(predicted -', '(calibrated -').replace('sum(predicted', 'sum(calibrated')} FROM cal GROUP BY ALL", FOLDS, _CF, _CFF, _CAL, folds=True))
def cross_fitted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.cross_fitted(_frame(spark, sf_dir), C, "guarded_bias_horizon")
    return rounded(calibration.scores_of(rows, "calibrated_demand", "fold_cutoff"))


_FS = f"fs AS (SELECT fold_cutoff, {_S} FROM folds GROUP BY ALL)"


@query("fold_bootstrap", sql("SELECT round(quantile_cont(r, 0.025), 6) AS lower, round(quantile_cont(r, 0.975), 6) AS upper, CAST(count(*) AS BIGINT) AS samples FROM (SELECT (a.wape * a.actual_total + b.wape * b.actual_total + c.wape * c.actual_total) / (a.actual_total + b.actual_total + c.actual_total) AS r FROM fs a, fs b, fs c)", FOLDS, _FS, folds=True))
def fold_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = calibration.scores_of(_frame(spark, sf_dir), "predicted_demand", "fold_cutoff")
    return rounded(calibration.fold_bootstrap(scores, len(C.fold_cutoffs)))


@query("shock_sensitivity", sql(f"SELECT round(sum(wape * actual_total) / sum(actual_total), 6) AS all_wape, round(sum(wape * actual_total) FILTER (fold_cutoff <> '{C.fold_cutoffs[1]}') / sum(actual_total) FILTER (fold_cutoff <> '{C.fold_cutoffs[1]}'), 6) AS without_wape, round(sum(wape * actual_total) FILTER (fold_cutoff = '{C.fold_cutoffs[1]}') / sum(wape * actual_total), 6) AS error_share FROM fs", FOLDS, _FS, folds=True))
def shock_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = calibration.scores_of(_frame(spark, sf_dir), "predicted_demand", "fold_cutoff")
    return rounded(calibration.shock_share(scores, str(C.fold_cutoffs[1])))


_LAST = str(C.fold_cutoffs[-1])
_RH = f"rh AS (SELECT city_code, horizon_bucket, abs(actual - predicted) / greatest(predicted, 1) AS r FROM seg WHERE CAST(fold_cutoff AS DATE) + {C.target_days} <= DATE '{_LAST}')"


def _rank(by: str, name: str) -> str:
    key = by or "1"
    return f"{name} AS (SELECT {by + ', ' if by else ''}max(n) AS n, min(r) FILTER (k = ceil((n + 1) * 0.8)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY r) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM rh) {'GROUP BY ' + by if by else ''})"


@query(
    "residual_bands",
    sql(
        f"""SELECT s.city_code, strftime(s.checkin, '%Y-%m-%d') AS checkin, CASE WHEN c.n >= 20 THEN 'city/horizon' WHEN h.n >= 20 THEN 'horizon' ELSE 'global' END AS band_source, CAST(CASE WHEN c.n >= 20 THEN c.n WHEN h.n >= 20 THEN h.n ELSE g.n END AS BIGINT) AS support,
        round(greatest(observed, predicted - (CASE WHEN c.n >= 20 THEN c.v WHEN h.n >= 20 THEN h.v ELSE g.v END) * greatest(predicted, 1)), 6) AS lower, round(greatest(observed, predicted + (CASE WHEN c.n >= 20 THEN c.v WHEN h.n >= 20 THEN h.v ELSE g.v END) * greatest(predicted, 1)), 6) AS upper
        FROM seg s LEFT JOIN rc c USING (city_code, horizon_bucket) LEFT JOIN rb h ON h.horizon_bucket = s.horizon_bucket, rg g WHERE fold_cutoff = '{_LAST}'""",
        FOLDS, QUANTILES, SEGMENTS, _RH, _rank("city_code, horizon_bucket", "rc"), _rank("horizon_bucket", "rb"), _rank("", "rg"), folds=True,
    ),
)
def residual_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the last fold from the errors of folds that had closed by then."""
    frame = written(_frame(spark, sf_dir).withColumnRenamed("predicted_demand", "prediction"))  # every level reads it
    past = frame.filter(F.date_add("fold_cutoff", C.target_days) <= F.lit(C.fold_cutoffs[-1]))
    found = calibration.residual_bands(past, frame.filter(F.col("fold_cutoff") == F.lit(C.fold_cutoffs[-1])), min_support=20)
    return rounded(found.select("city_code", "checkin", "band_source", "support", "lower", "upper"))


_CB = ((1, 7), (8, 21), (22, 30))
_CBS = "CASE " + " ".join(f"WHEN horizon BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in _CB) + " END"


@query("conformal_offsets", sql(f"SELECT {_CBS} AS bucket, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(actual - predicted, 0.1), 6) AS q10, round(quantile_cont(actual - predicted, 0.9), 6) AS q90 FROM folds GROUP BY ALL", FOLDS, folds=True))
def conformal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.conformal_offsets(_frame(spark, sf_dir), _CB))


_CO = f"co AS (SELECT {_CBS} AS bucket, quantile_cont(actual - predicted, 0.1) AS q10, quantile_cont(actual - predicted, 0.9) AS q90 FROM folds GROUP BY ALL)"


@query("interval_coverage", sql(f"SELECT bucket, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN actual BETWEEN greatest(predicted + q10, 0) AND greatest(predicted + q90, 0) THEN 1.0 ELSE 0.0 END), 4) AS observed_coverage, round(avg(greatest(predicted + q90, 0) - greatest(predicted + q10, 0)), 4) AS mean_width FROM (SELECT *, {_CBS} AS bucket FROM folds) JOIN co USING (bucket) GROUP BY bucket", FOLDS, _CO, folds=True))
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadtide.functions import metrics
    from leadtide.operators.asof import bucket_label

    frame = _frame(spark, sf_dir)
    rows = frame.withColumn("bucket", bucket_label(F.col("horizon"), _CB, None)).join(F.broadcast(calibration.conformal_offsets(frame, _CB).drop("n")), "bucket")
    bound = lambda q: F.greatest(F.col("predicted_demand") + F.col(q), F.lit(0.0))
    rows = rows.withColumns({"lower": bound("q10"), "upper": bound("q90")})
    return rounded(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), metrics.coverage("actual", "lower", "upper").alias("observed_coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width")), 4)


_ANCHOR = C.at(C.cutoff - timedelta(days=C.target_days - 1 + max(C.snapshot_horizons)))
_SN = f"""sn AS (SELECT x.city_code, x.checkin, x.h AS horizon, x.observed, x.actual, CASE WHEN observed > 0 THEN greatest(observed / f, observed) ELSE z.expected END AS prediction FROM (
    SELECT g.city_code, g.province_code, g.checkin, h, CAST(coalesce(sum(n) FILTER (lead >= h AND lead < 60), 0) AS BIGINT) AS observed, CAST(coalesce(sum(n) FILTER (lead < 60), 0) AS BIGINT) AS actual
    FROM (SELECT city_code, province_code, CAST(d AS DATE) AS checkin FROM ci, generate_series(DATE '{C.cutoff}' - {C.target_days - 1}, DATE '{C.cutoff}', INTERVAL 1 DAY) t(d)) g CROSS JOIN (SELECT unnest({list(C.snapshot_horizons)}) AS h)
    LEFT JOIN ev ON ev.city_code = g.city_code AND ev.checkin = g.checkin GROUP BY ALL) x
    JOIN (SELECT ci.city_code, s.h, greatest(least(coalesce(c.f, p.f, g.f), 1.0), {C.min_fraction}) AS f FROM ci CROSS JOIN (SELECT unnest({list(C.snapshot_horizons)}) AS h) s LEFT JOIN cc_s c ON c.key = ci.city_code AND c.h = s.h LEFT JOIN pc_s p ON p.key = ci.province_code AND p.h = s.h LEFT JOIN gc_s g ON g.h = s.h) q ON q.city_code = x.city_code AND q.h = x.h
    JOIN zp_s z ON z.city_code = x.city_code AND z.horizon = x.h)"""
_SNAP = [*fold_sql(_ANCHOR, "_s"), _SN]
_RV = "rv AS (SELECT *, lag(prediction) OVER w AS previous, lag(horizon) OVER w AS ph FROM sn WINDOW w AS (PARTITION BY city_code, checkin ORDER BY horizon DESC))"


@query("stability_snapshots", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, CAST(horizon AS INTEGER) AS horizon, observed, actual, round(prediction, 6) AS prediction FROM sn", *_SNAP))
def stability_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.snapshots(log(spark, sf_dir)))


@query("stability_revisions", sql("SELECT ph || '->' || horizon AS step, round(avg(abs(prediction - previous)), 6) AS mean_absolute_revision, round(avg(abs(prediction - previous) / (abs(previous) + 1)), 6) AS mean_relative_revision, round(avg(CASE WHEN abs(prediction - actual) <= abs(previous - actual) THEN 1.0 ELSE 0.0 END), 6) AS convergence_rate, CAST(count(*) AS BIGINT) AS n FROM rv WHERE ph IS NOT NULL GROUP BY ALL", *_SNAP, _RV))
def stability_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.stability_by_step(calibration.revisions(calibration.snapshots(log(spark, sf_dir)))))


@query("stability_score", sql("SELECT round(least(greatest(1 - avg(abs(prediction - previous) / (abs(previous) + 1)), 0), 1), 6) AS stability_score, round(avg(CASE WHEN abs(prediction - actual) <= abs(previous - actual) THEN 1.0 ELSE 0.0 END), 6) AS convergence_rate FROM rv WHERE ph IS NOT NULL", *_SNAP, _RV))
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.stability_score(calibration.revisions(calibration.snapshots(log(spark, sf_dir)))))


@query("blended_forecast", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, round(CASE WHEN observed > 0 THEN 0.6 * predicted + 0.4 * observed ELSE predicted END, 6) AS blended FROM pred"))
def blended_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two members, of which one is missing where nothing is seen."""
    from leadtide.operators.curves import pickup_forecast

    rows = pickup_forecast(log(spark, sf_dir)).withColumn("naive", F.when(F.col("observed") > 0, F.col("observed").cast("double")))
    return rounded(calibration.blend(rows, {"predicted_demand": 0.6, "naive": 0.4}).select("city_code", "checkin", "blended"))


@query("confidence_scores", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, round(c, 6) AS confidence, CASE WHEN c >= 0.66 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM (SELECT *, least(greatest(1 - (0.35 * least(greatest((predicted - observed) / greatest(abs(predicted), 1e-6), 0), 1) + 0.35 * 0.3 + 0.15 * least(horizon / 30.0, 1) + 0.15 * 0), 0), 1) AS c FROM pred)"))
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadtide.operators.curves import pickup_forecast

    c = calibration.confidence(F.col("predicted_demand") - F.col("observed"), F.col("predicted_demand"), F.lit(0.3), F.col("horizon"), C.target_days, F.lit(1600))
    rows = pickup_forecast(log(spark, sf_dir)).withColumn("confidence", c).withColumn("label", calibration.confidence_label(F.col("confidence")))
    return rounded(rows.select("city_code", "checkin", "confidence", "label"))
