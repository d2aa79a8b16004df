"""Fold scores, breakdowns, reference baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.functions import metrics as M
from leadtide.functions.metrics import score
from leadtide.operators import asof, backtest
from leadtide.plans.asof import PRIOR
from leadtide.plans.base import buckets_sql, folds, rounded, sql
from leadtide.registry import query

SCORE = """CAST(count(*) AS BIGINT) AS n, round(sum({a})::DOUBLE, 2) AS actual_total, round(sum({p})::DOUBLE, 2) AS predicted_total,
    CASE WHEN sum(abs({a})) > 0 THEN round(sum(abs({a} - {p})) / sum(abs({a})), 6) END AS wape, round(avg(abs({a} - {p})), 4) AS mae,
    CASE WHEN sum({a}) > 0 THEN round(sum({p} - {a}) / sum({a}), 6) END AS normalised_bias"""
_S = SCORE.format(a="actual", p="predicted")


def _prior(i: int) -> list[str]:
    """The demand prior's CTEs for fold i."""
    cutoff = C.fold_cutoffs[i]
    out = []
    for x in PRIOR:
        x = x.replace(str(C.cutoff), str(cutoff))
        for name in ("hist", "grid", "w0", "wd", "rc", "bw", "bc", "bp", "bg", "prior"):
            import re

            x = re.sub(rf"\b{name}\b", f"{name}_{i}", x)
        out.append(x)
    return out


FOLDS = "folds AS (" + " UNION ALL ".join(f"SELECT '{c}' AS fold_cutoff, p.* FROM pred_{i} p" for i, c in enumerate(C.fold_cutoffs)) + ")"
QUANTILES = f"""edges AS (SELECT fold_cutoff, list_sort(list_distinct(quantile_cont(actual, {list(C.demand_quantiles)}))) AS e FROM folds GROUP BY ALL)"""
_LABELS = [f"q{a:.2f}-{b:.2f}" for a, b in zip(C.demand_quantiles, C.demand_quantiles[1:], strict=False)]
SEGMENTS = f"""seg AS (SELECT folds.*, CAST(isodow(checkin) - 1 AS INTEGER) AS weekday, {buckets_sql('horizon')} AS horizon_bucket,
    CASE WHEN observed > 0 THEN 'observed' ELSE 'unobserved' END AS observation_state,
    CASE WHEN len(e) < 2 THEN 'all' ELSE {_LABELS}[greatest(len(list_filter(e, lambda x: x < actual)), 1)] END AS demand_bucket
    FROM folds JOIN edges USING (fold_cutoff))"""


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.scored_frame(folds(spark, sf_dir))


def fold_query(name: str, key: str, cast: str = "VARCHAR") -> None:
    """Scores of all folds together by one segment."""

    @query(f"backtest_by_{name}", sql(f"SELECT CAST({key} AS VARCHAR) AS key, {_S} FROM seg GROUP BY ALL", FOLDS, QUANTILES, SEGMENTS, folds=True))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _frame(spark, sf_dir).groupBy(F.col({"source": "curve_source"}.get(key, key)).cast("string").alias("key")).agg(*score())


for _name, _key in (("horizon", "horizon"), ("horizon_bucket", "horizon_bucket"), ("province", "province_code"), ("weekday", "weekday"), ("demand_bucket", "demand_bucket"), ("curve_source", "source"), ("observation_state", "observation_state")):
    fold_query(_name, _key)


@query("backtest_scores", sql(f"SELECT fold_cutoff, {_S}, round(sum(observed) / greatest(sum(actual), 1e-9), 4) AS observed_share FROM folds GROUP BY ALL", FOLDS, folds=True))
def backtest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _frame(spark, sf_dir).groupBy("fold_cutoff").agg(*score(), F.round(F.sum("observed") / F.greatest(F.sum("actual").cast("double"), F.lit(1e-9)), 4).alias("observed_share"))
    return rounded(found)


@query(
    "backtest_pooled",
    sql(
        f"SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(actual_total), 2) AS actual_total, round(sum(wape * actual_total) / sum(actual_total), 6) AS wape, round(sum(normalised_bias * actual_total) / sum(actual_total), 6) AS normalised_bias FROM (SELECT fold_cutoff, {_S} FROM folds GROUP BY ALL)",
        FOLDS,
        folds=True,
    ),
)
def backtest_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.pooled(_frame(spark, sf_dir).groupBy("fold_cutoff").agg(*score()))


@query("backtest_fold_horizon", sql(f"SELECT fold_cutoff, horizon_bucket, {_S} FROM seg GROUP BY ALL", FOLDS, QUANTILES, SEGMENTS, folds=True))
def backtest_fold_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frame(spark, sf_dir).groupBy("fold_cutoff", "horizon_bucket").agg(*score()))


@query("annotated_fold", sql("SELECT fold_cutoff, city_code, strftime(checkin, '%Y-%m-%d') AS checkin, weekday, horizon_bucket, observation_state, demand_bucket FROM seg", FOLDS, QUANTILES, SEGMENTS, folds=True))
def annotated_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = asof.annotate(asof.fold_frame(folds(spark, sf_dir)), C)
    return rounded(found.select("fold_cutoff", "city_code", "checkin", "weekday", "horizon_bucket", "observation_state", "demand_bucket"))


_REFERENCES = "refs AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS fold_cutoff, g.city_code, g.checkin, g.actual, g.observed::DOUBLE AS observed_so_far, coalesce(f.n, 0)::DOUBLE AS last_year_same_date, p.level AS city_weekday_mean
    FROM grid_{i} g LEFT JOIN (SELECT city_code, checkin + 364 AS checkin, sum(n) AS n FROM ev GROUP BY ALL) f USING (city_code, checkin) JOIN prior_{i} p USING (city_code, checkin)"""
    for i, c in enumerate(C.fold_cutoffs)
) + ")"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT fold_cutoff, '{x}' AS reference, actual, {x} AS predicted FROM refs" for x in ("observed_so_far", "last_year_same_date", "city_weekday_mean")) + ")"


@query("reference_baselines", sql(f"SELECT fold_cutoff, reference, {_S} FROM long GROUP BY ALL", *_prior(0), *_prior(1), *_prior(2), _REFERENCES, _LONG, folds=True))
def reference_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.reference_scores(_frame(spark, sf_dir), "fold_cutoff"))


_CITY = f"cs AS (SELECT * FROM (SELECT fold_cutoff, city_code, {_S} FROM folds GROUP BY ALL) WHERE wape IS NOT NULL)"


@query("worst_cities", sql("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fold_cutoff ORDER BY wape DESC, city_code) AS INTEGER) AS rank FROM cs) WHERE rank <= 20", FOLDS, _CITY, folds=True))
def worst_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.worst_cities(_frame(spark, sf_dir)))


@query("city_wape_quantiles", sql("SELECT fold_cutoff, " + ", ".join(f"round(quantile_cont(wape, {q}), 4) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM cs GROUP BY ALL", FOLDS, _CITY, folds=True))
def city_wape_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.city_wape_quantiles(_frame(spark, sf_dir)))


_TOP = " UNION ALL ".join(f"SELECT fold_cutoff, 'top_{s * 100:g}_pct' AS slice, actual, predicted FROM folds f WHERE actual >= (SELECT quantile_cont(actual, {1 - s}) FROM folds x WHERE x.fold_cutoff = f.fold_cutoff)" for s in (0.01, 0.05, 0.1))


@query("top_demand_scores", sql(f"SELECT fold_cutoff, slice, {_S} FROM ({_TOP}) GROUP BY ALL", FOLDS, folds=True))
def top_demand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.top_demand_scores(_frame(spark, sf_dir)))


@query(
    "error_measures",
    sql(
        """SELECT fold_cutoff, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(sum(abs(actual - predicted)) / sum(actual), 6) AS wape,
        round(100 * avg(abs((actual - predicted) / actual)) FILTER (actual > 0), 6) AS mape, round(100 * avg(abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2)) FILTER (abs(actual) + abs(predicted) > 2e-9), 6) AS smape,
        round(sqrt(avg((ln(1 + actual) - ln(1 + predicted)) ** 2)), 6) AS rmsle, round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS r2, round(avg(predicted - actual), 6) AS bias,
        round(sum(predicted - actual) / sum(actual), 6) AS normalised_bias, round(2 * avg(CASE WHEN actual > 0 THEN actual * ln(actual / greatest(predicted, 1e-9)) ELSE 0 END - (actual - greatest(predicted, 1e-9))), 6) AS poisson_deviance,
        round(avg(abs(actual - predicted)) / avg(abs(step)), 6) AS mase
        FROM (SELECT *, actual - lag(actual) OVER (PARTITION BY fold_cutoff, city_code ORDER BY checkin) AS step FROM folds) GROUP BY ALL""",
        FOLDS,
        folds=True,
    ),
)
def error_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _frame(spark, sf_dir)
    rows = rows.withColumn("step", F.col("actual") - F.lag("actual").over(Window.partitionBy("fold_cutoff", "city_code").orderBy("checkin")))
    return rounded(rows.groupBy("fold_cutoff").agg(*(f("actual", "predicted_demand").alias(n) for n, f in M.MEASURES.items()), M.mase("actual", "predicted_demand", "step").alias("mase")))


_MODELS = "ms AS (SELECT reference AS model, true AS is_baseline, wape AS primary_value FROM (SELECT reference, {s} FROM long GROUP BY ALL) UNION ALL SELECT 'pickup', false, wape FROM (SELECT {s} FROM folds))".format(s=_S)


@query(
    "leaderboard",
    sql(
        """SELECT ms.*, CAST(row_number() OVER (ORDER BY ms.primary_value NULLS LAST, ms.model) AS INTEGER) AS rank, b.model AS baseline_model, round((b.primary_value - ms.primary_value) / abs(b.primary_value), 4) AS improvement_vs_baseline
        FROM ms, (SELECT model, primary_value FROM ms WHERE is_baseline ORDER BY primary_value, model LIMIT 1) b""",
        *_prior(0), *_prior(1), *_prior(2), FOLDS, _REFERENCES, _LONG, _MODELS, folds=True,
    ),
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir)
    scores = backtest.reference_scores(frame).select(F.col("reference").alias("model"), F.lit(True).alias("is_baseline"), F.col("wape").alias("primary_value"))
    scores = scores.unionByName(frame.agg(*score()).select(F.lit("pickup").alias("model"), F.lit(False).alias("is_baseline"), F.col("wape").alias("primary_value")))
    return backtest.improvement(scores)
