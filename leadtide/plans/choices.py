"""Choices of methods over folds, weights of models, health of the log, dates of both calendars as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.functions import text
from leadtide.functions.calendar import jalali_parts
from leadtide.operators import backtest, calibration, choices, quality
from leadtide.plans.backtest import FOLDS, SCORE
from leadtide.plans.base import day, folds, rounded, sql
from leadtide.plans.calibration import _CAL, _CF, _CFF
from leadtide.plans.panel import MAP, NV, SG, _NB, model_scores
from leadtide.plans.panel import sql as panel_sql
from leadtide.plans.quality import _RULES
from leadtide.registry import query
from leadtide.sources import tables
from leadtide.sources.shared import written

#: The column that each method's prediction is in, and its name in the SQL.
METHODS = {"pickup": ("predicted_demand", "predicted"), "guarded": ("calibrated_demand", "calibrated"), "observed": ("observed", "observed")}
MS = "ms AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, fold_cutoff, {SCORE.format(a='actual', p=p)} FROM cal GROUP BY ALL" for m, (_, p) in METHODS.items()) + ")"
PQ = """pq AS (SELECT f.fold_cutoff, m.method, coalesce(sum(b.wape * b.actual_total) / greatest(sum(b.actual_total), 1e-9), 0) AS pooled
    FROM (SELECT DISTINCT fold_cutoff FROM ms) f CROSS JOIN (SELECT DISTINCT method FROM ms) m LEFT JOIN ms b ON b.method = m.method AND b.fold_cutoff < f.fold_cutoff GROUP BY ALL),
pick AS (SELECT fold_cutoff, arg_min(method, (pooled, CAST(method <> 'pickup' AS INTEGER), method)) AS method FROM pq GROUP BY ALL),
used AS (SELECT fold_cutoff, method, wape, actual_total FROM pick JOIN ms USING (fold_cutoff, method))"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.cross_fitted(backtest.scored_frame(folds(spark, sf_dir)), C, "guarded_bias_horizon")
    spread = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("p")) for m, (c, _) in METHODS.items()))).alias("x")
    rows = rows.select("fold_cutoff", "actual", spread).select("fold_cutoff", "actual", "x.method", F.col("x.p").alias("predicted_demand"))
    return calibration.scores_of(rows, "predicted_demand", "method", "fold_cutoff")


def _sql(body: str, *more: str) -> str:
    return sql(body, FOLDS, _CF, _CFF, _CAL, MS, *more, folds=True)


@query("method_scores", _sql("SELECT * FROM ms"))
def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir))


@query("prequential_folds", _sql("SELECT fold_cutoff, method, wape, actual_total FROM used", PQ))
def prequential_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(choices.prequential_folds(_scores(spark, sf_dir), "pickup"))


@query("prequential_wape", _sql("SELECT CAST(count(*) AS BIGINT) AS folds, round(sum(wape * actual_total) / greatest(sum(actual_total), 1e-9), 6) AS wape FROM used", PQ))
def prequential_wape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(choices.pooled_wape(choices.prequential_folds(_scores(spark, sf_dir), "pickup")))


@query("safe_methods", _sql("SELECT m.method, round(avg(m.wape), 6) AS mean_wape, CAST(count(*) FILTER (m.wape > b.wape) AS BIGINT) AS folds_worse, count(*) FILTER (m.wape > b.wape) <= 1 AND avg(m.wape) <= 0.99 * avg(b.wape) AS replaces FROM ms m JOIN ms b ON b.fold_cutoff = m.fold_cutoff AND b.method = 'pickup' WHERE m.method <> 'pickup' GROUP BY m.method"))
def safe_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(choices.safe_methods(written(_scores(spark, sf_dir)), "pickup"))


_WEIGHTS = """w0 AS (SELECT model, wape / min(wape) OVER () AS r, row_number() OVER (ORDER BY wape, model) AS k FROM sc WHERE wape > 0),
w1 AS (SELECT model, exp(-4 * (r - 1)) / sum(exp(-4 * (r - 1))) OVER () AS w FROM w0 WHERE r <= 1.35 AND k <= 5),
w2 AS (SELECT model, w FROM w1 WHERE w >= 0.02 OR (SELECT max(w) FROM w1) < 0.02)"""
_SC = "sc AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, round(sum(abs(actual - {m})) / sum(actual), 6) AS wape FROM sg" for m in _NB) + ")"


@query("ensemble_weights", panel_sql("SELECT model, round(w / sum(w) OVER (), 6) AS weight FROM w2", NV, MAP, SG, _SC, _WEIGHTS))
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(choices.model_weights(model_scores(spark, sf_dir), "model", "wape"))


#: How severe a broken rule of the log is.
SEVERITY = {"null_in_key": "critical", "duplicate_keys": "high", "checkin_before_log": "high", "unknown_city": "high", "overlap_of_files": "high", "count_below_one": "medium", "lead_too_long": "low", "silent_city": "info"}
_COST = "CASE rule " + " ".join(f"WHEN '{r}' THEN {quality.PENALTY[s]}" for r, s in SEVERITY.items()) + " ELSE 0 END"
_GRADE = "CASE " + " ".join(f"WHEN score >= {least} THEN '{g}'" for least, g in quality.GRADES) + " END"


@query("event_health", sql(f"SELECT broken_rules, score, {_GRADE} AS grade FROM (SELECT CAST(count(*) FILTER (c > 0) AS BIGINT) AS broken_rules, CAST(greatest(0, 100 - coalesce(sum({_COST}) FILTER (c > 0), 0)) AS INTEGER) AS score FROM ({_RULES}))"))
def event_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.health_of(quality.event_findings(tables.events(spark, sf_dir), tables.cities(spark, sf_dir), C), SEVERITY)


def _written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date of the orders as a text of one of four kinds, one of them Jalali in Persian digits."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    jalali = F.translate(F.format_string("%04d/%02d/%02d", *jalali_parts("d")), "0123456789", text.FOREIGN[:10])
    kinds = [F.date_format("d", "yyyy-MM-dd"), jalali, F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "yyyyMMdd")]
    kind = F.pmod(F.datediff("d", F.lit("1970-01-01").cast("date")), F.lit(4))
    return rows.withColumn("kind", kind).withColumn("t", F.array(*kinds)[F.col("kind")])


_DATES = "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT d, CAST((d - DATE '1970-01-01') % 4 AS INTEGER) AS kind FROM d) "


@query("lenient_dates", _DATES + "SELECT strftime(d, '%Y-%m-%d') AS d, kind, strftime(d, '%Y-%m-%d') AS parsed, kind < 2 AS is_date_like, kind = 1 AS is_jalali FROM k")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_dates(spark, sf_dir)
    return rows.select(day("d"), "kind", F.date_format(text.lenient_date("t"), "yyyy-MM-dd").alias("parsed"), text.looks_like_date("t").alias("is_date_like"), text.is_jalali("t").alias("is_jalali"))


@query("jalali_share", _DATES + "SELECT CAST(year(d) AS INTEGER) AS year, round(count(*) FILTER (kind = 1) / count(*) FILTER (kind <> 2), 6) AS share FROM k GROUP BY ALL")
def jalali_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_written_dates(spark, sf_dir).groupBy(F.year("d").alias("year")).agg(text.jalali_share("t").alias("share")))
