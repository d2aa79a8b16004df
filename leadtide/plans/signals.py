"""Anomalies, peaks, censoring and insights over the order panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadtide.operators import panel, signals
from leadtide.plans.base import rounded
from leadtide.plans.panel import DAYS, NV, ORIGIN, dense, sql
from leadtide.registry import query
from leadtide.sources import tables

_DS = "strftime(ds, '%Y-%m-%d') AS ds"
RS = "rs AS (SELECT *, y - prediction AS r FROM (SELECT entity_id, ds, y, lag(y, 7) OVER (PARTITION BY entity_id ORDER BY ds) AS prediction FROM tl) WHERE prediction IS NOT NULL)"
SC = """sc AS (SELECT a.entity_id, a.m, coalesce(CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 END, CASE WHEN iqr / 1.349 > 1e-9 THEN iqr / 1.349 END, CASE WHEN mean > 1e-9 THEN mean END, CASE WHEN s > 1e-9 THEN s END, 1) AS scale FROM
    (SELECT entity_id, quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr, stddev_pop(r) AS s FROM rs GROUP BY ALL HAVING count(*) >= 21) a
    JOIN (SELECT rs.entity_id, quantile_cont(abs(r - m), 0.5) AS mad, avg(abs(r - m)) AS mean FROM rs JOIN (SELECT entity_id, quantile_cont(r, 0.5) AS m FROM rs GROUP BY ALL) USING (entity_id) GROUP BY ALL) b USING (entity_id))"""
AN = """an AS (SELECT rs.entity_id, ds, y AS actual, prediction AS expected, CASE WHEN prediction > 0 THEN r / prediction END AS deviation, (r - m) / scale AS score FROM rs JOIN sc USING (entity_id) WHERE abs((r - m) / scale) >= 3)"""
_SEV = "CASE WHEN abs(score) >= 5 THEN 'high' WHEN abs(score) >= 4 THEN 'medium' ELSE 'low' END"


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("entity_id").orderBy("ds")
    return dense(spark, sf_dir).select("entity_id", "ds", F.col("y").alias("actual"), F.lag("y", 7).over(order).alias("prediction")).filter("prediction IS NOT NULL")


@query("robust_scale", sql("SELECT entity_id, round(m, 6) AS median, round(scale, 6) AS scale FROM sc", RS, SC))
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _residuals(spark, sf_dir).withColumn("r", F.col("actual") - F.col("prediction"))
    return rounded(signals.robust_scale(rows, "r", ["entity_id"]).drop("n"))


@query("residual_anomalies", sql(f"SELECT entity_id, {_DS}, actual, expected, round(deviation, 6) AS deviation, round(score, 6) AS score, CASE WHEN score > 0 THEN 'spike' ELSE 'drop' END AS type, {_SEV} AS severity FROM an", RS, SC, AN))
def residual_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.residual_anomalies(_residuals(spark, sf_dir)))


@query("strongest_anomalies", sql(f"SELECT entity_id, {_DS}, round(score, 6) AS score FROM an ORDER BY abs(score) DESC, entity_id, an.ds LIMIT 100", RS, SC, AN))
def strongest_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.strongest(signals.residual_anomalies(_residuals(spark, sf_dir))).select("entity_id", "ds", "score"))


#: Regions are dense enough for medians above 0.
TR = "mp AS (SELECT entity_id, min(destination_id) AS destination_id FROM pa GROUP BY ALL), tr AS (SELECT destination_id AS entity_id, ds, CAST(sum(y) AS BIGINT) AS y FROM tl JOIN mp USING (entity_id) GROUP BY ALL)"
NV = f"{TR}, " + NV.replace("tl", "tr")
FC = f"fc AS (SELECT entity_id, ds, horizon, seasonal_mean * CASE WHEN horizon % 9 = 0 THEN 4 WHEN horizon % 10 = 3 THEN 0.5 ELSE 1 END AS forecast FROM nv)"
HS = f"hs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS k FROM tr WHERE ds <= DATE '{ORIGIN}') WHERE k <= 56)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.roll_up(dense(spark, sf_dir).select("entity_id", "ds", "y"), panel.entity_map(tables.demand_panel(spark, sf_dir)), "destination_id")


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal mean, with some days raised and some lowered."""
    lift = F.when(F.col("horizon") % 9 == 0, 4.0).when(F.col("horizon") % 10 == 3, 0.5).otherwise(1.0)
    return panel.naive_forecasts(regions(spark, sf_dir), ORIGIN, DAYS).select("entity_id", "ds", "horizon", (F.col("seasonal_mean") * lift).alias("forecast"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).filter(F.col("ds") <= F.lit(ORIGIN))


@query(
    "forecast_anomalies",
    sql(
        f"""SELECT entity_id, {_DS}, round(forecast, 6) AS forecast, round(expected, 6) AS expected, round(CASE WHEN abs(expected) > 1e-9 THEN (forecast - expected) / abs(expected) END, 6) AS deviation, round(score, 6) AS score, CASE WHEN score > 0 THEN 'spike' ELSE 'drop' END AS type, {_SEV} AS severity
        FROM (SELECT fc.*, expected, (forecast - expected) / CASE WHEN mad * 1.4826 < 1e-9 THEN greatest(expected * 0.25, 1) ELSE mad * 1.4826 END AS score FROM fc JOIN (SELECT hs.entity_id, e.expected, quantile_cont(abs(y - e.expected), 0.5) AS mad FROM hs JOIN (SELECT entity_id, quantile_cont(y, 0.5) AS expected FROM hs GROUP BY ALL) e ON e.entity_id = hs.entity_id GROUP BY ALL) USING (entity_id)) WHERE abs(score) >= 3""",
        NV, FC, HS,
    ),
)
def forecast_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.forecast_anomalies(_forecast(spark, sf_dir), _history(spark, sf_dir)))


_PB = "pb AS (SELECT entity_id, CAST(isodow(ds) - 1 AS INTEGER) AS phase, quantile_cont(y, 0.5) AS level FROM hs GROUP BY ALL)"


@query("phase_baseline", sql("SELECT entity_id, phase, round(level, 6) AS level FROM pb", TR, HS, _PB))
def phase_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.phase_baseline(_history(spark, sf_dir)))


@query(
    "peak_runs",
    sql(
        """SELECT entity_id, CASE WHEN direction > 0 THEN 'peak' ELSE 'trough' END AS type, strftime(min(ds), '%Y-%m-%d') AS "start", strftime(max(ds), '%Y-%m-%d') AS "end", CAST(count(*) AS BIGINT) AS days, round(avg(rel) * 100, 4) AS expected_change_pct,
        round(avg(lev), 6) AS baseline_level, round(avg(forecast), 6) AS forecast_level, round(sum(forecast), 6) AS total_forecast, CASE WHEN count(*) >= 3 AND abs(avg(rel)) >= 0.25 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds) - row_number() OVER (PARTITION BY entity_id, direction ORDER BY ds) AS island FROM (
            SELECT *, CASE WHEN rel > 0.15 THEN 1 WHEN rel < -0.15 THEN -1 ELSE 0 END AS direction FROM (SELECT *, (forecast - lev) / lev AS rel FROM (
                SELECT fc.*, CASE WHEN pb.level > 0 THEN pb.level ELSE o.overall END AS lev FROM fc JOIN (SELECT entity_id, quantile_cont(level, 0.5) AS overall FROM pb GROUP BY ALL) o USING (entity_id) LEFT JOIN pb ON pb.entity_id = fc.entity_id AND pb.phase = isodow(fc.ds) - 1
                WHERE o.overall > 0 AND o.overall >= (SELECT greatest(quantile_cont(level, 0.25), quantile_cont(level, 0.5) * 0.05) FROM pb WHERE level > 0)))))
        WHERE direction <> 0 GROUP BY entity_id, direction, island HAVING count(*) >= 2""",
        NV, FC, HS, _PB,
    ),
)
def peak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.peak_runs(_forecast(spark, sf_dir), _history(spark, sf_dir)), expected_change_pct=4)


CP = "cp AS (SELECT tr.*, c.capacity, CAST(isodow(ds) - 1 AS INTEGER) AS phase, capacity > 0 AND y >= capacity * 0.98 AS full FROM tr JOIN (SELECT entity_id, quantile_cont(y, 0.9) AS capacity FROM tr GROUP BY ALL) c USING (entity_id))"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir)
    return signals.censored(rows.join(rows.groupBy("entity_id").agg(F.percentile("y", F.lit(0.9)).alias("capacity")), "entity_id"))


@query("censoring_by_entity", sql('SELECT entity_id, round(avg(CASE WHEN "full" THEN 1.0 ELSE 0.0 END), 6) AS share, CAST(count(*) FILTER ("full") AS BIGINT) AS periods, CAST(count(*) AS BIGINT) AS observations FROM cp GROUP BY ALL', TR, CP.replace("AS full", 'AS "full"')))
def censoring_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.censoring_by_entity(_marked(spark, sf_dir)))


@query(
    "unconstrained_demand",
    sql(
        f"""SELECT entity_id, {_DS}, CASE WHEN "full" THEN greatest(y, coalesce(p.m, e.m, y)) ELSE y END::DOUBLE AS estimate FROM cp LEFT JOIN (SELECT entity_id, phase, quantile_cont(y, 0.5) AS m FROM cp WHERE NOT "full" GROUP BY ALL) p USING (entity_id, phase)
        LEFT JOIN (SELECT entity_id, quantile_cont(y, 0.5) AS m FROM cp WHERE NOT "full" GROUP BY ALL) e USING (entity_id)""",
        TR, CP.replace("AS full", 'AS "full"'),
    ),
)
def unconstrained_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.unconstrained(_marked(spark, sf_dir)).select("entity_id", "ds", "estimate"))


@query("capacity_constrained", sql(f"SELECT fc.entity_id, strftime(fc.ds, '%Y-%m-%d') AS ds, coalesce(capacity > 0 AND forecast >= capacity * 0.98, false) AS capacity_constrained FROM fc LEFT JOIN cp ON cp.entity_id = fc.entity_id AND cp.ds = fc.ds", NV, FC, CP.replace("AS full", 'AS "full"')))
def capacity_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.capacity_constrained(_forecast(spark, sf_dir), _marked(spark, sf_dir).select("entity_id", "ds", "capacity"))
    return rounded(found.select("entity_id", "ds", "capacity_constrained"))


EV = f"""vw AS (SELECT f.*, r.recent AS recent_total, CASE WHEN abs(r.recent) > 1e-9 THEN round((forecast_total - r.recent) / abs(r.recent) * 100, 2) END AS change_pct, CASE WHEN forecast_total > 0 THEN (upper_total - lower_total) / forecast_total END AS width FROM
    (SELECT entity_id, sum(forecast) AS forecast_total, avg(forecast) AS forecast_mean, sum(forecast * (0.7 + 0.001 * horizon)) AS lower_total, sum(forecast * 1.2) AS upper_total, CAST(count(*) AS BIGINT) AS periods FROM fc GROUP BY ALL) f
    LEFT JOIN (SELECT entity_id, sum(y)::DOUBLE AS recent FROM tr WHERE ds <= DATE '{ORIGIN}' AND ds > DATE '{ORIGIN}' - {DAYS} GROUP BY ALL) r USING (entity_id))"""


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecast(spark, sf_dir).withColumns({"lower": F.col("forecast") * (0.7 + 0.001 * F.col("horizon")), "upper": F.col("forecast") * 1.2})
    return signals.entity_view(rows, _history(spark, sf_dir), DAYS)


@query("entity_view", sql("SELECT entity_id, round(forecast_total, 6) AS forecast_total, round(forecast_mean, 6) AS forecast_mean, round(lower_total, 6) AS lower_total, round(upper_total, 6) AS upper_total, periods, recent_total, change_pct, round(width, 6) AS relative_interval_width, CASE WHEN change_pct >= 10 THEN 'growing' WHEN change_pct <= -10 THEN 'declining' WHEN change_pct IS NULL THEN 'unknown' ELSE 'stable' END AS status FROM vw", NV, FC, EV))
def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_view(spark, sf_dir))


@query("insight_extremes", sql("SELECT (SELECT entity_id FROM vw ORDER BY change_pct DESC, entity_id LIMIT 1) AS fastest_growing, (SELECT entity_id FROM vw ORDER BY change_pct, entity_id LIMIT 1) AS fastest_declining, (SELECT entity_id FROM vw ORDER BY round(width, 9) DESC, entity_id LIMIT 1) AS highest_uncertainty, (SELECT entity_id FROM vw ORDER BY round(width, 9), entity_id LIMIT 1) AS lowest_uncertainty", NV, FC, EV))
def insight_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.extremes(_view(spark, sf_dir).withColumn("relative_interval_width", F.round("relative_interval_width", 9)))
