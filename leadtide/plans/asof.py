"""As-of views, grids, curves, priors and the pickup forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.operators import asof, curves
from leadtide.plans.base import day, log, rounded, sql
from leadtide.registry import query
from leadtide.sources import tables


@query("history_before", sql(f"SELECT strftime(log_date, '%Y-%m-%d') AS log_date, city_code, strftime(checkin, '%Y-%m-%d') AS checkin, n AS search_count, lead AS days_to_checkin FROM ev WHERE checkin <= DATE '{C.cutoff}'"))
def history_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = asof.history_before(tables.events(spark, sf_dir), C.cutoff)
    return found.select(day("log_date"), "city_code", day("checkin"), "search_count", F.datediff("checkin", "log_date").alias("days_to_checkin"))


@query("asof_observed", sql(f"SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, CAST(sum(n) AS BIGINT) AS observed FROM ev WHERE log_date <= DATE '{C.cutoff}' AND checkin BETWEEN DATE '{C.target_start}' AND DATE '{C.target_end}' GROUP BY ALL"))
def asof_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    union = data.history.unionByName(data.evaluation)  # the two files of the log
    return rounded(asof.observed_at(union, C.cutoff, C.target_start, C.target_end))


@query("final_demand", sql(f"SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, CAST(sum(n) AS BIGINT) AS final FROM ev WHERE checkin BETWEEN DATE '{C.target_start}' AND DATE '{C.target_end}' GROUP BY ALL"))
def final_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.final_demand(tables.events(spark, sf_dir), C.target_start, C.target_end))


@query("complete_grid", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin FROM grid"))
def complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.complete_grid(tables.cities(spark, sf_dir).select("city_code"), C.target_start, C.target_end))


@query("forecast_grid", sql("SELECT city_code, province_code, strftime(checkin, '%Y-%m-%d') AS checkin, horizon, observed FROM grid"))
def forecast_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.forecast_grid(log(spark, sf_dir)).drop("fold_cutoff"))


@query("fold_frame", sql("SELECT city_code, province_code, strftime(checkin, '%Y-%m-%d') AS checkin, horizon, observed, actual FROM grid"))
def fold_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.fold_frame(log(spark, sf_dir)).drop("fold_cutoff"))


def _curve(level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = curves.all_curves(log(spark, sf_dir)).filter(F.col("level") == level)
        return rounded(found.drop("level", "fold_cutoff"), 9)

    return run


for _level, _sql in (
    ("global", "SELECT CAST(-1 AS INTEGER) AS key, h AS days_to_checkin, round(f, 9) AS completion_fraction, support FROM gc"),
    ("province", "SELECT key, h AS days_to_checkin, round(f, 9) AS completion_fraction, support FROM pc"),
    ("city", "SELECT key, h AS days_to_checkin, round(f, 9) AS completion_fraction, support FROM cc"),
):
    query(f"pickup_curve_{_level}", sql(_sql))(_curve(_level))


@query(
    "curve_table",
    sql(
        """SELECT level, key, CAST(count(*) AS BIGINT) AS steps, round(max(f), 9) AS highest, round(min(f), 9) AS lowest, max(support) AS support, any_value(name) AS name FROM (
        SELECT 'global' AS level, CAST(-1 AS INTEGER) AS key, f, support, 'all' AS name FROM gc
        UNION ALL SELECT 'province', key, f, support, (SELECT min(province) FROM ci WHERE province_code = key) FROM pc
        UNION ALL SELECT 'city', key, f, support, (SELECT city FROM ci WHERE city_code = key) FROM cc) GROUP BY level, key"""
    ),
)
def curve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    found = curves.all_curves(data).groupBy("level", "key").agg(F.count(F.lit(1)).alias("steps"), F.max("completion_fraction").alias("highest"), F.min("completion_fraction").alias("lowest"), F.max("support").alias("support"))
    names = data.cities.select(F.lit("city").alias("level"), F.col("city_code").alias("key"), F.col("city").alias("name"))
    names = names.unionByName(data.cities.groupBy(F.lit("province").alias("level"), F.col("province_code").alias("key")).agg(F.min("province").alias("name")))
    return rounded(found.join(names, ["level", "key"], "left").withColumn("name", F.coalesce("name", F.lit("all"))), 9)


@query("curve_fraction", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, horizon, round(fraction, 9) AS completion_fraction, source AS curve_source FROM pred"))
def curve_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(curves.with_fraction(asof.forecast_grid(data), data).select("city_code", "checkin", "horizon", "completion_fraction", "curve_source"), 9)


@query("curve_source", sql("SELECT city_code, min(source) AS curve_source FROM pred GROUP BY ALL"))
def curve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    rows = data.cities.select("city_code", "province_code").withColumns({"horizon": F.lit(0), "fold_cutoff": F.lit(C.cutoff)})
    return curves.with_fraction(rows, data).select("city_code", "curve_source")


PRIOR = [
    f"w0 AS (SELECT greatest(DATE '{C.cutoff}' - {C.prior_window_days - 1}, (SELECT min(checkin) FROM hist)) AS d0)",
    f"wd AS (SELECT CAST(d AS DATE) AS d, CAST(isodow(d) - 1 AS INTEGER) AS weekday FROM generate_series((SELECT d0 FROM w0), DATE '{C.cutoff}', INTERVAL 1 DAY) t(d))",
    "rc AS (SELECT city_code, province_code, CAST(isodow(checkin) - 1 AS INTEGER) AS weekday, CAST(sum(n) AS BIGINT) AS n FROM hist WHERE checkin >= (SELECT d0 FROM w0) GROUP BY ALL)",
    "bw AS (SELECT city_code, weekday, n / (SELECT count(*) FROM wd WHERE wd.weekday = rc.weekday)::DOUBLE AS mean FROM rc)",
    "bc AS (SELECT city_code, any_value(province_code) AS province_code, sum(n)::DOUBLE / (SELECT count(*) FROM wd) AS mean FROM rc GROUP BY city_code)",
    "bp AS (SELECT province_code, quantile_cont(mean, 0.5) AS mean FROM bc WHERE province_code IS NOT NULL GROUP BY ALL)",
    "bg AS (SELECT quantile_cont(mean, 0.5) AS mean FROM bc)",
    """prior AS (SELECT g.city_code, g.checkin, coalesce(bw.mean, bc.mean, bp.mean, bg.mean, 0) AS level FROM grid g
        LEFT JOIN bw ON bw.city_code = g.city_code AND bw.weekday = isodow(g.checkin) - 1 LEFT JOIN bc ON bc.city_code = g.city_code
        LEFT JOIN bp ON bp.province_code = g.province_code, bg)""",
]


@query("demand_prior", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, round(level, 6) AS city_weekday_mean FROM prior", *PRIOR))
def demand_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(curves.with_demand_prior(asof.forecast_grid(data), data).select("city_code", "checkin", "city_weekday_mean"))


@query(
    "zero_prior",
    sql(
        """SELECT level, key, horizon, round(total::DOUBLE / greatest(n, 1), 6) AS expected FROM (
        SELECT 'city' AS level, city_code AS key, horizon, sum(CASE WHEN bucket < horizon THEN n ELSE 0 END) AS total, count(*) FILTER (bucket < horizon) AS n FROM hp, hz GROUP BY ALL
        UNION ALL SELECT 'province', province_code, horizon, sum(CASE WHEN bucket < horizon THEN n ELSE 0 END), count(*) FILTER (bucket < horizon) FROM hp, hz GROUP BY ALL
        UNION ALL SELECT 'global', -1, horizon, sum(CASE WHEN bucket < horizon THEN n ELSE 0 END), count(*) FILTER (bucket < horizon) FROM hp, hz GROUP BY ALL)"""
    ),
)
def zero_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.zero_prior(log(spark, sf_dir)).drop("fold_cutoff"))


@query("pickup_forecast", sql("SELECT city_code, province_code, strftime(checkin, '%Y-%m-%d') AS checkin, horizon, observed, round(fraction, 6) AS completion_fraction, source AS curve_source, round(observed / fraction, 6) AS projection, round(predicted, 6) AS predicted_demand FROM pred"))
def pickup_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.pickup_forecast(log(spark, sf_dir)).drop("fold_cutoff"))


@query("pickup_forecast_whole", sql("SELECT city_code AS cluster_code, strftime(checkin, '%Y-%m-%d') AS checkin, greatest(CAST(round_even(predicted, 0) AS BIGINT), observed) AS predicted_demand FROM pred"))
def pickup_forecast_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission: half-even whole numbers, never below what is seen."""
    found = curves.pickup_forecast(log(spark, sf_dir))
    whole = F.greatest(F.rint(F.coalesce("predicted_demand", F.lit(0.0))).cast("long"), F.col("observed"))
    return found.select(F.col("city_code").alias("cluster_code"), day("checkin"), whole.alias("predicted_demand"))
