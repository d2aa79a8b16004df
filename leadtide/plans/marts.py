"""Marts and serving queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.operators import marts
from leadtide.plans.base import buckets_sql, log, rounded, sql
from leadtide.registry import query
from leadtide.sources import tables

DATES = [str(C.cutoff + timedelta(days=i)) for i in range(1, C.target_days + 1)]
_TEXT = "strftime(checkin, '%Y-%m-%d') AS checkin"
NF = "nf AS (SELECT city_code, ci.city, ci.province, checkin, horizon, greatest(CAST(round_even(predicted, 0) AS BIGINT), observed) AS predicted_demand, observed AS observed_so_far, greatest(CAST(round_even(predicted, 0) AS BIGINT), observed) - observed AS predicted_remaining FROM pred JOIN ci USING (city_code))"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in marts.SUMS)
MO = f"""mo AS (SELECT city_code, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(recent) AS BIGINT) AS recent_pickup, sum(observed / greatest(f, 1e-9) * greatest(f - f7, 1e-9)) AS expected_pickup, min(source) AS curve_source FROM (
    SELECT p.*, coalesce(r.n, 0) AS recent, p.fraction AS f, greatest(least(coalesce(cc.f, pc.f, gc.f), 1.0), {C.min_fraction}) AS f7 FROM pred p
    LEFT JOIN cc ON cc.key = p.city_code AND cc.h = p.horizon + {C.momentum_days} LEFT JOIN pc ON pc.key = p.province_code AND pc.h = p.horizon + {C.momentum_days} LEFT JOIN gc ON gc.h = p.horizon + {C.momentum_days}
    LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM evl WHERE log_date > DATE '{C.cutoff}' - {C.momentum_days} GROUP BY ALL) r ON r.city_code = p.city_code AND r.checkin = p.checkin) GROUP BY city_code)"""
_RATIO = "CASE WHEN expected_pickup <> 0 THEN recent_pickup / expected_pickup END"
HM = f"hm AS (SELECT g.city_code, g.d AS checkin, CAST(coalesce(n, 0) AS BIGINT) AS demand FROM (SELECT city_code, CAST(d AS DATE) AS d FROM ci, generate_series(DATE '{C.cutoff}' - {C.mart_days - 1}, DATE '{C.cutoff}', INTERVAL 1 DAY) t(d)) g LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM ev GROUP BY ALL) p ON p.city_code = g.city_code AND p.checkin = g.d)"


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.named_forecast(log(spark, sf_dir))


@query("named_forecast", sql(f"SELECT city_code, city, province, {_TEXT}, predicted_demand, observed_so_far, predicted_remaining FROM nf", NF))
def named_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_forecast(spark, sf_dir).drop("horizon", "curve_source"))


@query("target_pickup", sql(f"SELECT city_code, {_TEXT}, lead AS days_to_checkin, n AS searches, CAST(sum(n) OVER (PARTITION BY city_code, checkin ORDER BY lead DESC) AS BIGINT) AS observed_cumulative FROM (SELECT city_code, checkin, lead, CAST(sum(n) AS BIGINT) AS n FROM evl GROUP BY ALL)"))
def target_pickup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.target_pickup(log(spark, sf_dir)))


@query("city_momentum", sql(f"SELECT city_code, observed, recent_pickup, round(expected_pickup, 6) AS expected_pickup, curve_source, round({_RATIO}, 6) AS pickup_ratio FROM mo", MO))
def city_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.city_momentum(log(spark, sf_dir)))


@query("momentum_leaders", sql(f"SELECT city_code, observed, round({_RATIO}, 6) AS pickup_ratio FROM mo WHERE observed >= (SELECT quantile_cont(observed, 0.75) FROM mo WHERE expected_pickup <> 0) AND expected_pickup <> 0 ORDER BY recent_pickup / expected_pickup DESC, city_code LIMIT 10", MO))
def momentum_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.momentum_leaders(marts.city_momentum(log(spark, sf_dir))).select("city_code", "observed", "pickup_ratio"))


@query("history_mart", sql(f"SELECT city_code, {_TEXT}, demand FROM hm", HM))
def history_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.history_mart(log(spark, sf_dir)))


@query("province_summary", sql(f"SELECT province, {_SUMS}, CAST(count(DISTINCT city_code) AS BIGINT) AS cities, round(sum(predicted_demand) / (SELECT sum(predicted_demand) FROM nf), 6) AS share FROM nf GROUP BY province", NF))
def province_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.province_summary(_forecast(spark, sf_dir)))


@query(
    "daily_series",
    sql(
        f"""SELECT {_TEXT}, predicted_demand, observed_so_far, predicted_remaining, round(predicted_demand / greatest(m, 1) - 1, 6) AS deviation_from_mean, CASE WHEN predicted_demand >= hi THEN 'high' WHEN predicted_demand <= lo THEN 'low' ELSE 'normal' END AS demand_band
        FROM (SELECT checkin, {_SUMS} FROM nf GROUP BY checkin) d, (SELECT avg(s) AS m, quantile_cont(s, 0.2) AS lo, quantile_cont(s, 0.8) AS hi FROM (SELECT sum(predicted_demand)::DOUBLE AS s FROM nf GROUP BY checkin))""",
        NF,
    ),
)
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.daily_series(_forecast(spark, sf_dir)))


CT = f"""ct AS (SELECT t.*, round(predicted_demand / (SELECT sum(predicted_demand) FROM nf), 6) AS share, round(sum(predicted_demand) OVER (ORDER BY predicted_demand DESC, city_code) / (SELECT sum(predicted_demand) FROM nf), 6) AS cumulative_share,
    round(observed_so_far / greatest(predicted_demand, 1), 6) AS observed_share, round(predicted_remaining / greatest(predicted_demand, 1), 6) AS remaining_share, round(h.m, 6) AS historical_mean, round(h.s / greatest(h.m, 1), 6) AS historical_cv, round({_RATIO}, 6) AS pickup_ratio
    FROM (SELECT city_code, city, province, {_SUMS} FROM nf GROUP BY ALL) t LEFT JOIN (SELECT city_code, avg(demand) AS m, stddev_samp(demand) AS s FROM hm GROUP BY ALL) h USING (city_code) LEFT JOIN mo USING (city_code))"""


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return marts.city_table(marts.named_forecast(data), marts.city_momentum(data), marts.history_mart(data))


@query("city_table", sql("SELECT * FROM ct", NF, MO, HM, CT))
def city_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cities(spark, sf_dir))


@query("dashboard_thresholds", sql("SELECT round(quantile_cont(predicted_demand, 0.5), 6) AS demand_median, round(quantile_cont(pickup_ratio, 0.5), 5) AS pickup_median, round(quantile_cont(remaining_share, 0.5), 5) AS remaining_share_median FROM ct", NF, MO, HM, CT))
def dashboard_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.thresholds(_cities(spark, sf_dir)), pickup_median=5, remaining_share_median=5)


@query("horizon_shares", sql(f"SELECT {buckets_sql('horizon')} AS bucket, CAST(sum(observed_so_far) AS BIGINT) AS observed, CAST(sum(predicted_demand) AS BIGINT) AS total, round(sum(observed_so_far) / greatest(sum(predicted_demand), 1), 6) AS observed_share FROM nf GROUP BY ALL", NF))
def horizon_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.horizon_shares(_forecast(spark, sf_dir), C.horizon_buckets))


@query("heatmap", sql("SELECT city_code, city, province, " + ", ".join(f"CAST(sum(predicted_demand) FILTER (checkin = DATE '{d}') AS BIGINT) AS \"{d}\"" for d in DATES) + " FROM nf WHERE city_code IN (SELECT city_code FROM nf GROUP BY city_code ORDER BY sum(predicted_demand) DESC, city_code LIMIT 20) GROUP BY ALL", NF))
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.heatmap(_forecast(spark, sf_dir), DATES)


@query(
    "overview",
    sql(
        f"""SELECT CAST(sum(predicted_demand) AS BIGINT) AS total_predicted_demand, CAST(sum(observed_so_far) AS BIGINT) AS total_observed_so_far, CAST(sum(predicted_remaining) AS BIGINT) AS total_predicted_remaining, CAST(count(DISTINCT city_code) AS BIGINT) AS cities, CAST(count(DISTINCT checkin) AS BIGINT) AS dates,
        (SELECT strftime(checkin, '%Y-%m-%d') FROM d ORDER BY s DESC, checkin LIMIT 1) AS peak_date, (SELECT max(s) FROM d) AS peak_demand, (SELECT strftime(checkin, '%Y-%m-%d') FROM d ORDER BY s, checkin LIMIT 1) AS low_date, (SELECT min(s) FROM d) AS low_demand,
        (SELECT city FROM t ORDER BY s DESC, city_code LIMIT 1) AS top_city, (SELECT max(s) FROM t) AS top_city_demand, (SELECT city_code FROM hot) AS fastest_city, (SELECT round(r, 6) FROM hot) AS fastest_ratio FROM nf""",
        NF, MO, "d AS (SELECT checkin, CAST(sum(predicted_demand) AS BIGINT) AS s FROM nf GROUP BY checkin)", "t AS (SELECT city_code, city, CAST(sum(predicted_demand) AS BIGINT) AS s FROM nf GROUP BY ALL)",
        f"hot AS (SELECT city_code, {_RATIO} AS r FROM mo WHERE expected_pickup <> 0 AND observed >= (SELECT quantile_cont(observed, 0.75) FROM mo WHERE expected_pickup <> 0) ORDER BY r DESC, city_code LIMIT 1)",
    ),
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(marts.overview(marts.named_forecast(data), marts.city_momentum(data)))


@query(
    "decision_queue",
    sql(
        f"""SELECT t.*, round(predicted_demand / (SELECT sum(predicted_demand) FROM nf), 6) AS forecast_share, CASE WHEN predicted_demand > 0 THEN round(observed_so_far / predicted_demand, 6) ELSE 0 END AS observed_share, round({_RATIO}, 6) AS pickup_ratio,
        (SELECT strftime(checkin, '%Y-%m-%d') FROM nf x WHERE x.city_code = t.city_code ORDER BY predicted_demand DESC, checkin LIMIT 1) AS peak_checkin,
        CASE WHEN observed_so_far = 0 THEN 'no searches seen: manual review' ELSE 'forecast from history: analyst review' END AS evidence_status
        FROM (SELECT city_code, city, province, {_SUMS} FROM nf GROUP BY ALL) t LEFT JOIN mo USING (city_code)""",
        NF, MO,
    ),
)
def decision_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(marts.decision_queue(marts.named_forecast(data), marts.city_momentum(data)))


@query("pickup_chart", sql("SELECT h AS days_to_checkin, CAST(coalesce(s, 0) AS BIGINT) AS searches, round(f * (SELECT sum(predicted_demand) FROM nf), 6) AS expected_cumulative FROM gc LEFT JOIN (SELECT lead, sum(n) AS s FROM evl GROUP BY ALL) ON lead = h", NF))
def pickup_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(marts.pickup_chart(data, marts.named_forecast(data)))


@query("city_report", sql(f"SELECT city_code, city, province, {_TEXT}, predicted_demand FROM nf WHERE lower(trim(province)) = 'asia' AND checkin BETWEEN DATE '{DATES[2]}' AND DATE '{DATES[9]}'", NF))
def city_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marts.report(_forecast(spark, sf_dir), province=" Asia ", start=C.cutoff + timedelta(days=3), end=C.cutoff + timedelta(days=10))
    return rounded(found.select("city_code", "city", "province", "checkin", "predicted_demand"))


@query("city_peaks", sql(f"SELECT * FROM (SELECT city_code, {_TEXT}, predicted_demand, CAST(row_number() OVER (PARTITION BY city_code ORDER BY predicted_demand DESC, nf.checkin) AS INTEGER) AS rank FROM nf) WHERE rank <= 5", NF))
def city_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marts.peaks_of_city(_forecast(spark, sf_dir)).select("city_code", "checkin", "predicted_demand", "rank"))


@query("city_detail", sql(f"SELECT city_code, {_TEXT}, predicted_demand, observed_so_far FROM nf WHERE lower(city) = 'supplier#000000007'", NF))
def city_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    city = marts.resolve(data.cities, " supplier#000000007 ")
    return rounded(marts.named_forecast(data).join(F.broadcast(city.select("city_code")), "city_code", "left_semi").select("city_code", "checkin", "predicted_demand", "observed_so_far"))


def _study_sql(clock: str, col: str) -> str:
    return f"""SELECT '{clock}' AS clock, period, CAST(count(*) AS BIGINT) AS days, round(avg(n), 6) AS mean, round(sum(n) / sum(u), 6) AS weekday_adjusted_ratio FROM (
        SELECT d.*, u FROM (SELECT {col} AS day, CAST(sum(n) AS BIGINT) AS n, CASE WHEN {col} BETWEEN DATE '1998-12-20' AND DATE '1999-01-05' THEN 'turn of the year' WHEN {col} BETWEEN DATE '1999-03-15' AND DATE '1999-04-05' THEN 'spring' ELSE 'other' END AS period FROM hist GROUP BY {col}) d
        LEFT JOIN (SELECT isodow({col}) AS w, avg(n) AS u FROM (SELECT {col}, sum(n) AS n FROM hist WHERE NOT ({col} BETWEEN DATE '1998-12-20' AND DATE '1999-01-05' OR {col} BETWEEN DATE '1999-03-15' AND DATE '1999-04-05') GROUP BY {col}) GROUP BY ALL) x ON x.w = isodow(d.day)) GROUP BY period"""


@query("period_study", sql(_study_sql("checkin", "checkin") + " UNION ALL " + _study_sql("log_date", "log_date")))
def period_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).history
    between = lambda a, b: F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    periods = {"turn of the year": between("1998-12-20", "1999-01-05"), "spring": between("1999-03-15", "1999-04-05")}
    return rounded(marts.period_study(rows, "checkin", periods).unionByName(marts.period_study(rows, "log_date", periods)))


_YEAR_START = "(DATE '1600-01-01' + CAST(79 + 365 * ({y} - 979) + 8 * (({y} - 979) // 33) + (({y} - 979) % 33 + 3) // 4 AS INTEGER))"


def _year_sql(clock: str) -> str:
    """The year before is as long as its two first days are apart; only the 366th day of a year may have no counterpart."""
    c4 = f"(date_diff('day', DATE '1600-01-01', {clock}) - 79) % 12053 % 1461"
    year = f"979 + 33 * ((date_diff('day', DATE '1600-01-01', {clock}) - 79) // 12053) + 4 * ((date_diff('day', DATE '1600-01-01', {clock}) - 79) % 12053 // 1461) + CASE WHEN {c4} >= 366 THEN ({c4} - 1) // 365 ELSE 0 END"
    start, before = _YEAR_START.format(y="y"), _YEAR_START.format(y="(y - 1)")
    daily = f"SELECT {clock} AS day, CAST(sum(n) AS BIGINT) AS n, {year} AS y FROM hist GROUP BY {clock}"
    return f"""SELECT '{clock}' AS clock, period, CAST(count(*) AS BIGINT) AS days, count(b.n) AS days_before, round(sum(d.n) / sum(b.n)::DOUBLE, 6) AS jalali_year_ratio FROM (
        SELECT n, CASE WHEN day BETWEEN DATE '1998-12-20' AND DATE '1999-01-05' THEN 'turn of the year' WHEN day BETWEEN DATE '1999-03-15' AND DATE '1999-04-05' THEN 'spring' ELSE 'other' END AS period,
            CAST(CASE WHEN day - {start} = 365 THEN day - 366 ELSE day - CAST({start} - {before} AS INTEGER) END AS DATE) AS prior FROM ({daily})) d LEFT JOIN ({daily}) b ON b.day = d.prior GROUP BY period"""


@query("jalali_year_study", sql(_year_sql("checkin") + " UNION ALL " + _year_sql("log_date")))
def jalali_year_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).history
    between = lambda a, b: F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    periods = {"turn of the year": between("1998-12-20", "1999-01-05"), "spring": between("1999-03-15", "1999-04-05")}
    return rounded(marts.jalali_year_study(rows, "checkin", periods).unionByName(marts.jalali_year_study(rows, "log_date", periods)))


@query("finite_values", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE round(sqrt(greatest(s_acctbal, 0)), 6) END AS root FROM supplier")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "supplier").select("s_suppkey", F.sqrt("s_acctbal").alias("root"))  # NaN below 0
    return rounded(marts.finite(rows))
