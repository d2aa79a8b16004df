"""Feature frames and city statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.functions import calendar
from leadtide.operators import asof, features, frames
from leadtide.plans.base import day, log, rounded, sql
from leadtide.registry import query
from leadtide.sources import tables

_START = C.cutoff - timedelta(days=C.train_window_days - 1)
_KEY = "strftime(checkin, '%Y-%m-%d') AS checkin"
PAIRS = f"pw AS (SELECT city_code, province_code, CAST(d AS DATE) AS checkin FROM ci, generate_series(DATE '{_START}', DATE '{C.cutoff}', INTERVAL 1 DAY) t(d))"
HORIZONS = f"hh AS (SELECT CAST(unnest({list(C.train_horizons)}) AS INTEGER) AS horizon)"
WINDOW = f"pe AS (SELECT ev.city_code, province_code, checkin, lead, n FROM ev JOIN ci USING (city_code) WHERE checkin BETWEEN DATE '{_START}' AND DATE '{C.cutoff}' AND lead < 60)"


def _sum(low: str, width: int | None = None) -> str:
    upper = f" AND lead < {low} + {width}" if width else ""
    return f"CAST(coalesce(sum(n) FILTER (lead >= {low}{upper}), 0) AS BIGINT)"


def _block(keys: str, grid: str, prefix: str = "") -> str:
    on = " AND ".join(f"g.{k} = e.{k}" for k in keys.split(", "))
    group = ", ".join(f"g.{k}" for k in keys.split(", "))
    pick = ", ".join(f"{_sum('horizon', w)} AS {prefix}pickup_{w}d" for w in (1, 3, 7, 14))
    speed = ", ".join(f"round({_sum('horizon', w)} / {w}.0::DOUBLE, 6) AS {prefix}pickup_velocity_{w}d" for w in (3, 7, 14))
    accel = ", ".join(f"round({_sum('horizon', w)} / {w}.0::DOUBLE - {_sum(f'(horizon + {w})', w)} / {w}.0::DOUBLE, 6) AS {prefix}pickup_acceleration_{w}d" for w in (3, 7))
    return f"SELECT {group}, horizon, {_sum('horizon')} AS {prefix}observed_total, {pick}, {speed}, {accel} FROM (SELECT DISTINCT {keys} FROM {grid}) g CROSS JOIN hh LEFT JOIN pe e ON {on} GROUP BY {group}, horizon"


PB = f"pb AS ({_block('city_code, checkin', 'pw')})"
MB = f"mb AS ({_block('checkin', 'pw', 'market_')})"
VB = f"vb AS ({_block('province_code, checkin', 'pw', 'province_')})"


AROUND = ("observed_total", "pickup_1d", "pickup_3d", "pickup_7d", "pickup_14d", "pickup_velocity_3d", "pickup_velocity_7d", "pickup_velocity_14d", "pickup_acceleration_3d", "pickup_acceleration_7d")


def _training(spark: SparkSession, sf_dir: str, *columns: str, **digits: int) -> DataFrame:
    """Columns of the training frame as `rounded` gives them."""
    return frames.training_frame(log(spark, sf_dir), columns, digits)


@query("pair_state", sql(f"SELECT city_code, {_KEY}, list(coalesce(n, 0) ORDER BY h) AS daily, CAST(sum(n) AS BIGINT) AS final FROM (SELECT pw.city_code, pw.checkin, h, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM pw CROSS JOIN steps LEFT JOIN pe ON pe.city_code = pw.city_code AND pe.checkin = pw.checkin AND pe.lead = h GROUP BY ALL) GROUP BY ALL", PAIRS, WINDOW))
def pair_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    grid = asof.complete_grid(data.cities.select("city_code"), _START, C.cutoff)
    events = data.all.filter(F.col("checkin").between(F.lit(_START), F.lit(C.cutoff)))
    return asof.pair_state(grid, events).select("city_code", day("checkin"), "daily", F.element_at("cum", 1).alias("final"))


@query("pickup_features", sql(f"SELECT city_code, {_KEY}, horizon, observed_total, pickup_1d, pickup_3d, pickup_7d, pickup_14d, pickup_velocity_3d, pickup_velocity_7d, pickup_velocity_14d, pickup_acceleration_3d, pickup_acceleration_7d, round(pickup_1d / (observed_total + 1e-6), 6) AS pickup_1d_share, round(pickup_3d / (observed_total + 1e-6), 6) AS pickup_3d_share, round(pickup_7d / (observed_total + 1e-6), 6) AS pickup_7d_share, round(pickup_3d / (pickup_7d + 1e-6), 6) AS pickup_3d_over_7d FROM pb", PAIRS, HORIZONS, WINDOW, PB))
def pickup_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = ("pickup_1d_share", "pickup_3d_share", "pickup_7d_share", "pickup_3d_over_7d")
    return _training(spark, sf_dir, "city_code", "checkin", "horizon", *AROUND, *shares)


@query(
    "activity_features",
    sql(
        f"""SELECT g.city_code, strftime(g.checkin, '%Y-%m-%d') AS checkin, horizon, CAST(count(lead) AS INTEGER) AS active_search_days, CAST(max(lead) - horizon AS INTEGER) AS days_since_first_search,
        CAST(min(lead) - horizon AS INTEGER) AS days_since_last_search, CAST(coalesce(max(n), 0) AS BIGINT) AS max_daily_search, round(coalesce(avg(n), 0), 6) AS mean_daily_search,
        round(coalesce(stddev_pop(n), 0), 4) AS std_daily_search, CAST(max(lead) - min(lead) AS INTEGER) AS search_span
        FROM (SELECT DISTINCT city_code, checkin FROM pw) g CROSS JOIN hh LEFT JOIN (SELECT city_code, checkin, lead, sum(n) AS n FROM pe GROUP BY ALL) e ON g.city_code = e.city_code AND g.checkin = e.checkin AND lead >= horizon GROUP BY g.city_code, g.checkin, horizon""",
        PAIRS, HORIZONS, WINDOW,
    ),
)
def activity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("active_search_days", "days_since_first_search", "days_since_last_search", "max_daily_search", "mean_daily_search", "std_daily_search", "search_span")
    return _training(spark, sf_dir, "city_code", "checkin", "horizon", *names, std_daily_search=4)


@query(
    "curve_features",
    sql(
        f"""SELECT pb.city_code, strftime(pb.checkin, '%Y-%m-%d') AS checkin, pb.horizon, round(f, 6) AS expected_completion_fraction, round(1 - f, 6) AS expected_remaining_fraction, round(greatest(observed_total / f, observed_total), 6) AS pickup_baseline_prediction,
        round(greatest(observed_total / f - observed_total, 0), 6) AS pickup_baseline_remaining, round(observed_total / (zp.expected * f + 1e-6), 4) AS pickup_surprise
        FROM pb JOIN (SELECT ci.city_code, hh.horizon, greatest(least(coalesce(cc.f, pc.f, gc.f), 1.0), {C.min_fraction}) AS f FROM ci CROSS JOIN hh LEFT JOIN cc ON cc.key = ci.city_code AND cc.h = hh.horizon
            LEFT JOIN pc ON pc.key = ci.province_code AND pc.h = hh.horizon LEFT JOIN gc ON gc.h = hh.horizon) x ON x.city_code = pb.city_code AND x.horizon = pb.horizon
        JOIN zp ON zp.city_code = pb.city_code AND zp.horizon = pb.horizon""",
        PAIRS, HORIZONS, WINDOW, PB,
    ),
)
def curve_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("expected_completion_fraction", "expected_remaining_fraction", "pickup_baseline_prediction", "pickup_baseline_remaining", "pickup_surprise")
    return _training(spark, sf_dir, "city_code", "checkin", "horizon", *names, pickup_surprise=4)


@query("market_features", sql("SELECT strftime(checkin, '%Y-%m-%d') AS checkin, * EXCLUDE (checkin) FROM mb", PAIRS, HORIZONS, WINDOW, MB))
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.around_features(*features.training_counts(log(spark, sf_dir)), ["checkin"], "market_", C.train_horizons))


@query("province_features", sql("SELECT strftime(checkin, '%Y-%m-%d') AS checkin, * EXCLUDE (checkin) FROM vb", PAIRS, HORIZONS, WINDOW, VB))
def province_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.around_features(*features.training_counts(log(spark, sf_dir)), ["province_code", "checkin"], "province_", C.train_horizons))


@query("training_frame", sql(f"SELECT pb.city_code, strftime(pb.checkin, '%Y-%m-%d') AS checkin, pb.horizon, observed_total, greatest(CAST(coalesce(f.n, 0) AS BIGINT) - observed_total, 0) AS remaining_demand, round(observed_total / (market_observed_total + 1e-6), 6) AS city_share_of_market, round(observed_total / (province_observed_total + 1e-6), 6) AS city_share_of_province FROM pb JOIN ci USING (city_code) JOIN mb USING (checkin, horizon) JOIN vb USING (province_code, checkin, horizon) LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM pe GROUP BY ALL) f USING (city_code, checkin)", PAIRS, HORIZONS, WINDOW, PB, MB, VB))
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("observed_total", "remaining_demand", "city_share_of_market", "city_share_of_province")
    return _training(spark, sf_dir, "city_code", "checkin", "horizon", *names)


_IE = "ie AS (SELECT g.city_code, g.province_code, g.checkin, g.horizon, CAST(coalesce(sum(n), 0) AS BIGINT) AS observed_total, CAST(coalesce(sum(n) FILTER (lead < g.horizon + 7), 0) AS BIGINT) AS pickup_7d, CAST(count(DISTINCT lead) AS INTEGER) AS active_search_days FROM grid g LEFT JOIN evl e ON e.city_code = g.city_code AND e.checkin = g.checkin AND lead >= g.horizon GROUP BY ALL)"


@query("inference_frame", sql(f"SELECT city_code, province_code, {_KEY}, horizon AS days_to_checkin, observed_total, pickup_7d, active_search_days, round(observed_total / (sum(observed_total) OVER (PARTITION BY checkin) + 1e-6), 6) AS city_share_of_market FROM ie", _IE))
def inference_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.inference_frame(log(spark, sf_dir)).select("city_code", "province_code", "checkin", "days_to_checkin", "observed_total", "pickup_7d", "active_search_days", "city_share_of_market"))


@query("compact_features")
def compact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir, "checkin", *features.COMPACT)


@query("feature_gate")
def feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.allowed(frames.gate_counts(log(spark, sf_dir), tuple(c for c in frames.COLUMNS if c not in ("checkin", "fold_cutoff"))))


_HD = f"hd AS (SELECT g.city_code, g.d AS checkin, isodow(g.d) - 1 AS wd, CAST(coalesce(p.n, 0) AS BIGINT) AS n FROM (SELECT city_code, CAST(d AS DATE) AS d FROM ci, generate_series(greatest(DATE '{C.cutoff - timedelta(days=C.history_days - 1)}', (SELECT min(checkin) FROM hist)), DATE '{C.cutoff}', INTERVAL 1 DAY) t(d)) g LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM hist GROUP BY ALL) p ON p.city_code = g.city_code AND p.checkin = g.d)"
_STATS = "round(avg(n), 6) AS city_hist_mean, round(quantile_cont(n, 0.5), 6) AS city_hist_median, round(quantile_cont(n, 0.75), 6) AS city_hist_p75, round(quantile_cont(n, 0.9), 6) AS city_hist_p90, round(stddev_samp(n), 6) AS city_hist_std, round(stddev_samp(n) / (avg(n) + 1e-6), 6) AS city_volatility, round(coalesce(avg(n) FILTER (wd IN (3, 4)) / (avg(n) FILTER (wd NOT IN (3, 4)) + 1e-6), 1), 5) AS city_weekend_ratio"


@query("city_history", sql(f"SELECT city_code, {_STATS}, " + ", ".join(f"round(avg(n) FILTER (wd = {d}), 6) AS weekday_mean_{d}" for d in range(7)) + " FROM hd GROUP BY city_code", _HD))
def city_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.city_history(log(spark, sf_dir)), city_weekend_ratio=5)


@query("origin_history", sql(f"SELECT g.city_code, strftime(g.checkin, '%Y-%m-%d') AS checkin, horizon, {_STATS.replace('stddev_samp(n)', 'coalesce(stddev_samp(n), 0)')} FROM grid g JOIN hd ON hd.city_code = g.city_code AND hd.checkin <= least(g.checkin - g.horizon, DATE '{C.cutoff}') GROUP BY ALL", _HD))
def origin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    found = features.with_origin_history(asof.target_grid(data), data)
    return rounded(found.select("city_code", "checkin", "horizon", *features.HISTORY), city_weekend_ratio=5)


_FULL = f"fu AS (SELECT g.city_code, g.d AS checkin, isodow(g.d) - 1 AS wd, CAST(coalesce(p.n, 0) AS BIGINT) AS n FROM (SELECT city_code, CAST(d AS DATE) AS d FROM ci, generate_series((SELECT min(checkin) FROM hist), DATE '{C.cutoff}', INTERVAL 1 DAY) t(d)) g LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM hist GROUP BY ALL) p ON p.city_code = g.city_code AND p.checkin = g.d)"
_ROLLED = ", ".join(f"{x} OVER w AS {name}" for name, x in {"mean": "avg(n)", "median": "quantile_cont(n, 0.5)", "p75": "quantile_cont(n, 0.75)", "p90": "quantile_cont(n, 0.9)", "std": "stddev_samp(n)", "wend": "avg(CASE WHEN wd IN (3, 4) THEN n END)", "work": "avg(CASE WHEN wd NOT IN (3, 4) THEN n END)", **{f"w{k}": f"avg(CASE WHEN wd = {k} THEN n END)" for k in range(7)}}.items())
_RH = f"rh AS (SELECT city_code, checkin AS origin, {_ROLLED} FROM fu WINDOW w AS (PARTITION BY city_code ORDER BY checkin ROWS BETWEEN {C.history_days - 1} PRECEDING AND CURRENT ROW))"


@query(
    "history_features",
    sql(
        f"""SELECT pw.city_code, strftime(pw.checkin, '%Y-%m-%d') AS checkin, horizon, round(lat, 6) AS lat, round(long, 6) AS long, round(coalesce(mean, 0), 6) AS city_hist_mean, round(coalesce(median, 0), 6) AS city_hist_median, round(coalesce(p75, 0), 6) AS city_hist_p75, round(coalesce(p90, 0), 6) AS city_hist_p90,
        round(coalesce(std, 0), 6) AS city_hist_std, round(coalesce(std / (mean + 1e-6), 0), 6) AS city_volatility, round(CASE WHEN mean IS NULL THEN 0 ELSE coalesce(wend / (work + 1e-6), 1) END, 5) AS city_weekend_ratio, round(coalesce(CASE isodow(pw.checkin) {" ".join(f"WHEN {k + 1} THEN w{k}" for k in range(7))} END, 0), 6) AS city_weekday_mean
        FROM pw CROSS JOIN hh JOIN ci USING (city_code) LEFT JOIN rh ON rh.city_code = pw.city_code AND rh.origin = least(pw.checkin - horizon, DATE '{C.cutoff}')""",
        PAIRS, HORIZONS, _FULL, _RH,
    ),
)
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir, "city_code", "checkin", "horizon", "lat", "long", *features.HISTORY, "city_weekday_mean", city_weekend_ratio=5)


_J = "(date_diff('day', DATE '1600-01-01', d) - 79)"
_C4 = f"({_J} % 12053 % 1461)"
_R = f"(CASE WHEN {_C4} >= 366 THEN ({_C4} - 1) % 365 ELSE {_C4} END)"


@query(
    "calendar_dim",
    f"""WITH dd AS (SELECT CAST(x AS DATE) AS d FROM generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY) t(x))
    SELECT strftime(d, '%Y-%m-%d') AS ds, CAST(isodow(d) - 1 AS INTEGER) AS weekday, CAST(isodow(d) IN (4, 5) AS INTEGER) AS is_weekend, CAST(day(d) AS INTEGER) AS day_of_month, CAST(month(d) AS INTEGER) AS month,
    CAST(quarter(d) AS INTEGER) AS quarter, CAST(week(d) AS INTEGER) AS week, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(day(d) = 1 AS INTEGER) AS month_start, CAST(last_day(d) = d AS INTEGER) AS month_end,
    CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) < 6 THEN 'spring' WHEN month(d) < 9 THEN 'summer' ELSE 'autumn' END AS season,
    round(sin(2 * pi() * (isodow(d) - 1) / 7), 9) AS sin_dow, round(cos(2 * pi() * dayofyear(d) / 365.25), 9) AS cos_doy,
    CAST(979 + 33 * ({_J} // 12053) + 4 * ({_J} % 12053 // 1461) + CASE WHEN {_C4} >= 366 THEN ({_C4} - 1) // 365 ELSE 0 END AS INTEGER) AS jalali_year,
    CAST(CASE WHEN {_R} < 186 THEN 1 + {_R} // 31 ELSE 7 + ({_R} - 186) // 30 END AS INTEGER) AS jalali_month, CAST(CASE WHEN {_R} < 186 THEN 1 + {_R} % 31 ELSE 1 + ({_R} - 186) % 30 END AS INTEGER) AS jalali_day, strftime(d, '%Y-%m-%d') AS back FROM dd""",
)
def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = tables.table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    dates = span.select(F.explode(F.sequence("a", "b")).alias("ds"))
    c = calendar.calendar_columns("ds")
    y, m, d = calendar.jalali_parts("ds")
    out = dates.select(
        "ds", c["cal_day_of_week"].alias("weekday"), c["cal_is_weekend"].alias("is_weekend"), c["cal_day_of_month"].alias("day_of_month"), c["cal_month"].alias("month"), c["cal_quarter"].alias("quarter"),
        c["cal_week_of_year"].alias("week"), c["cal_day_of_year"].alias("day_of_year"), c["cal_is_month_start"].alias("month_start"), c["cal_is_month_end"].alias("month_end"), calendar.season_name("ds").alias("season"),
        c["cal_sin_dow"].alias("sin_dow"), c["cal_cos_doy"].alias("cos_doy"), y.alias("jalali_year"), m.alias("jalali_month"), d.alias("jalali_day"), calendar.from_jalali(y, m, d).alias("back"),
    )
    return rounded(out, 9)


@query(
    "event_distance",
    """WITH dd AS (SELECT CAST(o_orderdate AS DATE) AS ds, max(CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 440000 THEN 1 ELSE 0 END) AS flag FROM orders GROUP BY ALL)
    SELECT strftime(a.ds, '%Y-%m-%d') AS ds, CAST(a.flag AS INTEGER) AS flag, CAST(least(coalesce(min(a.ds - b.ds) FILTER (b.ds <= a.ds), 60), 60) AS INTEGER) AS days_from, CAST(least(coalesce(min(b.ds - a.ds) FILTER (b.ds >= a.ds), 60), 60) AS INTEGER) AS days_to
    FROM dd a LEFT JOIN dd b ON b.flag = 1 GROUP BY a.ds, a.flag""",
)
def event_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") > 440000), 1).otherwise(0)
    dates = rows.groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.max(flag).alias("flag"))
    return rounded(calendar.event_distance(dates, "ds", "flag"))
