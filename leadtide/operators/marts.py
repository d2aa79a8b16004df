"""Marts and serving queries over the forecast: totals, momentum, rankings, pivots, reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions.calendar import prior_jalali
from leadtide.operators.asof import FOLD_PAIR, PAIR, bucket_label, complete_grid, final_demand, forecast_grid
from leadtide.operators.curves import FOLD, all_curves, pickup_forecast, with_fraction
from leadtide.sources.tables import Log

SUMS = ("predicted_demand", "observed_so_far", "predicted_remaining")


def named_forecast(log: Log) -> DataFrame:
    """The forecast in whole numbers, with what is seen and what remains, and the names of its keys."""
    rows = pickup_forecast(log)
    whole = F.greatest(F.rint("predicted_demand").cast("long"), F.col("observed"))
    rows = rows.select("city_code", "checkin", "horizon", "curve_source", whole.alias("predicted_demand"), F.col("observed").alias("observed_so_far"), (whole - F.col("observed")).alias("predicted_remaining"))
    return rows.join(log.cities.select("city_code", "city", "province"), "city_code", "left").withColumns({"city": F.coalesce("city", F.col("city_code").cast("string")), "province": F.coalesce("province", F.lit("unknown"))})


def totals(forecast: DataFrame, *by: str) -> DataFrame:
    return forecast.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def share_of(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """Adds a column's share of its total, 0 where that is 0; the total is one row."""
    total = F.broadcast(df.agg(F.sum(col).alias("_total")))
    return df.crossJoin(total).withColumn(name, F.coalesce(F.try_divide(F.col(col), F.col("_total")), F.lit(0.0))).drop("_total")


def target_pickup(log: Log) -> DataFrame:
    """Searches of the target window by lead time, and their sum from the far end inwards."""
    rows = log.evaluation.groupBy(*PAIR, "days_to_checkin").agg(F.sum("search_count").alias("searches"))
    inwards = Window.partitionBy(*PAIR).orderBy(F.desc("days_to_checkin")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("observed_cumulative", F.sum("searches").over(inwards))


def city_momentum(log: Log) -> DataFrame:
    """What came in lately against what the curve expects for that stretch; null where it expects nothing."""
    days = log.cfg.momentum_days
    rows = with_fraction(forecast_grid(log), log, name="_at")
    rows = with_fraction(rows, log, F.col("horizon") + days, "_before", None)
    recent = log.evaluation.filter(F.col("log_date") > F.date_sub(FOLD, days)).groupBy(*FOLD_PAIR).agg(F.sum("search_count").alias("recent_pickup"))
    rows = rows.join(recent, FOLD_PAIR, "left").withColumn("recent_pickup", F.coalesce("recent_pickup", F.lit(0).cast("long")))
    expected = F.col("observed") / F.greatest(F.col("_at"), F.lit(1e-9)) * F.greatest(F.col("_at") - F.col("_before"), F.lit(1e-9))
    out = rows.groupBy("city_code").agg(F.sum("observed").alias("observed"), F.sum("recent_pickup").alias("recent_pickup"), F.sum(expected).alias("expected_pickup"), F.min("curve_source").alias("curve_source"))
    return out.withColumn("pickup_ratio", F.when(F.col("expected_pickup") != 0, F.col("recent_pickup") / F.col("expected_pickup")))


def momentum_leaders(momentum: DataFrame, limit: int = 10) -> DataFrame:
    """The highest ratios among cities with at least the upper quartile of observed demand."""
    known = momentum.filter("pickup_ratio IS NOT NULL")
    edge = F.broadcast(known.agg(F.percentile("observed", F.lit(0.75)).alias("_edge")))
    return known.crossJoin(edge).filter(F.col("observed") >= F.col("_edge")).drop("_edge").orderBy(F.desc("pickup_ratio"), "city_code").limit(limit)


def history_mart(log: Log) -> DataFrame:
    """Each city's demand on each of the last days before the cutoff, 0 included."""
    cfg = log.cfg
    start = cfg.cutoff - timedelta(days=cfg.mart_days - 1)
    grid = complete_grid(log.cities.select("city_code"), start, cfg.cutoff)
    return grid.join(final_demand(log.all, start, cfg.cutoff, "demand"), PAIR, "left").withColumn("demand", F.coalesce("demand", F.lit(0).cast("long")))


def province_summary(forecast: DataFrame) -> DataFrame:
    out = forecast.groupBy("province").agg(*(F.sum(c).alias(c) for c in SUMS), F.countDistinct("city_code").alias("cities"))
    return share_of(out, "predicted_demand")


def daily_series(forecast: DataFrame) -> DataFrame:
    """Totals a day, their deviation from the mean, and whether a day is high or low (outer fifths)."""
    daily = totals(forecast, "checkin")
    edges = F.broadcast(daily.agg(F.avg("predicted_demand").alias("_mean"), F.percentile("predicted_demand", F.array(F.lit(0.2), F.lit(0.8))).alias("_e")))
    d = F.col("predicted_demand")
    band = F.when(d >= F.col("_e")[1], "high").when(d <= F.col("_e")[0], "low").otherwise("normal")
    return daily.crossJoin(edges).withColumns({"deviation_from_mean": d / F.greatest(F.col("_mean"), F.lit(1.0)) - 1, "demand_band": band}).drop("_mean", "_e")


#: Ranges of demand over which an ordered sum is cut.
RANGES = 64


def city_table(forecast: DataFrame, momentum: DataFrame, history: DataFrame) -> DataFrame:
    """Totals, shares in order of demand, momentum and spread of the past by city."""
    rows = share_of(totals(forecast, "city_code", "city", "province"), "predicted_demand")
    # Ranges of demand are summed on their own; what lies above a range is added from a table of RANGES rows at most.
    points = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    edges = F.broadcast(rows.agg(F.percentile_approx("predicted_demand", points).alias("_e")))
    rows = rows.crossJoin(edges).withColumn("_range", F.size(F.filter("_e", lambda e: e > F.col("predicted_demand")))).drop("_e")
    above = rows.groupBy("_range").agg(F.sum("share").alias("_own")).withColumn("_above", F.sum("_own").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own"))
    ordered = Window.partitionBy("_range").orderBy(F.desc("predicted_demand"), "city_code").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("share").over(ordered)).join(F.broadcast(above.drop("_own")), "_range")
    top = F.greatest(F.col("predicted_demand"), F.lit(1))
    rows = rows.withColumns({"cumulative_share": F.col("_above") + F.col("_within"), "observed_share": F.col("observed_so_far") / top, "remaining_share": F.col("predicted_remaining") / top}).drop("_range", "_above", "_within")
    spread = history.groupBy("city_code").agg(F.avg("demand").alias("historical_mean"), F.stddev_samp("demand").alias("_std"))
    spread = spread.select("city_code", "historical_mean", (F.col("_std") / F.greatest(F.col("historical_mean"), F.lit(1.0))).alias("historical_cv"))
    return rows.join(spread, "city_code", "left").join(momentum.select("city_code", "pickup_ratio"), "city_code", "left")


def thresholds(cities: DataFrame) -> DataFrame:
    half = lambda c: F.percentile(c, F.lit(0.5))
    return cities.agg(half("predicted_demand").alias("demand_median"), half("pickup_ratio").alias("pickup_median"), half("remaining_share").alias("remaining_share_median"))


def horizon_shares(forecast: DataFrame, buckets: tuple[tuple[int, int], ...]) -> DataFrame:
    """The share of the forecast that is seen already, by horizon bucket."""
    rows = forecast.groupBy(bucket_label(F.col("horizon"), buckets, None).alias("bucket")).agg(F.sum("observed_so_far").alias("observed"), F.sum("predicted_demand").alias("total"))
    return rows.withColumn("observed_share", F.col("observed") / F.greatest(F.col("total"), F.lit(1)))


def top_cities(forecast: DataFrame, limit: int) -> DataFrame:
    return totals(forecast, "city_code", "city", "province").orderBy(F.desc("predicted_demand"), "city_code").limit(limit)


def heatmap(forecast: DataFrame, dates: list[str], top: int = 20) -> DataFrame:
    """Cities with the most demand against dates. The dates are given, so no pass is needed to find them."""
    chosen = F.broadcast(top_cities(forecast, top).select("city_code"))  # ``top`` rows
    rows = forecast.join(chosen, "city_code", "left_semi").withColumn("day", F.date_format("checkin", "yyyy-MM-dd"))
    return rows.groupBy("city_code", "city", "province").pivot("day", dates).agg(F.sum("predicted_demand")).fillna(0)


def overview(forecast: DataFrame, momentum: DataFrame) -> DataFrame:
    """One row of headline figures."""
    daily = totals(forecast, "checkin")
    peak = daily.agg(F.min_by(F.struct("checkin", "predicted_demand"), F.struct(-F.col("predicted_demand"), "checkin")).alias("p"), F.min_by(F.struct("checkin", "predicted_demand"), F.struct("predicted_demand", "checkin")).alias("l"))
    city = totals(forecast, "city_code", "city").agg(F.min_by(F.struct("city", "predicted_demand"), F.struct(-F.col("predicted_demand"), "city_code")).alias("c"))
    head = forecast.agg(*(F.sum(c).alias(f"total_{c}") for c in SUMS), F.countDistinct("city_code").alias("cities"), F.countDistinct("checkin").alias("dates"))
    hot = momentum_leaders(momentum, 1).select(F.col("city_code").alias("fastest_city"), F.col("pickup_ratio").alias("fastest_ratio"))
    parts = head.crossJoin(peak).crossJoin(city).join(hot, F.lit(True), "left")  # one row each
    return parts.select(*(f"total_{c}" for c in SUMS), "cities", "dates", F.col("p.checkin").alias("peak_date"), F.col("p.predicted_demand").alias("peak_demand"), F.col("l.checkin").alias("low_date"), F.col("l.predicted_demand").alias("low_demand"), F.col("c.city").alias("top_city"), F.col("c.predicted_demand").alias("top_city_demand"), "fastest_city", "fastest_ratio")


def decision_queue(forecast: DataFrame, momentum: DataFrame) -> DataFrame:
    """Cities in order of forecast demand, with the evidence beside it."""
    rows = share_of(totals(forecast, "city_code", "city", "province"), "predicted_demand", "forecast_share")
    peaks = forecast.groupBy("city_code").agg(F.min_by("checkin", F.struct(-F.col("predicted_demand"), "checkin")).alias("peak_checkin"))
    rows = rows.join(peaks, "city_code").join(momentum.select("city_code", "pickup_ratio"), "city_code", "left")
    seen = F.when(F.col("predicted_demand") > 0, F.col("observed_so_far") / F.col("predicted_demand")).otherwise(0.0)
    status = F.when(F.col("observed_so_far") == 0, "no searches seen: manual review").otherwise("forecast from history: analyst review")
    return rows.withColumns({"observed_share": seen, "evidence_status": status})


def pickup_chart(log: Log, forecast: DataFrame) -> DataFrame:
    """Demand seen at each lead time against what curve and forecast make of it."""
    curve = all_curves(log).filter("level = 'global'").select("days_to_checkin", "completion_fraction")
    seen = target_pickup(log).groupBy("days_to_checkin").agg(F.sum("searches").alias("searches"))
    total = F.broadcast(forecast.agg(F.sum("predicted_demand").alias("_total")))
    rows = curve.join(seen, "days_to_checkin", "left").crossJoin(total)
    return rows.select("days_to_checkin", F.coalesce("searches", F.lit(0).cast("long")).alias("searches"), (F.col("completion_fraction") * F.col("_total")).alias("expected_cumulative"))


def resolve(cities: DataFrame, text: str) -> DataFrame:
    """The city of a code or, where no code fits, of a name in any case."""
    text = text.strip()
    rows = cities.withColumn("_how", F.when(F.col("city_code").cast("string") == text, 0).when(F.lower("city") == text.lower(), 1))
    return rows.filter("_how IS NOT NULL").orderBy("_how", "city_code").limit(1).drop("_how")


def report(df: DataFrame, city: str | None = None, province: str | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """A mart cut by city (name in any case, or code), province and dates; the count says what a limit hides."""
    if city is not None:
        text = city.strip()
        df = df.filter((F.lower(F.trim("city")) == text.lower()) | (F.col("city_code").cast("string") == text))
    if province is not None:
        df = df.filter(F.lower(F.trim("province")) == province.strip().lower())
    if start is not None:
        df = df.filter(F.col("checkin") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("checkin") <= F.lit(end))
    return df if limit is None else df.limit(limit)


def peaks_of_city(forecast: DataFrame, top: int = 5) -> DataFrame:
    order = Window.partitionBy("city_code").orderBy(F.desc("predicted_demand"), "checkin")
    return forecast.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def finite(df: DataFrame) -> DataFrame:
    """Doubles that are NaN or infinite become null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({f.name: F.when(~bad(F.col(f.name)), F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")})


def period_study(rows: DataFrame, clock: str, periods: dict[str, Column]) -> DataFrame:
    """Mean demand a day in each period by one of the clocks, and against the same weekdays outside of it."""
    daily = rows.groupBy(F.col(clock).alias("day")).agg(F.sum("search_count").alias("n"))
    label = F.coalesce(*(F.when(cond, name) for name, cond in periods.items()), F.lit("other"))
    daily = daily.withColumn("period", label)
    usual = daily.filter("period = 'other'").groupBy(F.weekday("day").alias("weekday")).agg(F.avg("n").alias("usual"))
    joined = daily.withColumn("weekday", F.weekday("day")).join(F.broadcast(usual), "weekday", "left")  # seven rows
    return joined.groupBy(F.lit(clock).alias("clock"), "period").agg(F.count(F.lit(1)).alias("days"), F.avg("n").alias("mean"), (F.sum("n") / F.sum("usual")).alias("weekday_adjusted_ratio"))


def jalali_year_study(rows: DataFrame, clock: str, periods: dict[str, Column]) -> DataFrame:
    """Demand of each period by one of the clocks against that of the same Jalali days a year before.

    Days without events count neither way; a day before that has none adds nothing below, and a period of
    which no day has one has no ratio. A row a day is joined, however many events there are.
    """
    daily = rows.groupBy(F.col(clock).alias("day")).agg(F.sum("search_count").alias("n"))
    label = F.coalesce(*(F.when(cond, name) for name, cond in periods.items()), F.lit("other"))
    before = daily.select(F.col("day").alias("_day"), F.col("n").alias("_before"))
    joined = daily.select("n", label.alias("period"), prior_jalali("day").alias("_day")).join(before, "_day", "left")
    ratio = F.try_divide(F.sum("n").cast("double"), F.sum("_before"))
    return joined.groupBy(F.lit(clock).alias("clock"), "period").agg(F.count(F.lit(1)).alias("days"), F.count("_before").alias("days_before"), ratio.alias("jalali_year_ratio"))
