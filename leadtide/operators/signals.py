"""Anomalies, peaks, censored demand, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions.calendar import phase

#: Scale factors of a normal distribution, and thresholds.
MAD_TO_SIGMA, IQR_TO_SIGMA = 1.4826, 1.349
SEVERITY = ((5.0, "high"), (4.0, "medium"), (3.0, "low"))
FULL = 0.98


def severity(score: Column) -> Column:
    out = F.lit("low")
    for least, label in reversed(SEVERITY):
        out = F.when(F.abs(score) >= least, label).otherwise(out)
    return out


def safe_pct(new: Column, old: Column) -> Column:
    return F.when(F.abs(old) > 1e-9, F.round((new - old) / F.abs(old) * 100, 2))


def robust_scale(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, median, scale, n: the median deviation, where it is 0 the interquartile range, the mean
    deviation, the standard deviation, else 1."""
    first = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("_q"), F.stddev_pop(value).alias("_std"), F.count(value).alias("n"))
    gap = F.abs(F.col(value) - F.col("_q")[0])
    second = df.join(first, by).groupBy(*by).agg(F.percentile(gap, F.lit(0.5)).alias("_mad"), F.avg(gap).alias("_mean"))
    out = first.join(second, by)
    steps = (F.col("_mad") * MAD_TO_SIGMA, (F.col("_q")[2] - F.col("_q")[1]) / IQR_TO_SIGMA, F.col("_mean"), F.col("_std"))
    scale = F.coalesce(*(F.when(x > 1e-9, x) for x in steps), F.lit(1.0))
    return out.select(*by, F.col("_q")[0].alias("median"), scale.alias("scale"), "n")


def residual_anomalies(frame: DataFrame, least_score: float = 3.0, least_rows: int = 21) -> DataFrame:
    """Rows whose residual lies far from its entity's median, by robust scale."""
    rows = frame.withColumn("_r", F.col("actual") - F.col("prediction"))
    stats = robust_scale(rows, "_r", ["entity_id"]).filter(F.col("n") >= least_rows)
    rows = rows.join(stats, "entity_id").withColumn("score", (F.col("_r") - F.col("median")) / F.col("scale"))
    rows = rows.filter(F.abs("score") >= least_score)
    deviation = F.when(F.abs("prediction") > 1e-9, F.col("_r") / F.abs("prediction"))
    return rows.select("entity_id", "ds", "actual", F.col("prediction").alias("expected"), deviation.alias("deviation"), "score", F.when(F.col("score") > 0, "spike").otherwise("drop").alias("type"), severity(F.col("score")).alias("severity"))


def strongest(anomalies: DataFrame, limit: int = 100) -> DataFrame:
    return anomalies.orderBy(F.desc(F.abs("score")), "entity_id", "ds").limit(limit)


def tail(panel: DataFrame, rows: int) -> DataFrame:
    """The last rows of each entity."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("ds"))
    return panel.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= rows).drop("_k")


def forecast_anomalies(forecast: DataFrame, panel: DataFrame, season: int = 7, least_score: float = 3.0, least_rows: int = 21) -> DataFrame:
    """Forecasts far from the median of an entity's last eight cycles."""
    recent = tail(panel, season * 8)
    level = recent.groupBy("entity_id").agg(F.percentile("y", F.lit(0.5)).alias("expected"))
    spread = recent.join(level, "entity_id").groupBy("entity_id").agg(F.percentile(F.abs(F.col("y") - F.col("expected")), F.lit(0.5)).alias("_mad"))
    n = panel.groupBy("entity_id").agg(F.count("y").alias("_n")).filter(F.col("_n") >= least_rows)
    rows = forecast.join(level.join(spread, "entity_id").join(n, "entity_id"), "entity_id")
    sigma = F.col("_mad") * MAD_TO_SIGMA
    scale = F.when(sigma < 1e-9, F.greatest(F.col("expected") * 0.25, F.lit(1.0))).otherwise(sigma)
    rows = rows.withColumn("score", (F.col("forecast") - F.col("expected")) / scale).filter(F.abs("score") >= least_score)
    return rows.select("entity_id", "ds", "forecast", "expected", F.when(F.abs("expected") > 1e-9, (F.col("forecast") - F.col("expected")) / F.abs("expected")).alias("deviation"), "score", F.when(F.col("score") > 0, "spike").otherwise("drop").alias("type"), severity(F.col("score")).alias("severity"))


def phase_baseline(panel: DataFrame, season: int = 7, cycles: int = 8) -> DataFrame:
    """entity_id, phase, level: medians of the last cycles."""
    return tail(panel, season * cycles).groupBy("entity_id", phase("ds", season).alias("phase")).agg(F.percentile("y", F.lit(0.5)).alias("level"))


def peak_runs(forecast: DataFrame, panel: DataFrame, season: int = 7, least_length: int = 2, threshold: float = 0.15, low_quantile: float = 0.25, low_fraction: float = 0.05) -> DataFrame:
    """Runs of rows that lie above (peak) or below (trough) their phase's level.

    Runs are islands of rows that follow each other in order of date. Entities with a level below the
    floor of all levels have no runs.
    """
    base = phase_baseline(panel, season)
    overall = base.groupBy("entity_id").agg(F.percentile("level", F.lit(0.5)).alias("_overall"))
    floor = F.broadcast(base.filter("level > 0").agg(F.percentile("level", F.array(F.lit(low_quantile), F.lit(0.5))).alias("_f")))
    rows = forecast.withColumn("phase", phase("ds", season)).join(base, ["entity_id", "phase"], "left").join(overall, "entity_id").crossJoin(floor)
    least = F.greatest(F.coalesce(F.col("_f")[0], F.lit(0.0)), F.coalesce(F.col("_f")[1] * low_fraction, F.lit(0.0)))
    rows = rows.filter((F.col("_overall") > 0) & (F.col("_overall") >= least))
    rows = rows.withColumn("level", F.when(F.col("level") > 0, F.col("level")).otherwise(F.col("_overall")))
    rows = rows.withColumn("relative", (F.col("forecast") - F.col("level")) / F.col("level"))
    rows = rows.withColumn("direction", F.when(F.col("relative") > threshold, 1).when(F.col("relative") < -threshold, -1).otherwise(0))
    order = Window.partitionBy("entity_id").orderBy("ds")
    changed = (F.coalesce(F.lag("direction").over(order), F.lit(9)) != F.col("direction")).cast("int")
    rows = rows.withColumn("_c", changed).withColumn("island", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.filter("direction <> 0").groupBy("entity_id", "island").agg(
        F.first("direction").alias("_d"), F.min("ds").alias("start"), F.max("ds").alias("end"), F.count(F.lit(1)).alias("days"), (F.avg("relative") * 100).alias("expected_change_pct"), F.avg("level").alias("baseline_level"), F.avg("forecast").alias("forecast_level"), F.sum("forecast").alias("total_forecast")
    )
    sure = (F.col("days") >= 3).cast("int") + (F.abs("expected_change_pct") >= 25).cast("int")
    return out.filter(F.col("days") >= least_length).select("entity_id", F.when(F.col("_d") > 0, "peak").otherwise("trough").alias("type"), "start", "end", "days", "expected_change_pct", "baseline_level", "forecast_level", "total_forecast", F.when(sure == 2, "medium").otherwise("low").alias("confidence"))


def censored(panel: DataFrame, ratio: float = FULL) -> DataFrame:
    """Adds is_censored: sold out, or nearly; rows without a capacity are not."""
    full = (F.col("capacity") > 0) & F.col("y").isNotNull() & (F.col("y") >= F.col("capacity") * ratio)
    return panel.withColumn("is_censored", F.coalesce(full, F.lit(False)))


def censoring_by_entity(marked: DataFrame) -> DataFrame:
    return marked.groupBy("entity_id").agg(F.avg(F.col("is_censored").cast("double")).alias("share"), F.count_if("is_censored").alias("periods"), F.count(F.lit(1)).alias("observations"))


def unconstrained(marked: DataFrame, season: int = 7) -> DataFrame:
    """Adds estimate: for sold-out rows the median of the entity's other rows in the phase, else of all its
    other rows, if above what was seen."""
    rows = marked.withColumn("phase", phase("ds", season))
    free = rows.filter(~F.col("is_censored"))
    by_phase = free.groupBy("entity_id", "phase").agg(F.percentile("y", F.lit(0.5)).alias("_p"))
    by_entity = free.groupBy("entity_id").agg(F.percentile("y", F.lit(0.5)).alias("_e"))
    rows = rows.join(by_phase, ["entity_id", "phase"], "left").join(by_entity, "entity_id", "left")
    y = F.col("y").cast("double")
    return rows.withColumn("estimate", F.when(F.col("is_censored"), F.greatest(y, F.coalesce("_p", "_e", y))).otherwise(y)).drop("_p", "_e", "phase")


def capacity_constrained(forecast: DataFrame, capacity: DataFrame, ratio: float = FULL) -> DataFrame:
    rows = forecast.join(capacity, ["entity_id", "ds"], "left")
    return rows.withColumn("capacity_constrained", F.coalesce((F.col("capacity") > 0) & (F.col("forecast") >= F.col("capacity") * ratio), F.lit(False)))


def entity_view(forecast: DataFrame, panel: DataFrame, horizon: int) -> DataFrame:
    """Forecast totals against the same number of days before, and a status of 10 percent."""
    ahead = forecast.groupBy("entity_id").agg(F.sum("forecast").alias("forecast_total"), F.avg("forecast").alias("forecast_mean"), F.sum("lower").alias("lower_total"), F.sum("upper").alias("upper_total"), F.count("ds").alias("periods"))
    end = F.broadcast(panel.agg(F.max("ds").alias("_end")))
    recent = panel.crossJoin(end).filter(F.col("ds") >= F.date_sub("_end", horizon - 1)).groupBy("entity_id").agg(F.sum("y").cast("double").alias("recent_total"))
    out = ahead.join(recent, "entity_id", "left")
    change = safe_pct(F.col("forecast_total"), F.col("recent_total"))
    width = F.when(F.col("forecast_total") > 0, (F.col("upper_total") - F.col("lower_total")) / F.col("forecast_total"))
    status = F.when(change >= 10, "growing").when(change <= -10, "declining").when(change.isNull(), "unknown").otherwise("stable")
    return out.withColumns({"change_pct": change, "relative_interval_width": width, "status": status})


def extremes(view: DataFrame) -> DataFrame:
    """One row: who grows and falls most, and who is most and least certain."""
    grow = view.filter("change_pct IS NOT NULL")
    pick = lambda df, by, name: df.agg(F.min_by("entity_id", F.struct(by, F.col("entity_id"))).alias(name))
    parts = [pick(grow, -F.col("change_pct"), "fastest_growing"), pick(grow, F.col("change_pct"), "fastest_declining"), pick(view, -F.col("relative_interval_width"), "highest_uncertainty"), pick(view, F.col("relative_interval_width"), "lowest_uncertainty")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
