"""Covariates of a panel as a forecaster meets them, and horizons drawn for training."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtide.config import EPS
from leadtide.operators.panel import KEY, rolling


def past_block(panel: DataFrame, column: str, windows: tuple[int, ...] = (7, 28)) -> DataFrame:
    """What is known of a covariate at each date: its last value, its rolling means, and these per unit of demand.

    Windows run over the rows of an entity, so the panel must be complete; missing values don't count.
    """
    demand = {w: rolling("y", w)[f"y_roll_mean_{w}"] for w in windows}
    level = {w: rolling(column, w)[f"{column}_roll_mean_{w}"] for w in windows}
    out = {f"past_{column}_last": F.col(column)} | {f"past_{column}_mean_{w}": level[w] for w in windows}
    return panel.withColumns(out | {f"past_{column}_per_demand_{w}": level[w] / (demand[w] + 1.0) for w in windows})


def future_block(rows: DataFrame, panel: DataFrame, column: str, window: int = 28) -> DataFrame:
    """A covariate known ahead, for rows (entity_id, origin, ds): its value at the date, against the one at
    the origin, and against the mean of the last ``window`` rows there."""
    mean = rolling(column, window)[f"{column}_roll_mean_{window}"]
    known = panel.withColumn("_mean", mean).select("entity_id", "ds", F.col(column).cast("double").alias("_v"), "_mean")
    at_origin = known.select("entity_id", F.col("ds").alias("origin"), F.col("_v").alias("_then"), "_mean")
    out = rows.join(known.select("entity_id", "ds", F.col("_v").alias(f"fut_{column}")), KEY, "left").join(at_origin, ["entity_id", "origin"], "left")
    value = F.col(f"fut_{column}")
    columns = {f"fut_{column}_vs_origin": value / (F.abs("_then") + EPS), f"fut_{column}_vs_recent_avg": value / (F.abs("_mean") + EPS)}
    return out.withColumns(columns).drop("_then", "_mean")


def drawn(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on its parts alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled_horizons(panel: DataFrame, last, longest: int, context: int = 28, draws: int = 3, seed: int = 42) -> DataFrame:
    """entity_id, ds, draw, horizon: horizons drawn for every observed date up to ``last``.

    Log-uniform from 1 to ``longest``, so short ones come most and long ones still come. A draw whose
    origin has less than ``context`` days of history before it isn't made.
    """
    start = panel.groupBy("entity_id").agg(F.min("ds").alias("_start"))
    dates = panel.filter(F.col("observed") & (F.col("ds") <= F.lit(last))).select(*KEY).join(start, "entity_id")
    rows = dates.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = drawn(seed, F.col("entity_id"), F.date_format("ds", "yyyy-MM-dd"), F.col("draw"))
    h = F.least(F.greatest(F.floor(F.exp(u * math.log(longest + 1))), F.lit(1)), F.lit(longest)).cast("int")
    rows = rows.withColumn("horizon", h)
    return rows.filter(F.date_sub("ds", F.col("horizon")) >= F.date_add("_start", context)).drop("_start")
