"""What served results are checked against and summed up in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.operators.calibration import blend


def daily_difference(raw: DataFrame, calibrated: DataFrame, value: str = "predicted_demand") -> DataFrame:
    """checkin, the day's total of both forecasts, and delta; days that both have."""
    total = lambda df, name: df.groupBy("checkin").agg(F.sum(value).alias(name))
    joined = total(raw, f"{value}_raw").join(total(calibrated, f"{value}_calibrated"), "checkin")
    return joined.withColumn("delta", F.col(f"{value}_calibrated") - F.col(f"{value}_raw"))


def folded_drivers(groups: DataFrame, top: int = 8) -> DataFrame:
    """driver, share, effect, direction: the ``top`` groups by share, all others and any group named "other" as one.

    groups: driver, share, effect; the groups of a model, so few rows.
    """
    first = groups.orderBy(F.desc("share"), "driver").limit(top).filter("driver <> 'other'").select("driver", F.lit(True).alias("_first"))
    named = groups.join(F.broadcast(first), "driver", "left").withColumn("driver", F.when(F.col("_first"), F.col("driver")).otherwise("other"))
    out = named.groupBy("driver").agg(F.sum("share").alias("share"), F.sum("effect").alias("effect"), F.count(F.lit(1)).alias("groups"))
    return out.withColumn("direction", F.when(F.col("effect") > 0, "positive").when(F.col("effect") < 0, "negative").otherwise("neutral"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two outputs that should be one: how many each has that the other lacks, repeats counted."""
    columns = left.columns
    sides = left.select(*columns, F.lit(1).alias("_side")).unionByName(right.select(*columns, F.lit(-1).alias("_side")))
    net = sides.groupBy(*columns).agg(F.sum("_side").alias("_n"))
    some = lambda x: F.coalesce(F.sum(F.greatest(x, F.lit(0))), F.lit(0))
    return net.agg(some(F.col("_n")).alias("only_left"), some(-F.col("_n")).alias("only_right"))


def ensemble_bounds(frame: DataFrame, bounds: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """The frame with lower and upper of an ensemble: members' bounds by weight, of those that a row has.

    bounds: keys and for every member {member}_lower and {member}_upper.
    """
    for side in ("lower", "upper"):
        bounds = blend(bounds, {f"{m}_{side}": w for m, w in weights.items()}, side)
    return frame.join(bounds.select(*keys, "lower", "upper"), keys, "left")


def constrained(df: DataFrame, columns: list[str], whole: bool = False) -> DataFrame:
    """Forecasts fit to be served: nulls, NaN and infinities are 0, none is below 0, whole numbers if wanted."""

    def fit(c: str):
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        x = F.when(bad, F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))
        return F.round(x).cast("long") if whole else x

    return df.withColumns({c: fit(c) for c in columns})


def limited(df: DataFrame, order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """A report of at most ``limit`` rows, and one row that says how many there are and whether any was left out."""
    count = df.agg(F.count(F.lit(1)).alias("count"))
    return df.orderBy(*order).limit(limit), count.withColumn("truncated", F.col("count") > limit)
