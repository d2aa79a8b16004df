"""Generic entity x time panels: complete timelines, fills, lags, rolling statistics, naive forecasts, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions.calendar import phase

# What sums on the way up, by operation.
ADDITIVE_LEVELS = ("forecast", "lower", "upper", "actual", "prediction", "y")
ADDITIVE_HINTS = ("booking", "search", "view", "click", "count", "quantity", "demand", "sales", "revenue", "visit")
KEY = ["entity_id", "ds"]


def collapse(df: DataFrame, keys: list[str], target: str | None, how: str = "sum") -> DataFrame:
    """One row for each key: the target by ``how`` (count counts rows), additive names summed, other numbers
    averaged, texts the least."""
    ops = {"sum": F.sum, "mean": F.avg, "count": lambda c: F.count(F.lit(1)), "first": F.min}
    out = [(F.count(F.lit(1)) if how == "count" else ops[how](target)).alias("y")]
    for f in df.schema.fields:
        if f.name in (*keys, target):
            continue
        number = f.dataType.typeName() in ("integer", "long", "double", "float", "short")
        pick = F.min if not number else F.sum if any(h in f.name.lower() for h in ADDITIVE_HINTS) else F.avg
        out.append(pick(f.name).alias(f.name))
    return df.groupBy(*keys).agg(*out)


def timeline(panel: DataFrame, target: str = "y", fill: float | None = 0) -> DataFrame:
    """Every date of each entity from its first one to the last of all; the target is ``fill`` on new ones."""
    end = F.broadcast(panel.agg(F.max("ds").alias("_end")))  # one row
    own = panel.groupBy("entity_id").agg(F.min("ds").alias("_start")).crossJoin(end)
    dates = own.select("entity_id", F.explode(F.sequence("_start", "_end")).alias("ds"))
    out = dates.join(panel.withColumn("observed", F.lit(True)), KEY, "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    return out if fill is None else out.withColumn(target, F.coalesce(target, F.lit(fill).cast(panel.schema[target].dataType)))


def _past(rows: int | None = None):
    return Window.partitionBy("entity_id").orderBy("ds").rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)


def _ahead():
    return Window.partitionBy("entity_id").orderBy("ds").rowsBetween(0, Window.unboundedFollowing)


def fill_both_ways(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The last known value, before the first one the first."""
    return panel.withColumns({c: F.coalesce(F.last(c, True).over(_past()), F.first(c, True).over(_ahead())) for c in columns})


def interpolate(panel: DataFrame, column: str) -> DataFrame:
    """Linear between known values by rows, constant outside of them.

    Values between two known ones use the later one, which a forecaster would not have yet.
    """
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).cast("double").alias("v")))
    rows = panel.withColumn("_i", F.row_number().over(Window.partitionBy("entity_id").orderBy("ds")))
    rows = rows.withColumns({"_a": F.last(known, True).over(_past()), "_b": F.first(known, True).over(_ahead())})
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_i") - a["i"], b["i"] - a["i"])
    return rows.withColumn(column, F.coalesce(F.col(column).cast("double"), between, a["v"], b["v"])).drop("_i", "_a", "_b")


def lags(panel: DataFrame, column: str, steps: tuple[int, ...]) -> dict[str, Column]:
    order = Window.partitionBy("entity_id").orderBy("ds")
    return {f"{column}_lag_{k}": F.lag(column, k).over(order) for k in steps}


def rolling(column: str, window: int) -> dict[str, Column]:
    """Mean, population spread (null for a single value), least and greatest of the last rows."""
    frame = _past(window)
    n = F.count(column).over(frame)
    return {
        f"{column}_roll_mean_{window}": F.avg(column).over(frame),
        f"{column}_roll_std_{window}": F.when(n > 1, F.stddev_pop(column).over(frame)),
        f"{column}_roll_min_{window}": F.min(column).over(frame),
        f"{column}_roll_max_{window}": F.max(column).over(frame),
    }


def origin_features(panel: DataFrame, steps: tuple[int, ...] = (1, 7, 14, 28), windows: tuple[int, ...] = (7, 28), tiny: float = 1e-6) -> DataFrame:
    """What is known of the target at each date, for forecasts that start there."""
    out = panel.withColumns({**lags(panel, "y", steps), **{k: v for w in windows for k, v in rolling("y", w).items()}})
    short, long = f"y_roll_mean_{windows[0]}", f"y_roll_mean_{windows[-1]}"
    history = F.datediff("ds", F.min("ds").over(Window.partitionBy("entity_id"))) + 1
    return out.withColumns({"y_trend_ratio": F.col(short) / (F.col(long) + tiny), "y_cv": F.col(f"y_roll_std_{windows[0]}") / (F.col(short) + tiny), "entity_history_len": history})


def horizon_rows(entities: DataFrame, origin, longest: int) -> DataFrame:
    """entity_id, origin, horizon, ds for every step from one origin."""
    out = entities.select("entity_id").distinct().withColumns({"origin": F.lit(origin), "horizon": F.explode(F.sequence(F.lit(1), F.lit(longest)))})
    return out.withColumn("ds", F.date_add("origin", F.col("horizon")))


def at_lag(rows: DataFrame, panel: DataFrame, offset: Column, name: str) -> DataFrame:
    """Adds the target ``offset`` days before the row's date, by an equality on the date; null outside."""
    found = panel.select("entity_id", F.col("ds").alias("_at"), F.col("y").cast("double").alias(name))
    return rows.withColumn("_at", F.date_sub("ds", offset.cast("int"))).join(found, ["entity_id", "_at"], "left").drop("_at")


def naive_forecasts(panel: DataFrame, origin, longest: int, season: int = 7, window: int = 28, cycles: int = 8) -> DataFrame:
    """Last value, seasonal naive (older cycles where one is missing, then the mean), moving average,
    mean, and the mean of the same phase, for every entity and step from an origin.

    The history of an entity is one array by age, so every model is a lookup in it.
    """
    past = panel.filter(F.col("ds") <= F.lit(origin))
    age = F.datediff(F.lit(origin), "ds")
    reach = max(window, season * (cycles + -(-longest // season) + 3))
    near = past.filter(age < reach).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct(age, F.col("y").cast("double")))).alias("_m"))
    means = past.groupBy("entity_id").agg(F.avg("y").alias("historical_mean"))
    # Ages are bounded by ``reach``, so an entity's map is too.
    rows = horizon_rows(past, origin, longest).join(near, "entity_id", "left").join(means, "entity_id")
    first = (F.ceil(F.col("horizon") / season) * season - F.col("horizon")).cast("int")
    at = lambda a: F.try_element_at("_m", a)
    phase_values = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cycles - 1)), lambda k: at(first + k * season)), lambda x: x.isNotNull())
    recent = F.filter(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), at), lambda x: x.isNotNull())
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))
    zero = F.lit(0.0)
    return rows.select(
        "entity_id",
        "ds",
        "horizon",
        F.coalesce(at(F.lit(0)), zero).alias("naive"),
        F.coalesce(*(at(first + k * season) for k in range(4)), "historical_mean", zero).alias("seasonal_naive"),
        F.coalesce(mean(recent), zero).alias("moving_average"),
        F.coalesce("historical_mean", zero).alias("historical_mean"),
        F.coalesce(mean(phase_values), zero).alias("seasonal_mean"),
    )


def entity_map(panel: DataFrame, columns: tuple[str, ...] = ("destination_id",)) -> DataFrame:
    """entity_id and its groups; of several the least."""
    return panel.groupBy("entity_id").agg(*(F.min(c).alias(c) for c in columns)).withColumn("market_id", F.lit("all"))


def roll_up(frame: DataFrame, mapping: DataFrame, column: str, keys: tuple[str, ...] = ("ds",)) -> DataFrame:
    """A frame summed to a level (averages where a column doesn't add up, the least horizon)."""
    joined = frame.join(mapping.select("entity_id", column), "entity_id", "left").withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("unknown")))
    out = []
    for f in frame.schema.fields:
        if f.name in ("entity_id", *keys) or f.dataType.typeName() not in ("integer", "long", "double", "float"):
            continue
        out.append((F.min if f.name == "horizon" else F.sum if f.name in ADDITIVE_LEVELS else F.avg)(f.name).alias(f.name))
    return joined.groupBy(*keys, column).agg(*out).withColumnRenamed(column, "entity_id")


def all_levels(frame: DataFrame, mapping: DataFrame, levels: dict[str, str]) -> DataFrame:
    """All levels below each other; ``levels``: name and column of the map, beside "listing" itself."""
    parts = [frame.withColumn("level", F.lit("listing"))]
    parts += [roll_up(frame, mapping, column).withColumn("level", F.lit(name)) for name, column in levels.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coherence(stacked: DataFrame, value: str) -> DataFrame:
    """level and by how many percent its total differs from the listings'."""
    sums = stacked.groupBy("level").agg(F.sum(value).alias("total"))
    base = F.broadcast(sums.filter("level = 'listing'").select(F.col("total").alias("_b")))
    return sums.filter("level <> 'listing'").crossJoin(base).select("level", F.round(F.try_divide(F.col("total") - F.col("_b"), F.col("_b")) * 100, 6).alias("pct_diff"))


def fold_collapse(frame: DataFrame) -> DataFrame:
    """Predictions of overlapping folds: their mean, and the least horizon."""
    return frame.groupBy(*KEY).agg(F.avg("prediction").alias("prediction"), F.avg("actual").alias("actual"), F.min("horizon").alias("horizon"), F.count(F.lit(1)).alias("folds"))


def side_join(main: DataFrame, side: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """main with the columns of a side table that it lacks, at most one row a key; and the match rate.

    Of rows with one key the first by ``order`` counts.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    once = side.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    fresh = [c for c in side.columns if c not in main.columns]
    joined = main.join(once.select(*keys, *fresh, F.lit(True).alias("_hit")), keys, "left")
    rate = joined.agg(F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("matched")).withColumn("match_rate", F.try_divide("matched", "rows"))
    return joined.drop("_hit"), rate


def project_covariate(panel: DataFrame, column: str, dates: DataFrame, kind: str, season: int = 7) -> DataFrame:
    """Future values of a covariate: "event" repeats the last cycle, "price" is the recent level times the
    phase's ratio (0.5 to 2), else the mean of the last 28 rows."""
    last = panel.withColumn("_k", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ds")))).filter("_k <= 28")
    level = last.groupBy("entity_id").agg(F.avg(column).alias("_level"))
    rows = dates.join(level, "entity_id", "left")
    if kind == "mean":
        return rows.withColumn(column, F.col("_level")).drop("_level")
    by_phase = last.withColumn("_p", phase("ds", season)).groupBy("entity_id", "_p").agg(F.max_by(column, "ds").alias("_last"), F.avg(column).alias("_mean"))
    rows = rows.withColumn("_p", phase("ds", season)).join(by_phase, ["entity_id", "_p"], "left")
    ratio = F.least(F.greatest(F.coalesce(F.try_divide(F.col("_mean"), F.col("_level")), F.lit(1.0)), F.lit(0.5)), F.lit(2.0))
    return rows.withColumn(column, F.coalesce("_last", F.lit(0)) if kind == "event" else F.col("_level") * ratio).drop("_level", "_p", "_last", "_mean")


def override(projected: DataFrame, given: DataFrame, column: str) -> DataFrame:
    """Given future values win; rows of ``given`` without an entity hold for all."""
    own = given.filter("entity_id IS NOT NULL").select("entity_id", "ds", F.col(column).alias("_own"))
    market = given.filter("entity_id IS NULL").groupBy("ds").agg(F.max(column).alias("_all"))
    return projected.join(own, KEY, "left").join(market, "ds", "left").withColumn(column, F.coalesce("_own", "_all", column)).drop("_own", "_all")


def sample_rows(df: DataFrame, keys: list[str], limit: int, seed: int = 42) -> DataFrame:
    """A sampling operator: the ``limit`` rows whose keys hash lowest, the same on every run."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(limit)


def segments(frame: DataFrame, by: str, measures: list[Column], least: int = 0) -> DataFrame:
    out = frame.groupBy(F.col(by).cast("string").alias("segment")).agg(*measures, F.count(F.lit(1)).alias("rows"))
    return out.filter(F.col("rows") > least)
