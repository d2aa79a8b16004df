"""Completion curves, priors for pairs without demand yet, and the pickup forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtide.config import Config
from leadtide.operators.asof import forecast_grid, sums_from
from leadtide.sources.tables import Log


FOLD = "fold_cutoff"


def city_leads(log: Log) -> DataFrame:
    """Demand of the past by fold, city and lead time, with provinces: what all curves are made of."""
    return log.leads.join(log.cities.select("city_code", "province_code"), "city_code", "left")


def curve_sums(leads: DataFrame, key: str | None, least_support: int, cfg: Config) -> DataFrame:
    """fold_cutoff, key, support, cum: a group's demand and its part from each lead time on, a row a group.
    Groups with less demand than ``least_support`` have none."""
    slots = cfg.max_lead + 1
    keyed = leads.withColumn("key", F.col(key).cast("int") if key else F.lit(-1)).filter("key IS NOT NULL")
    by_lead = keyed.groupBy(FOLD, "key", "days_to_checkin").agg(F.sum("search_count").alias("_n"))
    held = F.when(F.col("days_to_checkin").between(0, slots - 1), F.struct("days_to_checkin", "_n"))
    groups = by_lead.groupBy(FOLD, "key").agg(F.map_from_entries(F.collect_list(held)).alias("_m"), F.sum("_n").alias("support"))
    return groups.filter((F.col("support") >= least_support) & (F.col("support") > 0)).select(FOLD, "key", "support", sums_from("_m", slots).alias("cum"))


def curves(leads: DataFrame, key: str | None, least_support: int, cfg: Config) -> DataFrame:
    """fold_cutoff, key, days_to_checkin, completion_fraction, support: the share of a group's demand that
    has come in so many days ahead."""
    sums = curve_sums(leads, key, least_support, cfg)
    steps = sums.select(FOLD, "key", "support", F.posexplode(F.slice("cum", 1, cfg.max_lead + 1)).alias("days_to_checkin", "n"))
    return steps.select(FOLD, "key", "days_to_checkin", (F.col("n") / F.col("support")).alias("completion_fraction"), "support")


def all_curves(log: Log) -> DataFrame:
    """level, key, days_to_checkin, completion_fraction, support for the world, provinces and cities."""
    cfg, leads = log.cfg, city_leads(log)
    levels = (("global", None, 0), ("province", "province_code", cfg.min_province_support), ("city", "city_code", cfg.min_city_support))
    made = [curves(leads, key, least, cfg).select(F.lit(level).alias("level"), "*") for level, key, least in levels]
    return made[0].unionByName(made[1]).unionByName(made[2])


def with_fraction(rows: DataFrame, log: Log, horizon: Column | None = None, name: str = "completion_fraction", source: str | None = "curve_source") -> DataFrame:
    """Adds the completion fraction of (fold_cutoff, city_code, province_code, horizon): of the city's
    curve, else its province's, else that of all; horizons beyond the curve take its last step; between
    min_fraction and 1. A curve is one row, so every level is a left join on its key and a lookup."""
    cfg, leads = log.cfg, city_leads(log)
    step = F.least(F.greatest(horizon if horizon is not None else F.col("horizon"), F.lit(0)), F.lit(cfg.max_lead)) + 1
    part = lambda key, least, to: curve_sums(leads, key, least, cfg).select(FOLD, F.col("key").alias(key or "_key"), F.transform("cum", lambda x: x / F.col("support")).alias(to))
    city = part("city_code", cfg.min_city_support, "_c")
    province = part("province_code", cfg.min_province_support, "_p")
    world = F.broadcast(part(None, 0, "_g").drop("_key"))  # one row for each fold
    out = rows.join(city, [FOLD, "city_code"], "left").join(province, [FOLD, "province_code"], "left").join(world, FOLD, "left")
    at = lambda x: F.element_at(x, step)
    columns = {name: F.greatest(F.least(F.coalesce(at("_c"), at("_p"), at("_g")), F.lit(1.0)), F.lit(cfg.min_fraction))}
    if source:
        columns[source] = F.when(F.col("_c").isNotNull(), "city").when(F.col("_p").isNotNull(), "province").otherwise("global")
    return out.withColumns(columns).drop("_c", "_p", "_g")


def city_curves(log: Log) -> DataFrame:
    """fold_cutoff, city_code, _curve: for every city of the dimension the shares of its curve by days ahead, else those of
    its province's curve, else of all."""
    cfg, leads = log.cfg, city_leads(log)
    part = lambda key, least, to: curve_sums(leads, key, least, cfg).select(FOLD, F.col("key").alias(key or "_key"), F.transform("cum", lambda x: x / F.col("support")).alias(to))
    cities = log.cities.select("city_code", "province_code").withColumn(FOLD, F.explode(log.cutoffs))
    # Few provinces a fold; else the cities' arrays would be dealt by them.
    province = F.broadcast(part("province_code", cfg.min_province_support, "_p"))
    out = cities.join(part("city_code", cfg.min_city_support, "_c"), [FOLD, "city_code"], "left").join(province, [FOLD, "province_code"], "left")
    out = out.join(F.broadcast(part(None, 0, "_g").drop("_key")), FOLD, "left")  # one row for each fold
    return out.select(FOLD, "city_code", F.coalesce("_c", "_p", "_g").alias("_curve"))


def demand_prior(log: Log) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Mean demand a day in the window before the cutoff by (city, weekday), city, province and overall.

    Means divide by all dates of the window. Province and overall levels are medians over the cities
    that have any demand in it.
    """
    cfg = log.cfg
    window = log.fold_pairs.groupBy(FOLD).agg(F.min("checkin").alias("_min"))  # one row a fold
    window = F.broadcast(window.select(FOLD, F.greatest(F.date_sub(FOLD, cfg.prior_window_days - 1), "_min").alias("_start")))
    dates = window.select(FOLD, F.explode(F.sequence("_start", FOLD)).alias("_day"))
    weekdays = F.broadcast(dates.groupBy(FOLD, F.weekday("_day").alias("weekday")).agg(F.count(F.lit(1)).alias("_days")))
    span = F.broadcast(window.select(FOLD, (F.datediff(FOLD, "_start") + 1).alias("_days")))
    recent = log.fold_pairs.filter(F.col("checkin") > F.date_sub(FOLD, cfg.prior_window_days))
    pairs = recent.groupBy(FOLD, "city_code", F.weekday("checkin").alias("weekday")).agg(F.sum("final").alias("_n"))
    by_weekday = pairs.join(weekdays, [FOLD, "weekday"]).select(FOLD, "city_code", "weekday", (F.col("_n") / F.col("_days")).alias("mean"))
    by_city = pairs.groupBy(FOLD, "city_code").agg(F.sum("_n").alias("_n")).join(span, FOLD).select(FOLD, "city_code", (F.col("_n") / F.col("_days")).alias("mean"))
    known = by_city.join(log.cities.select("city_code", "province_code"), "city_code", "left")
    by_province = known.filter("province_code IS NOT NULL").groupBy(FOLD, "province_code").agg(F.percentile("mean", F.lit(0.5)).alias("mean"))
    return by_weekday, by_city, by_province, by_city.groupBy(FOLD).agg(F.percentile("mean", F.lit(0.5)).alias("mean"))


def with_demand_prior(rows: DataFrame, log: Log, name: str = "city_weekday_mean") -> DataFrame:
    """Adds the prior of (fold_cutoff, city_code, province_code, checkin): the first level that is known."""
    by_weekday, by_city, by_province, overall = (x.withColumnRenamed("mean", to) for x, to in zip(demand_prior(log), ("_w", "_c", "_p", "_g"), strict=True))
    out = rows.withColumn("weekday", F.weekday("checkin")).join(by_weekday, [FOLD, "city_code", "weekday"], "left")
    out = out.join(by_city, [FOLD, "city_code"], "left").join(by_province, [FOLD, "province_code"], "left").join(F.broadcast(overall), FOLD, "left")
    return out.withColumn(name, F.greatest(F.coalesce("_w", "_c", "_p", "_g", F.lit(0.0)), F.lit(0.0))).drop("_w", "_c", "_p", "_g", *([] if "weekday" in rows.columns else ["weekday"]))


def zero_sums(log: Log, levels: tuple[str, ...] = ("city", "province", "global")) -> DataFrame:
    """fold_cutoff, level, key, means: a row a group with an array over the horizons.

    Pairs without any event count too; how many there are follows from the numbers of cities and
    dates, so no grid is made.
    """
    cfg = log.cfg
    bucket = F.least(F.greatest(F.col("lead") + (0 if cfg.strict_zero_prior else 1), F.lit(0)), F.lit(cfg.target_days))
    counted = log.fold_pairs.filter("final > 0").groupBy(FOLD, "city_code", bucket.alias("bucket")).agg(F.sum("final").alias("total"), F.count(F.lit(1)).alias("n"))
    dates = F.broadcast(log.fold_pairs.groupBy(FOLD).agg((F.datediff(FOLD, F.min("checkin")) + 1).alias("_dates")))  # one row a fold
    cities = log.cities.select("city_code", "province_code")
    keys = {"city": F.col("city_code"), "province": F.col("province_code"), "global": F.lit(-1)}
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("n"))
    out = None
    for level in levels:
        key = keys[level].cast("int").alias("key")
        located = counted if level == "city" else counted.join(cities, "city_code")
        own = located.groupBy(FOLD, key, "bucket").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        own = own.groupBy(FOLD, "key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("total", "n")))).alias("_m"), F.sum("n").alias("_present"))
        members = cities.groupBy(key).agg(F.count(F.lit(1)).alias("_members")).withColumn(FOLD, F.explode(log.cutoffs)).join(dates, FOLD).join(own, [FOLD, "key"], "left")
        silent = F.col("_members") * F.col("_dates") - F.coalesce("_present", F.lit(0))

        def through(acc: Column, h: Column) -> Column:
            """Up to horizon h: sums over buckets up to h - 1."""
            own = F.coalesce(F.try_element_at("_m", h - 1), none)
            t, n = acc["t"] + own["total"], acc["n"] + own["n"]
            return F.struct(t.alias("t"), n.alias("n"), F.concat(acc["v"], F.array(t / F.greatest(n + F.col("_silent"), F.lit(1)))).alias("v"))

        start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("v"))
        made = members.withColumn("_silent", silent).select(FOLD, F.lit(level).alias("level"), "key", F.aggregate(F.sequence(F.lit(1), F.lit(cfg.target_days)), start, through)["v"].alias("means"))
        out = made if out is None else out.unionByName(made)
    return out


def zero_prior(log: Log) -> DataFrame:
    """fold_cutoff, level, key, horizon, expected: the mean final demand of pairs nothing was seen of."""
    steps = zero_sums(log).select(FOLD, "level", "key", F.posexplode("means").alias("_i", "expected"))
    return steps.select(FOLD, "level", "key", (F.col("_i") + 1).alias("horizon"), "expected")


def with_zero_prior(rows: DataFrame, log: Log, name: str = "zero_level") -> DataFrame:
    """Adds the zero prior of (fold_cutoff, city_code, horizon). Every city of the dimension has one of
    its own, so the levels above it are for cities that it does not list; they get 0 here."""
    prior = zero_sums(log, ("city",)).select(FOLD, F.col("key").alias("city_code"), F.col("means").alias("_z"))
    at = F.greatest(F.least(F.col("horizon"), F.lit(log.cfg.target_days)), F.lit(1))
    return rows.join(prior, [FOLD, "city_code"], "left").withColumn(name, F.greatest(F.coalesce(F.element_at("_z", at), F.lit(0.0)), F.lit(0.0))).drop("_z")


def pickup_forecast(log: Log, grid: DataFrame | None = None, zero_policy: str = "prior") -> DataFrame:
    """The grid with completion_fraction, curve_source, projection and predicted_demand.

    Demand seen is divided by the share that should be seen by now; a pair of which nothing is seen
    gets the zero prior (or 0). Never below what is seen.
    """
    if zero_policy not in ("prior", "zero"):
        raise ValueError(f"zero_policy is 'prior' or 'zero', not {zero_policy!r}")
    rows = with_fraction(grid if grid is not None else forecast_grid(log), log)
    rows = rows.withColumn("projection", F.col("observed") / F.col("completion_fraction"))
    rows = with_zero_prior(rows, log) if zero_policy == "prior" else rows.withColumn("zero_level", F.lit(0.0))
    seen = F.greatest(F.col("projection"), F.col("observed").cast("double"))
    return rows.withColumn("predicted_demand", F.greatest(F.when(F.col("observed") > 0, seen).otherwise(F.col("zero_level")), F.lit(0.0))).drop("zero_level")


def panel_forecast(log: Log) -> DataFrame:
    """fold_cutoff, city_code, checkin, horizon, observed, predicted_demand, actual: `pickup_forecast` of the whole panel.

    A city's curve and prior stay one row until its dates are made of it, so only narrow rows are joined and dealt.
    """
    cfg, zero, h = log.cfg, F.lit(0).cast("long"), F.col("horizon")
    prior = zero_sums(log, ("city",)).select(FOLD, F.col("key").alias("city_code"), F.col("means").alias("_means"))
    side = city_curves(log).join(prior, [FOLD, "city_code"], "left").withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(cfg.target_days))))
    fraction = F.greatest(F.least(F.element_at("_curve", F.least(h, F.lit(cfg.max_lead)) + 1), F.lit(1.0)), F.lit(cfg.min_fraction))
    level = F.greatest(F.coalesce(F.element_at("_means", h), F.lit(0.0)), F.lit(0.0))
    narrow = side.select(FOLD, "city_code", F.date_add(FOLD, h).alias("checkin"), "horizon", fraction.alias("_fraction"), level.alias("_level"))
    rows = narrow.join(log.windows, [FOLD, "city_code", "checkin"], "left").withColumns({"observed": F.coalesce("observed", zero), "actual": F.coalesce("actual", zero)})
    seen = F.greatest(F.col("observed") / F.col("_fraction"), F.col("observed").cast("double"))
    told = F.greatest(F.when(F.col("observed") > 0, seen).otherwise(F.col("_level")), F.lit(0.0))
    return rows.select(FOLD, "city_code", "checkin", "horizon", "observed", told.alias("predicted_demand"), "actual")
