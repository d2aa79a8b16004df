"""Forecasts fitted on virtual cities, their output and its checks, and what pooling gains over cities."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions.metrics import score
from leadtide.operators.asof import fold_frame
from leadtide.operators.clusters import cluster_names, cluster_table, pooled_panel
from leadtide.operators.curves import FOLD, panel_forecast
from leadtide.operators.features import CLUSTER, inference_frame, training_frame, with_clusters
from leadtide.sources.shared import drop, written
from leadtide.sources.tables import Log

GRID = ["cluster_code", "checkin"]


class PooledLog(Log):
    """The log of virtual cities at the cutoffs of a log of cities.

    Its two groupings are sums over those of the cities, so the events aren't scanned again for curves,
    priors and grids. mapping: city_code, cluster_code; cities: as of `virtual_cities`.
    """

    def __init__(self, log: Log, mapping: DataFrame, cities: DataFrame) -> None:
        self.spark, self.cfg, self.folds = log.spark, log.cfg, log.folds
        self.of, self.mapping, self.cities = log, mapping, cities
        self.all = self._keyed(log.all)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.mapping, "city_code").withColumn("city_code", F.col("cluster_code")).drop("cluster_code")

    @cached_property
    def pairs(self) -> DataFrame:
        return written(self._keyed(self.of.pairs).groupBy("city_code", "checkin").agg(F.sum("final").alias("final"), F.max("lead").alias("lead")))

    @cached_property
    def sums(self) -> DataFrame:
        return written(self._keyed(self.of.sums).groupBy("fold_cutoff", "city_code", "past", "step").agg(F.sum("total").alias("total"), F.sum("known").alias("known")))


def virtual_cities(profiles: DataFrame, mapping: DataFrame, cities: DataFrame) -> DataFrame:
    """Clusters as cities: city_code, province_code, lat, long, city (the name), province, and their shape."""
    table = cluster_table(profiles, mapping).join(cluster_names(profiles, mapping, cities), "cluster_code")
    # A cluster has the code of its smallest member, so that city's province is its province.
    place = cities.select(F.col("city_code").alias("cluster_code"), "province")
    return table.join(place, "cluster_code", "left").withColumnsRenamed({"cluster_code": "city_code", "name": "city"})


def pooled_forecast(log: Log, mapping: DataFrame, profiles: DataFrame) -> DataFrame:
    """fold_cutoff, cluster_code, checkin, horizon, observed, predicted_demand, actual: curves and priors of the pooled log,
    never below what is seen, beside what its check-ins came to."""
    pooled = PooledLog(log, mapping, provinces_of(mapping, profiles))
    return panel_forecast(pooled).withColumnRenamed("city_code", "cluster_code")


def provinces_of(mapping: DataFrame, profiles: DataFrame) -> DataFrame:
    """city_code (a cluster's), province_code: what a pooled forecast needs to know of virtual cities."""
    rows = profiles.select("city_code", "province_code").join(mapping, "city_code")
    return rows.groupBy(F.col("cluster_code").alias("city_code")).agg(F.min_by("province_code", rows["city_code"]).alias("province_code"))


def fit_panel(log: Log, mapping: DataFrame, profiles: DataFrame, spec: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The columns of `pooled_forecast`, predicted by a spec of `model_backtest` that learns from the pooled log.

    The spec's frames hold the cluster block, so it may name those features too.
    """
    places = written(virtual_cities(profiles, mapping, log.cities))
    pooled, shape = PooledLog(log, mapping, places), places.withColumnRenamed("city_code", "cluster_code")
    ahead = written(with_clusters(inference_frame(pooled), shape))
    if hasattr(spec, "from_logs"):
        told = spec.from_logs([pooled], ahead, places.select("city_code", *CLUSTER))
    else:
        told = spec(written(with_clusters(training_frame(pooled), shape)), ahead)
    told = told.select("city_code", "checkin", F.col("prediction").cast("double").alias("_p"))
    rows = fold_frame(pooled).join(told, ["city_code", "checkin"])
    floor = F.greatest("_p", F.col("observed").cast("double"))
    return rows.select(F.col("city_code").alias("cluster_code"), "checkin", "horizon", "observed", floor.alias("predicted_demand"), "actual")


def output_rows(pooled: DataFrame, places: DataFrame) -> DataFrame:
    """The pooled forecast as it is handed out: with names, provinces and the number of cities."""
    about = places.select(F.col("city_code").alias("cluster_code"), F.col("city").alias("name"), "province", "n_cities_in_cluster")
    return pooled.join(about, "cluster_code", "left").select(*GRID, "name", "province", "n_cities_in_cluster", "observed", "predicted_demand")


def output_checks(output: DataFrame, city: DataFrame, mapping: DataFrame) -> DataFrame:
    """rule, count: how often the output breaks its contract; all counts are 0 for a right one.

    Of each virtual city every date of the city panel is there once, what is seen is the sum of its cities'.
    """
    want = pooled_panel(city, mapping, ("observed",)).withColumnRenamed("observed", "_seen")
    own = output.groupBy(*GRID).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("observed").alias("observed"),
        F.count_if(F.col("predicted_demand").isNull() | F.isnan("predicted_demand") | (F.abs("predicted_demand") == float("inf"))).alias("_odd"),
        F.count_if(F.col("predicted_demand") < F.col("observed")).alias("_low"),
        F.count_if(F.col("name").isNull()).alias("_unnamed"),
    )
    rows = want.join(own, GRID, "full")
    rules: dict[str, Column] = {
        "missing_pair": F.count_if(F.col("_n").isNull()),
        "unknown_pair": F.count_if(F.col("_seen").isNull()),
        "duplicate_pair": F.count_if(F.col("_n") > 1),
        "not_finite": F.coalesce(F.sum("_odd"), F.lit(0)),
        "below_observed": F.coalesce(F.sum("_low"), F.lit(0)),
        "without_name": F.coalesce(F.sum("_unnamed"), F.lit(0)),
        "observed_not_conserved": F.count_if(F.col("observed") != F.col("_seen")),
    }
    found = rows.agg(*(c.cast("long").alias(name) for name, c in rules.items()))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("count")) for n in rules))).alias("x")).select("x.*")


def pooling_errors(city: DataFrame, pooled: DataFrame, profiles: DataFrame, mapping: DataFrame, shrinkages: tuple[float, ...]) -> DataFrame:
    """A row for each fold and shrinkage: clusters, actual, and the absolute errors of four forecasts.

    On the grid of cities `single` (their own forecasts) and `blended` (drawn to their cluster's); on that of
    clusters `control` (city forecasts summed) and `pooled` (fitted on the clusters). `conserved` says whether
    the demand is the same on both grids. All frames but the mapping have fold_cutoff. Every cell of a cluster meets its cities
    once, and all shrinkages are summed side by side.
    """
    own, cell = Window.partitionBy(FOLD, "cluster_code"), [FOLD, *GRID]
    total, n = F.sum("volume").over(own), F.count(F.lit(1)).over(own)
    weights = profiles.select(FOLD, "city_code", "volume").join(mapping, "city_code").withColumns({"_share": F.when(total > 0, F.col("volume") / total).otherwise(1 / n), "_n": n})
    part = pooled.select(*cell, F.col("actual").alias("_actual"), F.col("predicted_demand").alias("_pooled"), (F.col("predicted_demand") - F.col("observed")).alias("_pool"))
    rows = city.drop("horizon").join(weights, [FOLD, "city_code"]).join(part, cell, "left")
    away = lambda a, x: F.sum(F.abs(F.col(a) - x))
    mixed = {i: F.greatest(mix(least), F.col("observed").cast("double")) for i, least in enumerate(shrinkages)}
    by_cell = rows.groupBy(*cell).agg(F.sum("actual").alias("actual"), F.sum("predicted_demand").alias("_control"), away("actual", F.col("predicted_demand")).alias("single"), *(away("actual", x).alias(f"_blended_{i}") for i, x in mixed.items()))
    both = part.join(by_cell, cell, "full")
    # By cluster first, so clusters are counted without a distinct.
    sums = both.groupBy(FOLD, "cluster_code").agg(
        F.sum("actual").alias("actual"), F.sum("single").alias("single"), F.sum("_actual").alias("_actual"), away("_actual", F.col("_control")).alias("control"),
        away("_actual", F.col("_pooled")).alias("pooled"), *(F.sum(f"_blended_{i}").alias(f"_blended_{i}") for i in mixed),
    )
    names = ("actual", "single", "_actual", "control", "pooled", *(f"_blended_{i}" for i in mixed))
    out = sums.groupBy(FOLD).agg(F.count("_actual").alias("clusters"), *(F.sum(c).alias(c) for c in names))
    out = out.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(float(s)).alias("shrinkage"), F.col(f"_blended_{i}").alias("blended")) for i, s in enumerate(shrinkages)))))
    return out.select(FOLD, "_s.shrinkage", "actual", "single", "_s.blended", "clusters", "control", "pooled", (F.col("actual") == F.col("_actual")).alias("conserved"))


def mix(least: float) -> Column:
    """A city's forecast drawn to its share of the cluster's remaining demand, of columns as `pooling_errors` has them."""
    own = F.when((F.col("_n") <= 1) | F.lit(least <= 0), 1.0).otherwise(F.col("volume") / (F.col("volume") + float(least)))
    return F.col("observed") + own * (F.col("predicted_demand") - F.col("observed")) + (1 - own) * F.coalesce(F.col("_share") * F.col("_pool"), F.lit(0.0))


def sweep(logs: list[Log], levels: dict[int, Callable[[Log, DataFrame], DataFrame]], shrinkages: tuple[float, ...], profiles_of: Callable[[Log], DataFrame]) -> DataFrame:
    """fold_cutoff, level and the columns of `pooling_errors` over cutoffs, levels of merging and shrinkages.

    logs: of one cutoff or more each, parts of one log (`FoldLog`) where mappings differ by cutoff. levels: by number a function from
    a log and its profiles (with fold_cutoff) to its mapping. A log's profiles and city forecasts and each level's mapping,
    forecast and errors are written once and dropped when they were read, so a plan is that of one level; profiles and
    clusters are those of a cutoff's own past.
    """
    found = []
    for log in logs:
        profiles = written(profiles_of(log))
        city = written(panel_forecast(log))
        for level, merge in levels.items():
            mapping = written(merge(log, profiles))
            pooled = PooledLog(log, mapping, written(provinces_of(mapping, profiles)))
            told = written(panel_forecast(pooled).withColumnRenamed("city_code", "cluster_code"))
            rows = pooling_errors(city, told, profiles, mapping, shrinkages)
            found.append(written(rows.select(F.col(FOLD).cast("string").alias(FOLD), F.lit(level).alias("level"), *rows.columns[1:])))
            for table in (mapping, pooled.cities, pooled.pairs, pooled.sums, told):
                drop(table)
        for table in (profiles, city):
            drop(table)
    return reduce(DataFrame.unionByName, found)


def sweep_gains(errors: DataFrame) -> DataFrame:
    """WAPEs instead of errors, and the pooled forecast's gain over the cities' own: what is arithmetic, as
    errors of cities cancel (mechanical), and what the fit adds (modelling)."""
    part = {c: F.try_divide(F.col(c), F.col("actual")) for c in ("single", "blended", "control", "pooled")}
    gap = lambda a, b: F.round(part[a] - part[b], 9) + F.lit(0.0)  # noqa: E731  no negative zero
    return errors.select(
        "fold_cutoff", "level", "shrinkage", "clusters", "conserved", *(x.alias(f"{c}_wape") for c, x in part.items()),
        gap("single", "control").alias("mechanical"), gap("control", "pooled").alias("modelling"),
    )


def chosen_levels(errors: DataFrame, least_gain: float = 0.01) -> DataFrame:
    """level, wape over all cutoffs, chosen: the lowest level within ``least_gain`` of the best one's gain.

    Gains are relative to the lowest level, which stays where the best gains less than ``least_gain`` of it.
    """
    once = errors.groupBy("fold_cutoff", "level").agg(F.first("pooled").alias("e"), F.first("actual").alias("a"))
    levels = once.groupBy("level").agg((F.sum("e") / F.sum("a")).alias("wape"))
    edge = levels.agg(F.min("level").alias("_first"), F.min_by("wape", "level").alias("_base"), F.min("wape").alias("_best"))
    gain = F.col("_base") - F.col("_best")
    near = F.when(gain < least_gain * F.col("_base"), F.col("level") == F.col("_first")).otherwise(F.col("wape") - F.col("_best") <= least_gain * gain)
    rows = levels.crossJoin(F.broadcast(edge)).withColumn("_near", near)  # one row
    pick = F.broadcast(rows.filter("_near").agg(F.min("level").alias("_pick")))
    return rows.crossJoin(pick).select("level", "wape", (F.col("level") == F.col("_pick")).alias("chosen"))


def chosen_shrinkage(errors: DataFrame, level: int) -> DataFrame:
    """shrinkage, wape of the blend over all cutoffs at a level, chosen: the best, the smaller of equals to six digits."""
    rows = errors.filter(F.col("level") == level).groupBy("shrinkage").agg(F.round(F.sum("blended") / F.sum("actual"), 6).alias("wape"))
    pick = F.broadcast(rows.agg(F.min_by("shrinkage", F.struct("wape", "shrinkage")).alias("_pick")))
    return rows.crossJoin(pick).select("shrinkage", "wape", (F.col("shrinkage") == F.col("_pick")).alias("chosen"))


def arm_scores(arms: dict[str, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """arm, scores, rank, conserved: forecasts over one grid of clusters, scored where all arms have rows.

    arms: by name cluster_code, checkin, actual, predicted_demand. `conserved` says whether an arm's whole demand is
    that of the first one; an arm that lost or doubled rows isn't.
    """
    long = reduce(DataFrame.unionByName, (x.select(F.lit(name).alias("arm"), *GRID, "actual", F.col("predicted_demand").cast("double").alias("predicted_demand")) for name, x in arms.items()))
    common = long.groupBy(*GRID).agg(F.count_distinct("arm").alias("_arms")).filter(F.col("_arms") == len(arms)).select(*GRID)
    whole = long.groupBy("arm").agg(F.sum("actual").alias("_whole"), F.count(F.lit(1)).alias("_rows"))
    first = whole.filter(F.col("arm") == next(iter(arms))).select(F.col("_whole").alias("_first"), F.col("_rows").alias("_of"))
    held = whole.crossJoin(F.broadcast(first)).select("arm", ((F.col("_whole") == F.col("_first")) & (F.col("_rows") == F.col("_of"))).alias("conserved"))
    return long.join(common, GRID, "left_semi").groupBy("arm", *by).agg(*score()).join(F.broadcast(held), "arm")  # a row an arm
