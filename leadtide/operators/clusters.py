"""Virtual cities: profiles, Ward clusters within provinces, pooled panels and what they gain."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions.calendar import WEEKEND
from leadtide.operators.features import completed_history
from leadtide.operators.order import quantiles as exact_quantiles
from leadtide.sources.shared import drop, written
from leadtide.sources.tables import Log

TINY = 1e-6
# The blocks of the profile that are weighed alike.
BLOCKS = {
    "volume": ("log_volume",),
    "spread": ("volatility", "p75_over_mean", "p90_over_mean", "zero_day_share"),
    "week": tuple(f"weekday_share_{d}" for d in range(7)),
    "weekend": ("weekend_ratio",),
    "geography": ("lat", "long"),
}


def city_profiles(log: Log) -> DataFrame:
    """Volume, spread, weekly shape and place of each city from its completed days."""
    rows = completed_history(log, log.cfg.history_days)
    d = F.weekday("checkin")
    mean = F.avg("n")
    out = rows.groupBy("city_code").agg(
        F.sum("n").alias("volume"),
        mean.alias("mean"),
        F.stddev_pop("n").alias("std"),
        F.percentile("n", F.array(F.lit(0.75), F.lit(0.9))).alias("_q"),
        F.avg((F.col("n") <= 0).cast("double")).alias("zero_day_share"),
        F.array(*(F.coalesce(F.avg(F.when(d == k, F.col("n"))), F.lit(0.0)) for k in range(7))).alias("_w"),
    )
    safe = F.greatest("mean", F.lit(TINY))
    week = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    some = F.col("volume") > 0
    end = sum((F.col("_w")[k] for k in WEEKEND), F.lit(0.0)) / len(WEEKEND)
    work = sum((F.col("_w")[k] for k in range(7) if k not in WEEKEND), F.lit(0.0)) / (7 - len(WEEKEND))
    out = out.withColumns(
        {
            "log_volume": F.log1p("volume"),
            "volatility": F.col("std") / safe,
            "p75_over_mean": F.col("_q")[0] / safe,
            "p90_over_mean": F.col("_q")[1] / safe,
            **{f"weekday_share_{k}": F.when(some, F.col("_w")[k] / F.greatest(week, F.lit(TINY))).otherwise(1.0 / 7) for k in range(7)},
            "weekend_ratio": F.when(some, end / F.greatest(work, F.lit(TINY))).otherwise(1.0),
        }
    ).drop("_q", "_w")
    total = F.broadcast(out.agg(F.sum("volume").alias("_total")))
    out = out.crossJoin(total).withColumn("demand_share", F.col("volume") / F.greatest(F.col("_total").cast("double"), F.lit(TINY))).drop("_total")
    return out.join(log.cities.select("city_code", "province_code", "lat", "long"), "city_code", "left")


def city_volumes(log: Log) -> DataFrame:
    """fold_cutoff, city_code, province_code, volume: what pooling needs of the profiles, at every cutoff of the log."""
    recent = log.fold_pairs.filter(F.col("checkin") > F.date_sub("fold_cutoff", log.cfg.history_days))
    sums = recent.groupBy("fold_cutoff", "city_code").agg(F.sum("final").alias("volume"))
    cities = log.cities.select("city_code", "province_code").withColumn("fold_cutoff", F.explode(log.cutoffs))
    return cities.join(sums, ["fold_cutoff", "city_code"], "left").withColumn("volume", F.coalesce("volume", F.lit(0).cast("long")))


def standardised(profiles: DataFrame, geo_weight: float = 1.0) -> DataFrame:
    """Profile columns over all cities with mean 0 and spread 1, each block divided by the root of its width."""
    columns = [c for names in BLOCKS.values() for c in names]
    stats = F.broadcast(profiles.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns)))
    weight = {c: (geo_weight if block == "geography" else 1.0) / len(names) ** 0.5 for block, names in BLOCKS.items() for c in names}
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > TINY, F.col(f"_s_{c}")).otherwise(1.0) * weight[c]
    return profiles.crossJoin(stats).select("city_code", "province_code", "volume", "demand_share", *(z(c).alias(c) for c in columns))


def hubs(profiles: DataFrame, share: float) -> DataFrame:
    """Cities that are never merged."""
    return profiles.filter(F.col("demand_share") >= share)


def ward(points: np.ndarray, mass: np.ndarray | None = None, top: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) by Ward's criterion; new clusters are numbered on from the points.

    Chains of nearest neighbours: memory is in proportion to the points, time to their square. A new
    cluster is never nearer to others than its parts were, so the merges are those of the greedy rule,
    found in another order and sorted at the end. Points may be clusters already, of a mass and a height.
    """
    n = len(points)
    mass = np.ones(n) if mass is None else mass.astype(float)
    height = np.zeros(n) if top is None else top.astype(float)
    centre = points.astype(float)
    alive, found, chain, first = np.ones(n, bool), [], [], 0
    while len(found) < n - 1:
        if not chain:
            first += int(alive[first:].argmax())
            chain = [first]
        i = chain[-1]
        gap = ((centre - centre[i]) ** 2).sum(1) * (2 * mass * mass[i] / (mass + mass[i]))
        gap[~alive] = gap[i] = np.inf
        j = int(gap.argmin())
        if len(chain) < 2 or gap[chain[-2]] > gap[j]:
            chain.append(j)
            continue
        j = chain[-2]
        del chain[-2:]
        a, b = min(i, j), max(i, j)
        height[a] = max(np.sqrt(gap[j]), height[a], height[b])
        found.append((float(height[a]), a, b))
        centre[a] = (mass[a] * centre[a] + mass[b] * centre[b]) / (mass[a] + mass[b])
        mass[a] += mass[b]
        alive[b] = False
    # A cluster stands at its smallest point; sorting keeps the order of equal heights, so parts come first.
    name, out = list(range(n)), []
    for new, (top_, a, b) in enumerate(sorted(found, key=lambda x: x[0]), n):
        out.append((min(name[a], name[b]), max(name[a], name[b]), top_))
        name[a] = new
    return out


#: A cluster is named by its smallest city: the cluster of city_code goes into that of the smaller city ``into``.
MERGES = "province_code int, city_code int, into int, height double, n_cities long"
#: Clusters that one task finishes alone, and the side of the squares of distances.
BLOCK = 2048
_NAMES = [c for block in BLOCKS.values() for c in block]
_NEAREST = "city_code int, gap double, tie long, near int"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of codes, the same both ways round, in no order of theirs."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    x = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(2)).astype(np.int64)


def _nearest(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Of a square of two blocks each cluster's nearest one in the other block."""
    rows = [group[group["_own"] == k] for k in (keys[1], keys[2])]
    code = [r["city_code"].to_numpy(np.int64) for r in rows]
    mass = [r["_n"].to_numpy(float) for r in rows]
    at = [r[_NAMES].to_numpy(float) for r in rows]
    if not len(code[0]) or not len(code[1]):
        return pd.DataFrame({"city_code": [], "gap": [], "tie": [], "near": []}).astype({"city_code": "int32", "tie": "int64", "near": "int32"})
    # Dimensions are added one after another, so both ways round a pair has the very same gap.
    gap = np.zeros((len(code[0]), len(code[1])))
    for d in range(len(_NAMES)):
        gap += (at[0][:, d, None] - at[1][None, :, d]) ** 2
    gap *= 2 * mass[0][:, None] * mass[1] / (mass[0][:, None] + mass[1])
    gap[code[0][:, None] == code[1]] = np.inf
    out = []
    for mine, other, g in ((code[0], code[1], gap), (code[1], code[0], gap.T)):
        least = g.min(1)
        i, j = np.nonzero((g == least[:, None]) & np.isfinite(g))
        found = pd.DataFrame({"city_code": mine[i].astype(np.int32), "gap": least[i], "tie": _mixed(mine[i], other[j]), "near": other[j].astype(np.int32)})
        out.append(found.sort_values(["tie", "near"]).drop_duplicates("city_code"))
    return pd.concat(out if keys[1] != keys[2] else out[:1])


def _joined(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clusters after merges (city_code goes into ``into``): mass, height and centre of the two."""
    rows = state.join(pairs.select("city_code", "into", F.col("height").alias("_h")), "city_code", "left")
    mean = [(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(c) for c in _NAMES]
    return rows.groupBy("province_code", F.coalesce("into", "city_code").alias("city_code")).agg(F.sum("_n").alias("_n"), F.greatest(F.max("_top"), F.coalesce(F.max("_h"), F.lit(0.0))).alias("_top"), *mean)


def dendrograms(scaled: DataFrame, hub_share: float, block: int = BLOCK) -> DataFrame:
    """Of each province its merges (MERGES), one row less than cities.

    Cities at one place are merged first, at height 0. While a province has more than ``block`` clusters,
    a round finds each one's nearest by squares of blocks spread over all tasks and merges all pairs that are each
    other's nearest. As a new cluster is never nearer to others than its parts were, such merges are
    those of the greedy rule. What is left of a province is merged in one task, of ``block`` clusters at most. Of pairs with
    equal gaps a hash of their names decides, and the first chain in the last task; so where gaps tie other
    clusters of the same heights may come out. Cities with a coordinate that is null, NaN or infinite take
    no part, those without a province are merged among themselves. A round merges a tenth to a third of the clusters;
    places whose gaps grow from each to the next (only one pair a round) would need one for each city.
    """
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    rows = scaled.filter(F.col("demand_share") < hub_share).filter(reduce(lambda x, y: x & y, map(finite, _NAMES)))
    rows = written(rows.select(F.col("province_code").cast("int").alias("province_code"), F.col("city_code").cast("int").alias("city_code"), *(F.col(c).cast("double").alias(c) for c in _NAMES)))
    # -0.0 and 0.0 are one place.
    place = ["province_code", *(F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in _NAMES)]
    first = rows.groupBy(*place).agg(F.min("city_code").alias("city_code"), F.count(F.lit(1)).cast("double").alias("_n"))
    state = places = written(first.select("province_code", "city_code", "_n", F.lit(0.0).alias("_top"), *_NAMES))
    same = [F.col("r.province_code").eqNullSafe(F.col("f.province_code")), *(F.col(f"r.{c}") == F.col(f"f.{c}") for c in _NAMES)]
    equal = rows.alias("r").join(places.alias("f"), reduce(lambda x, y: x & y, same)).filter(F.col("r.city_code") > F.col("f.city_code"))
    done = [equal.select("r.province_code", "r.city_code", F.col("f.city_code").alias("into"), F.lit(0.0).alias("height"), F.row_number().over(Window.partitionBy("f.city_code").orderBy("r.city_code")).cast("long").alias("_i")).withColumn("n_cities", F.col("_i") + 1).drop("_i")]
    while True:
        sizes = state.groupBy("province_code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")).filter("_blocks > 1")
        squares = sizes.agg(F.sum(F.col("_blocks").cast("long") * (F.col("_blocks") + 1) / 2)).first()[0]
        if not squares:
            break
        pairs = written(_mutual(state, sizes, int(squares)))
        after = written(_joined(state, pairs))
        if state is not places:
            drop(state)
        state = after
        done.append(pairs)
    return reduce(DataFrame.unionByName, [*done, state.groupBy("province_code").applyInPandas(_finish, MERGES)])


def _mutual(state: DataFrame, sizes: DataFrame, squares: int) -> DataFrame:
    """Merges of the clusters that are each other's nearest, in provinces of more than one block."""
    large = state.join(sizes, state["province_code"].eqNullSafe(sizes["province_code"])).drop(sizes["province_code"])
    large = large.withColumn("_own", F.pmod(F.xxhash64("city_code"), F.col("_blocks")).cast("int"))
    squared = large.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    squared = squared.withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")}).drop("_other", "_blocks", "_top")
    key = ["province_code", "_low", "_high"]
    tasks = min(squares, 4 * state.sparkSession.sparkContext.defaultParallelism)
    near = squared.repartition(tasks, *key).groupBy(*key).applyInPandas(_nearest, _NEAREST)
    best = written(near.groupBy("city_code").agg(F.min(F.struct("gap", "tie", "near")).alias("_b")).select("city_code", "_b.gap", "_b.near"))
    back = best.select(F.col("city_code").alias("near"), F.col("near").alias("_back"))
    pairs = best.join(back, "near").filter((F.col("_back") == F.col("city_code")) & (F.col("near") < F.col("city_code")))
    own, other = (state.select(F.col("city_code").alias(k), F.col("_n").alias(f"_n{k}"), F.col("_top").alias(f"_t{k}"), *(["province_code"] if k == "near" else [])) for k in ("city_code", "near"))
    found = pairs.join(own, "city_code").join(other, "near")
    height = F.greatest(F.sqrt("gap"), "_tcity_code", "_tnear")
    return found.select("province_code", "city_code", F.col("near").alias("into"), height.alias("height"), (F.col("_ncity_code") + F.col("_nnear")).cast("long").alias("n_cities"))


def _finish(group: pd.DataFrame) -> pd.DataFrame:
    """All merges of one province's clusters."""
    group = group.sort_values("city_code", ignore_index=True)
    name, size, rows = list(group["city_code"].astype(int)), list(group["_n"]), []
    province = group["province_code"].iloc[0]
    for a, b, height in ward(group[_NAMES].to_numpy(float), group["_n"].to_numpy(), group["_top"].to_numpy()):
        low, high = min(name[a], name[b]), max(name[a], name[b])
        name.append(low)
        size.append(size[a] + size[b])
        rows.append((None if pd.isna(province) else int(province), high, low, height, int(size[-1])))
    return pd.DataFrame(rows, columns=["province_code", "city_code", "into", "height", "n_cities"])


def height_ladder(merges: DataFrame, levels: int) -> DataFrame:
    """Cut heights at equal quantiles of all merge heights."""
    points = tuple(i / (levels - 1) for i in range(levels))
    return exact_quantiles(merges, [], "height", points).select(F.posexplode("q").alias("level", "height"))


def cut(cities: DataFrame, merges: DataFrame, height: float) -> DataFrame:
    """city_code, cluster_code: the smallest member of the largest cluster below the height, else itself.

    Merges up to the height are pointers from a cluster to the one it went into. Each round every
    pointer is replaced by its target's, so rounds are as many as the logarithm of the longest chain.
    """
    to = written(merges.filter(F.col("height") <= height).select("city_code", F.col("into").alias("cluster_code"), F.lit(True).alias("_moved")))
    while not to.filter("_moved").isEmpty():
        far = to.select(F.col("city_code").alias("cluster_code"), F.col("cluster_code").alias("_far"))
        jumped = to.join(far, "cluster_code", "left")
        after = written(jumped.select("city_code", F.coalesce("_far", "cluster_code").alias("cluster_code"), F.col("_far").isNotNull().alias("_moved")))
        drop(to)
        to = after
    return cities.select("city_code").join(to.drop("_moved"), "city_code", "left").select("city_code", F.coalesce("cluster_code", "city_code").alias("cluster_code"))


def cluster_table(profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Size, volume, smallest and largest member and centre (weighted by volume) of each cluster."""
    rows = profiles.join(mapping, "city_code").withColumn("_w", F.when(F.col("volume") > 0, F.col("volume").cast("double")).otherwise(1.0))
    out = rows.groupBy("cluster_code").agg(
        F.min_by("province_code", "city_code").alias("province_code"),
        (F.sum(F.col("lat") * F.col("_w")) / F.sum("_w")).alias("lat"),
        (F.sum(F.col("long") * F.col("_w")) / F.sum("_w")).alias("long"),
        F.count(F.lit(1)).alias("n_cities_in_cluster"),
        F.sum("volume").alias("cluster_volume"),
        F.min("volume").alias("cluster_min_member_volume"),
        F.max("volume").alias("cluster_max_member_volume"),
    )
    share = F.when(F.col("cluster_volume") > 0, F.col("cluster_max_member_volume") / F.col("cluster_volume")).otherwise(1.0)
    return out.withColumn("cluster_max_member_share", share)


def member_shares(profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each member's share of its cluster's volume, equal parts where that is 0."""
    own = Window.partitionBy("cluster_code")
    rows = profiles.select("city_code", "volume").join(mapping, "city_code")
    total, n = F.sum("volume").over(own), F.count(F.lit(1)).over(own)
    return rows.withColumn("member_share", F.when(total > 0, F.col("volume") / total).otherwise(1 / n))


def cluster_names(profiles: DataFrame, mapping: DataFrame, names: DataFrame) -> DataFrame:
    """The largest member's name, with "+n" for the others; of equals the smaller code."""
    rows = profiles.select("city_code", "volume").join(mapping, "city_code").join(names.select("city_code", "city"), "city_code", "left")
    best = F.min_by(F.coalesce("city", F.col("city_code").cast("string")), F.struct(-F.col("volume"), "city_code"))
    out = rows.groupBy("cluster_code").agg(best.alias("_name"), F.count(F.lit(1)).alias("_n"))
    return out.select("cluster_code", F.when(F.col("_n") > 1, F.concat("_name", F.lit(" +"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("_name")).alias("name"))


def rekeyed(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """The log of virtual cities; with every city its own cluster it stays as it is."""
    rows = events.join(mapping, "city_code")
    return rows.groupBy("log_date", F.col("cluster_code").alias("city_code"), "checkin", "days_to_checkin").agg(F.sum("search_count").alias("search_count"))


def pooled_panel(panel: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = ("observed", "predicted_demand", "actual")) -> DataFrame:
    """A city panel summed to clusters: the control of a model fitted on pooled demand."""
    return panel.join(mapping, "city_code").groupBy("cluster_code", "checkin").agg(*(F.sum(c).alias(c) for c in columns))


def blended(city: DataFrame, cluster: DataFrame, profiles: DataFrame, mapping: DataFrame, shrinkage: float | str) -> DataFrame:
    """City forecasts drawn to their cluster's remaining demand by how little volume they have.

    Cities alone in their cluster keep their own forecast. shrinkage: a number, or the column of ``city`` that has it.
    """
    shares = member_shares(profiles, mapping)
    sizes = mapping.groupBy("cluster_code").agg(F.count(F.lit(1)).alias("_n"))
    rows = city.join(shares, "city_code").join(sizes, "cluster_code")
    pooled = cluster.select("cluster_code", "checkin", (F.col("predicted_demand") - F.col("observed")).alias("_pool"))
    rows = rows.join(pooled, ["cluster_code", "checkin"], "left")
    least = F.col(shrinkage) if isinstance(shrinkage, str) else F.lit(float(shrinkage))
    own = F.when((F.col("_n") <= 1) | (least <= 0), 1.0).otherwise(F.col("volume") / (F.col("volume") + least))
    rows = rows.withColumns({"blend_weight": own, "allocated": F.col("member_share") * F.col("_pool")})
    mixed = F.col("observed") + F.col("blend_weight") * (F.col("predicted_demand") - F.col("observed")) + (1 - F.col("blend_weight")) * F.coalesce("allocated", F.lit(0.0))
    return rows.withColumn("blended_demand", F.greatest(mixed, F.col("observed").cast("double"))).drop("_n", "_pool")


def merged_error(panel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Error and demand of merged against single clusters."""
    sizes = mapping.groupBy("cluster_code").agg(F.count(F.lit(1)).alias("_n"))
    rows = pooled_panel(panel, mapping).join(sizes, "cluster_code").withColumn("kind", F.when(F.col("_n") > 1, "merged").otherwise("single"))
    total = F.broadcast(rows.agg(F.sum("actual").alias("_t")))
    error = F.sum(F.abs(F.col("actual") - F.col("predicted_demand")))
    out = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("actual"), error.alias("absolute_error"))
    return out.crossJoin(total).select("kind", "rows", F.try_divide("actual", "_t").alias("actual_share"), "absolute_error", F.try_divide("absolute_error", "_t").alias("wape_contribution"))


def merged_rows(panel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of cities that share a cluster."""
    merged = mapping.groupBy("cluster_code").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("cluster_code")
    return panel.join(mapping.join(merged, "cluster_code", "left_semi").select("city_code"), "city_code", "left_semi")


def gain(clustered: float, control: float, single: float) -> dict[str, float]:
    """What of a clustered WAPE's gain is arithmetic (errors that cancel) and what modelling."""
    return {"total": single - clustered, "mechanical": single - control, "modelling": control - clustered}


def choose_level(scores: dict[float, float], least_gain: float = 0.01) -> float:
    """The lowest cut whose WAPE is within ``least_gain`` of the best, relative to no cut."""
    base, best = scores[min(scores)], min(scores.values())
    if base - best < least_gain * base:
        return min(scores)
    return min(h for h, s in scores.items() if s - best <= least_gain * (base - best))
