"""What was known when: as-of sums, complete grids, and the lead-time state of a pair.

The lead-time state is the centre of the two-clock core. One grouping turns the log into a row for each
(city, check-in) with `daily`, the counts of every lead time, `cum`, their sums from a lead time on, and
`tail`, what else is known of the days from a lead time on. Then demand seen h days ahead is cum[h], the
final demand is cum[0], and what came in within w days is cum[h] - cum[h + w]: features of any horizon
are array lookups without another shuffle or another walk over the days.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtide.config import Config
from leadtide.operators.order import quantiles as exact_quantiles
from leadtide.sources.tables import Log

PAIR = ["city_code", "checkin"]
FOLD_PAIR = ["fold_cutoff", *PAIR]


def history_before(events: DataFrame, cutoff: date) -> DataFrame:
    """Events of check-ins that have passed at the cutoff."""
    return events.filter(F.col("checkin") <= F.lit(cutoff))


def observed_at(events: DataFrame, cutoff: date, start: date, end: date, name: str = "observed") -> DataFrame:
    """Demand logged by the cutoff for check-ins in a window, by pair."""
    seen = events.filter((F.col("log_date") <= F.lit(cutoff)) & F.col("checkin").between(F.lit(start), F.lit(end)))
    return seen.groupBy(*PAIR).agg(F.sum("search_count").alias(name))


def final_demand(events: DataFrame, start: date, end: date, name: str = "final") -> DataFrame:
    """Whole demand of check-ins in a window, by pair."""
    return events.filter(F.col("checkin").between(F.lit(start), F.lit(end))).groupBy(*PAIR).agg(F.sum("search_count").alias(name))


def complete_grid(cities: DataFrame, start: date, end: date) -> DataFrame:
    """Every city with every date: rows are made by an explode, without a join."""
    return cities.withColumn("checkin", F.explode(F.sequence(F.lit(start), F.lit(end))))


def target_grid(log: Log) -> DataFrame:
    """fold_cutoff, city_code, province_code, checkin, horizon of every pair of the target windows."""
    grid = log.cities.select("city_code", "province_code").withColumn("fold_cutoff", F.explode(log.cutoffs))
    days = F.sequence(F.date_add("fold_cutoff", 1), F.date_add("fold_cutoff", log.cfg.target_days))
    return grid.withColumn("checkin", F.explode(days)).withColumn("horizon", F.datediff("checkin", "fold_cutoff"))


def forecast_grid(log: Log) -> DataFrame:
    """The target grid with `observed`, the demand seen by the cutoff."""
    seen = log.windows.drop("actual")
    return target_grid(log).join(seen, FOLD_PAIR, "left").withColumn("observed", F.coalesce("observed", F.lit(0).cast("long")))


def fold_frame(log: Log) -> DataFrame:
    """The grid with `actual` too, what its pairs came to in the end."""
    zero = F.lit(0).cast("long")
    return target_grid(log).join(log.windows, FOLD_PAIR, "left").withColumns({"observed": F.coalesce("observed", zero), "actual": F.coalesce("actual", zero)})


def bucket_label(horizon: Column, buckets: tuple[tuple[int, int], ...], other: str | None) -> Column:
    """"low-high" of the bucket that holds a horizon; ``other`` outside of all."""
    label = F.lit(other).cast("string")
    for low, high in reversed(buckets):
        label = F.when(horizon.between(low, high), f"{low}-{high}").otherwise(label)
    return label


def demand_bucket(frame: DataFrame, value: str, quantiles: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Adds demand_bucket: where a value lies among its fold's quantiles.

    Equal edges count once, and the labels are dealt to the edges left in order, so labels shift when
    edges tie. A value lies in a bucket if it is above its lower and at most its upper edge; the least
    value belongs to the first. With fewer than two edges left all rows are "all".
    """
    by = by or []
    edges = exact_quantiles(frame, by, value, quantiles).select(*by, F.array_sort(F.array_distinct("q")).alias("_edges"))
    labels = F.array(*(F.lit(f"q{a:.2f}-{b:.2f}") for a, b in zip(quantiles, quantiles[1:], strict=False)))
    joined = frame.join(edges, by) if by else frame.crossJoin(F.broadcast(edges))  # one row
    above = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    label = F.when(F.size("_edges") < 2, F.lit("all")).otherwise(F.element_at(labels, F.greatest(above, F.lit(1))))
    return joined.withColumn("demand_bucket", label).drop("_edges")


def annotate(frame: DataFrame, cfg: Config, by: tuple[str, ...] = ("fold_cutoff",)) -> DataFrame:
    """Adds weekday, horizon_bucket, demand_bucket and observation_state."""
    out = frame.withColumns(
        {
            "weekday": F.weekday("checkin"),
            "horizon_bucket": bucket_label(F.col("horizon"), cfg.horizon_buckets, None),
            "observation_state": F.when(F.col("observed") > 0, "observed").otherwise("unobserved"),
        }
    )
    return demand_bucket(out, "actual", cfg.demand_quantiles, list(by))


def nothing() -> Column:
    """The tail of a pair from a lead time on from which nothing came in."""
    count = F.lit(0).cast("long")
    return F.struct(count.alias("cum"), F.lit(0).alias("days"), F.lit(None).cast("int").alias("first"), count.alias("top"), F.lit(0.0).alias("squares"))


def sums_from(counts: str, slots: int = 60) -> Column:
    """From a map of counts by lead time the array of slots + 1 sums from a lead time on."""
    zero = F.lit(0).cast("long")
    far_first = F.sequence(F.lit(slots - 1), F.lit(0), F.lit(-1))
    return F.aggregate(far_first, F.array(zero), lambda acc, d: F.concat(F.array(F.coalesce(F.try_element_at(counts, d), zero) + acc[0]), acc))


def lead_state(events: DataFrame, keys: list[str], slots: int = 60, tails: bool = False) -> DataFrame:
    """keys, daily (array of ``slots`` counts by lead time), cum (slots + 1 sums from a lead time on); with tails
    also tail (as many structs: days with any count from a lead time on, their least lead, greatest count, sum of squares).

    Lead times outside 0 .. slots - 1 are left out. A group's list has ``slots`` entries at most.
    """
    long = events.filter(F.col("days_to_checkin").between(0, slots - 1)).groupBy(*keys, "days_to_checkin").agg(F.sum("search_count").alias("_n"))
    grouped = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("days_to_checkin", "_n"))).alias("_m"))
    zero = F.lit(0).cast("long")
    daily = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda d: F.coalesce(F.try_element_at("_m", d), zero))
    if not tails:
        return grouped.select(*keys, daily.alias("daily"), sums_from("_m", slots).alias("cum"))

    def before(acc: Column, d: Column) -> Column:
        n, next_ = F.coalesce(F.try_element_at("_m", d), zero), acc[0]
        own = F.struct(
            (next_["cum"] + n).alias("cum"),
            (next_["days"] + (n > 0).cast("int")).alias("days"),
            F.when(n > 0, d).otherwise(next_["first"]).alias("first"),
            F.greatest(next_["top"], n).alias("top"),
            (next_["squares"] + n.cast("double") * n).alias("squares"),
        )
        return F.concat(F.array(own), acc)

    tail = F.aggregate(F.sequence(F.lit(slots - 1), F.lit(0), F.lit(-1)), F.array(nothing()), before)
    return grouped.select(*keys, daily.alias("daily"), tail.alias("tail")).withColumn("cum", F.col("tail")["cum"])


def pair_state(grid: DataFrame, events: DataFrame, slots: int = 60) -> DataFrame:
    """The lead-time state of every pair of a grid; pairs without events have zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    state = grid.join(lead_state(events, PAIR, slots, tails=True), PAIR, "left")
    return state.withColumns({"daily": F.coalesce("daily", zeros(slots)), "cum": F.coalesce("cum", zeros(slots + 1)), "tail": F.coalesce("tail", F.array_repeat(nothing(), slots + 1))})


def seen(cum: Column | str, horizon: Column, slots: int = 60) -> Column:
    """Demand visible ``horizon`` days ahead."""
    cum = F.col(cum) if isinstance(cum, str) else cum
    return F.element_at(cum, F.least(horizon, F.lit(slots)) + 1)


def came_in(cum: Column | str, horizon: Column, window: int, slots: int = 60) -> Column:
    """Demand that came in within ``window`` days before that."""
    return seen(cum, horizon, slots) - seen(cum, horizon + window, slots)
