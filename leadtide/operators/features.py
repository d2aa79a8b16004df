"""Features of a pair as it was seen some days ahead, read from matrices of demand by lead time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtide.config import EPS
from leadtide.functions.calendar import WEEKEND, is_weekend, jalali_parts
from leadtide.operators.asof import PAIR, complete_grid
from leadtide.operators.curves import FOLD, city_curves, zero_sums
from leadtide.sources.tables import Log

#: Lead times that a state tells apart.
SLOTS = 60
NULLABLE = ("days_since_first_search", "days_since_last_search", "search_span")
# The features of the compact set.
COMPACT = (
    "observed_total", "days_to_checkin", "pickup_1d", "pickup_3d", "pickup_7d", "pickup_14d", "pickup_velocity_7d",
    "pickup_acceleration_7d", "pickup_3d_over_7d", "active_search_days", "days_since_last_search",
    "expected_completion_fraction", "pickup_baseline_remaining", "pickup_surprise", "checkin_weekday", "is_weekend",
    "jalali_month", "jalali_day", "city_code", "province_code", "city_share_of_market", "province_observed_total",
)
HISTORY = ("city_hist_mean", "city_hist_median", "city_hist_p75", "city_hist_p90", "city_hist_std", "city_volatility", "city_weekend_ratio")

# All features of a row, in order.
FEATURES = (
    "observed_total", "days_to_checkin", "pickup_1d", "pickup_3d", "pickup_7d", "pickup_14d",
    "pickup_velocity_3d", "pickup_velocity_7d", "pickup_velocity_14d", "pickup_acceleration_3d", "pickup_acceleration_7d",
    "pickup_1d_share", "pickup_3d_share", "pickup_7d_share", "pickup_3d_over_7d",
    "active_search_days", "days_since_first_search", "days_since_last_search", "max_daily_search", "mean_daily_search", "std_daily_search", "search_span",
    "expected_completion_fraction", "expected_remaining_fraction", "pickup_baseline_prediction", "pickup_baseline_remaining", "pickup_surprise",
    "checkin_weekday", "is_weekend", "checkin_day_of_month", "jalali_month", "jalali_day",
    "city_code", "province_code", "lat", "long", *HISTORY, "city_weekday_mean",
    *(f"market_{x}" for x in ("observed_total", "pickup_1d", "pickup_3d", "pickup_7d", "pickup_14d", "pickup_velocity_3d", "pickup_velocity_7d", "pickup_velocity_14d", "pickup_acceleration_3d", "pickup_acceleration_7d")), "city_share_of_market",
    *(f"province_{x}" for x in ("observed_total", "pickup_1d", "pickup_3d", "pickup_7d", "pickup_14d", "pickup_velocity_3d", "pickup_velocity_7d", "pickup_velocity_14d", "pickup_acceleration_3d", "pickup_acceleration_7d")), "city_share_of_province",
)
# The block of virtual cities.
CLUSTER = ("n_cities_in_cluster", "cluster_min_member_volume", "cluster_max_member_share")


def calendar_block() -> dict[str, Column]:
    _, month, number = jalali_parts("checkin")
    return {"checkin_weekday": F.weekday("checkin"), "is_weekend": is_weekend("checkin"), "checkin_day_of_month": F.dayofmonth("checkin"), "jalali_month": month, "jalali_day": number}


def lead_counts(log: Log, events: DataFrame) -> DataFrame:
    """city_code, province_code, checkin, days_to_checkin, n: demand by lead time within the slots of a state."""
    long = events.filter(F.col("days_to_checkin").between(0, SLOTS - 1)).groupBy(*PAIR, "days_to_checkin").agg(F.sum("search_count").alias("n"))
    return long.join(log.cities.select("city_code", "province_code"), "city_code", "left")


def entries(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entries: a group's counts by lead time, ``SLOTS`` of them at most."""
    own = counts.groupBy(*keys, "days_to_checkin").agg(F.sum("n").alias("n"))
    return own.groupBy(*keys).agg(F.collect_list(F.struct("days_to_checkin", "n")).alias("entries"))


def dense(column: pa.Array) -> np.ndarray:
    """rows x slots of counts from lists of (lead time, count)."""
    out = np.zeros((len(column), SLOTS), np.int64)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    out[np.repeat(np.arange(len(column)), lengths), flat.field(0).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
    return out


def from_lead(values: np.ndarray, way: np.ufunc = np.add) -> np.ndarray:
    """Running sums (or maxima, ...) from the last slot down, with nothing after it."""
    return np.concatenate([way.accumulate(values[:, ::-1], axis=1)[:, ::-1], np.zeros((len(values), 1), values.dtype)], 1)


def numbers_seen(daily: np.ndarray, h: np.ndarray, prefix: str, more: bool) -> dict[str, pa.Array]:
    """What is known ``h`` days ahead of each row: demand, what came in last, speed; with ``more`` also shares and activity."""
    cum, rows = from_lead(daily), np.arange(len(daily))
    at = lambda table, k: table[rows, np.minimum(k, SLOTS)]
    came = lambda k, w: at(cum, k) - at(cum, k + w)
    out = {f"{prefix}observed_total": at(cum, h)} | {f"{prefix}pickup_{w}d": came(h, w) for w in (1, 3, 7, 14)}
    out |= {f"{prefix}pickup_velocity_{w}d": came(h, w) / w for w in (3, 7, 14)}
    out |= {f"{prefix}pickup_acceleration_{w}d": came(h, w) / w - came(h + w, w) / w for w in (3, 7)}
    if not more:
        return {k: pa.array(v) for k, v in out.items()}
    out |= {f"pickup_{w}d_share": came(h, w) / (at(cum, h) + EPS) for w in (1, 3, 7)}
    out["pickup_3d_over_7d"] = came(h, 3) / (came(h, 7) + EPS)
    active = daily > 0
    n, squares = at(from_lead(active.astype(np.int64)), h), at(from_lead(daily.astype(np.float64) ** 2), h)
    lead = np.where(active, np.arange(SLOTS), SLOTS)
    nearest = np.concatenate([np.minimum.accumulate(lead[:, ::-1], axis=1)[:, ::-1], np.full((len(daily), 1), SLOTS)], 1)
    earliest = np.where(active, np.arange(SLOTS), -1).max(1)
    none = n == 0
    mean = at(cum, h) / np.maximum(n, 1)
    first, last = earliest - h, at(nearest, h) - h
    spread = np.where(none, 0.0, squares / np.maximum(n, 1) - mean * mean)
    whole = lambda v, nulls=None: pa.array(v, pa.int32(), mask=nulls)
    return {k: pa.array(v) for k, v in out.items()} | {
        "active_search_days": whole(n),
        "days_since_first_search": whole(first, none),
        "days_since_last_search": whole(last, none),
        "max_daily_search": pa.array(at(from_lead(daily, np.maximum), h)),
        "mean_daily_search": pa.array(mean),
        "std_daily_search": pa.array(np.sqrt(np.maximum(spread, 0.0))),
        "search_span": whole(first - last, none),
        "final": pa.array(cum[:, 0]),
    }


def seen_features(frame: DataFrame, keys: list[str], horizons: tuple[int, ...] | None, prefix: str = "", more: bool = False) -> DataFrame:
    """keys, horizon and features of a frame with `entries`: a row for each of ``horizons``, or for the row's own `horizon`.

    States are matrices of a batch, so a feature of a horizon is one step for all its rows.
    """
    probe = numbers_seen(np.zeros((0, SLOTS), np.int64), np.zeros(0, np.int64), prefix, more)
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            daily = dense(batch.column("entries"))
            for h in horizons or (None,):
                at = batch.column("horizon").to_numpy(zero_copy_only=False).astype(np.int64) if h is None else np.full(batch.num_rows, h, np.int64)
                own = numbers_seen(daily, at, prefix, more)
                yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(at, pa.int32()), *own.values()], [*keys, "horizon", *own])

    kinds = dict(frame.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "horizon int", *(f"{k} {names[v.type]}" for k, v in probe.items())])
    return frame.select(*keys, *([] if horizons else ["horizon"]), "entries").mapInArrow(task, schema)


def training_counts(log: Log) -> tuple[DataFrame, DataFrame]:
    """The complete grid of the training window up to the cutoff, and the counts of its check-ins."""
    cfg = log.cfg
    start = cfg.cutoff - timedelta(days=cfg.train_window_days - 1)
    events = log.all.filter(F.col("checkin").between(F.lit(start), F.lit(cfg.cutoff)))
    return complete_grid(log.cities.select("city_code", "province_code"), start, cfg.cutoff), lead_counts(log, events)


def pair_features(grid: DataFrame, counts: DataFrame, horizons: tuple[int, ...] | None) -> DataFrame:
    """Features of the grid's pairs alone, with `final`, their whole demand."""
    keys = ["city_code", "province_code", "checkin"]
    return seen_features(spread(grid, *PAIR).join(entries(counts, PAIR), PAIR, "left"), keys, horizons, more=True)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as a shuffle has: small rows that cost much work each would else be put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def around_features(grid: DataFrame, counts: DataFrame, keys: list[str], prefix: str, horizons: tuple[int, ...] | None) -> DataFrame:
    """The same of the market (keys: checkin) or of provinces, at the horizons of the grid."""
    own = [*keys, *([] if horizons else ["horizon"])]
    return seen_features(grid.select(*own).distinct().join(entries(counts, keys), keys, "left"), keys, horizons, prefix)


def with_features(grid: DataFrame, counts: DataFrame, log: Log, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """All features of a grid's pairs at ``horizons``, or each at its own `horizon`. Only narrow rows are joined."""
    pairs = pair_features(grid, counts, horizons)
    # Dates x horizons, and provinces of which there are few: bounded by the window.
    market = F.broadcast(around_features(grid, counts, ["checkin"], "market_", horizons))
    province = F.broadcast(around_features(grid, counts, ["province_code", "checkin"], "province_", horizons))
    out = pairs.join(market, ["checkin", "horizon"]).join(province, ["province_code", "checkin", "horizon"])
    h = F.col("horizon")
    out = out.withColumns({FOLD: F.lit(log.cfg.cutoff), **calendar_block()}).join(city_side(log), [FOLD, "city_code"], "left")
    step, near = F.least(F.greatest(h, F.lit(0)), F.lit(log.cfg.max_lead)) + 1, F.greatest(F.least(h, F.lit(log.cfg.target_days)), F.lit(1))
    fraction, observed = F.col("expected_completion_fraction"), F.col("observed_total")
    out = out.withColumn("expected_completion_fraction", F.greatest(F.least(F.element_at("_curve", step), F.lit(1.0)), F.lit(log.cfg.min_fraction)))
    out = out.withColumns(
        {
            "days_to_checkin": h,
            "expected_remaining_fraction": 1 - fraction,
            "pickup_baseline_prediction": F.greatest(observed / fraction, observed.cast("double")),
            "pickup_baseline_remaining": F.greatest(observed / fraction - observed, F.lit(0.0)),
            "pickup_surprise": observed / (F.greatest(F.coalesce(F.element_at("_means", near), F.lit(0.0)), F.lit(0.0)) * fraction + EPS),
            "city_share_of_market": observed / (F.col("market_observed_total") + EPS),
            "city_share_of_province": observed / (F.col("province_observed_total") + EPS),
        }
    ).drop("_curve", "_means")
    return with_history(out, log)


def city_side(log: Log) -> DataFrame:
    """fold_cutoff, city_code, lat, long, _curve (its completion curve by days ahead, else its province's, else that of all), _means (its zero prior by horizon): a row a city."""
    cities = log.cities.select("city_code", "province_code", "lat", "long").withColumn(FOLD, F.lit(log.cfg.cutoff))
    return cities.join(city_curves(log), [FOLD, "city_code"]).join(zero_sums(log, ("city",)).select(FOLD, F.col("key").alias("city_code"), F.col("means").alias("_means")), [FOLD, "city_code"], "left").drop("province_code")


def with_history(rows: DataFrame, log: Log) -> DataFrame:
    """A row's city statistics as of the row's own origin, min(checkin - horizon, cutoff); 0 before any."""
    at = rows.withColumn("origin", F.least(F.date_sub("checkin", F.col("horizon")), F.lit(log.cfg.cutoff)))
    out = at.join(origin_history(log), ["city_code", "origin"], "left")
    out = out.withColumn("city_weekday_mean", F.coalesce(F.col("weekday_means")[F.weekday("checkin")], F.lit(0.0)))
    return out.fillna(0.0, list(HISTORY)).drop("weekday_means", "origin")


def with_clusters(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The shape of each row's virtual city; only rows of a panel of clusters have one, so ``table`` must hold it."""
    missing = [c for c in CLUSTER if c not in table.columns]
    if missing:
        raise ValueError(f"the cluster block needs a table of virtual cities with {', '.join(missing)}")
    shape = table.select(F.col("cluster_code").alias("city_code"), *(F.col(c).cast("double").alias(c) for c in CLUSTER))
    return rows.join(shape, "city_code", "left")


def training_frame(log: Log) -> DataFrame:
    """Features of every pair and horizon of the training window, and the demand still to come."""
    from leadtide.operators import frames

    return frames.training_frame(log)


def joined_training_frame(log: Log) -> DataFrame:
    """The same by joins of narrow rows; what `training_frame` is tested against."""
    grid, counts = training_counts(log)
    out = with_features(grid, counts, log, log.cfg.train_horizons)
    return out.withColumn("remaining_demand", F.greatest(F.col("final") - F.col("observed_total"), F.lit(0).cast("long")))


def inference_frame(log: Log) -> DataFrame:
    """Features of the target window, each check-in at its own horizon; only what was logged by the cutoff counts."""
    cfg = log.cfg
    grid = complete_grid(log.cities.select("city_code", "province_code"), cfg.target_start, cfg.target_end).withColumn("horizon", F.datediff("checkin", F.lit(cfg.cutoff)))
    return with_features(grid, lead_counts(log, log.evaluation.drop(FOLD)), log).drop("final")


def quality_gate(frame: DataFrame, features: list[str]) -> DataFrame:
    """feature, nulls, infinite, allowed: nulls only where a pair without searches has no value; one pass."""
    sums = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite")).alias(c) for c in features]
    return allowed(frame.agg(*sums).select(F.explode(F.array(*features)).alias("f")).select("f.*"))


def allowed(counts: DataFrame) -> DataFrame:
    return counts.withColumn("allowed", (F.col("infinite") == 0) & ((F.col("nulls") == 0) | F.col("feature").isin(*NULLABLE)))


def completed_history(log: Log, days: int | None) -> DataFrame:
    """city_code, checkin, n: each city's days up to the cutoff, days without events being 0."""
    cfg = log.cfg
    past = log.pairs.filter(F.col("checkin") <= F.lit(cfg.cutoff))
    sums = past.select(*PAIR, F.col("final").alias("n"))
    first = F.broadcast(past.agg(F.min("checkin").alias("_first")))  # one row
    start = F.greatest(F.col("_first"), F.lit(cfg.cutoff - timedelta(days=days - 1))) if days else F.col("_first")
    grid = log.cities.select("city_code").crossJoin(first).select("city_code", F.explode(F.sequence(start, F.lit(cfg.cutoff))).alias("checkin"))
    return grid.join(sums, PAIR, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def city_history(log: Log) -> DataFrame:
    """Level, quantiles and spread of each city's completed days, and its weekend against its weekdays."""
    rows = completed_history(log, log.cfg.history_days).withColumn("_weekend", F.weekday("checkin").isin(*WEEKEND))
    out = rows.groupBy("city_code").agg(
        F.avg("n").alias("city_hist_mean"),
        F.percentile("n", F.array(*map(F.lit, (0.5, 0.75, 0.9)))).alias("_q"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("city_hist_std"),
        F.avg(F.when(F.col("_weekend"), F.col("n"))).alias("_end"),
        F.avg(F.when(~F.col("_weekend"), F.col("n"))).alias("_work"),
        *(F.coalesce(F.avg(F.when(F.weekday("checkin") == d, F.col("n"))), F.lit(0.0)).alias(f"weekday_mean_{d}") for d in range(7)),
    )
    out = out.withColumns({name: F.col("_q")[i] for i, name in enumerate(("city_hist_median", "city_hist_p75", "city_hist_p90"))})
    out = out.withColumns({"city_volatility": F.col("city_hist_std") / (F.col("city_hist_mean") + EPS), "city_weekend_ratio": F.coalesce(F.col("_end") / (F.col("_work") + EPS), F.lit(1.0))})
    return out.select("city_code", *HISTORY, *(f"weekday_mean_{d}" for d in range(7)))


def origin_history(log: Log) -> DataFrame:
    """The same statistics as of every date: rolling over the rows of the last ``history_days`` dates.

    A city's days are one sorted group, which time bounds. Its window is kept as a sorted list and as whole sums: a day
    comes in, one goes out, and quantiles are read by their rank.
    """
    days, eps = log.cfg.history_days, EPS
    rows = completed_history(log, None)

    def rolled(table: pa.Table) -> pa.Table:
        table = table.sort_by("checkin")
        values, weekdays = table.column("n").to_pylist(), table.column("weekday").to_pylist()
        out: dict[str, list] = {c: [] for c in (*HISTORY, "weekday_means")}
        held, total, squares, sums, counts = [], 0, 0, [0] * 7, [0] * 7
        for i, (n, d) in enumerate(zip(values, weekdays, strict=True)):
            insort(held, n)
            total, squares = total + n, squares + n * n
            sums[d] += n
            counts[d] += 1
            if i >= days:
                gone, w = values[i - days], weekdays[i - days]
                del held[bisect_left(held, gone)]
                total, squares = total - gone, squares - gone * gone
                sums[w] -= gone
                counts[w] -= 1
            size = len(held)
            mean = total / size
            std = ((squares * size - total * total) / (size * (size - 1))) ** 0.5 if size > 1 else 0.0
            out["city_hist_mean"].append(mean)
            for name, q in (("city_hist_median", 0.5), ("city_hist_p75", 0.75), ("city_hist_p90", 0.9)):
                low, part = divmod(q * (size - 1), 1)
                below = held[int(low)]
                out[name].append(below + part * (held[min(int(low) + 1, size - 1)] - below))
            out["city_hist_std"].append(std)
            out["city_volatility"].append(std / (mean + eps))
            ends, rest = sum(counts[w] for w in WEEKEND), size - sum(counts[w] for w in WEEKEND)
            end_total = sum(sums[w] for w in WEEKEND)
            out["city_weekend_ratio"].append((end_total / ends) / ((total - end_total) / rest + eps) if ends and rest else 1.0)
            out["weekday_means"].append([s / c if c else 0.0 for s, c in zip(sums, counts, strict=True)])
        return pa.table({"city_code": table.column("city_code"), "origin": table.column("checkin"), **{c: pa.array(v, pa.list_(pa.float64()) if c == "weekday_means" else pa.float64()) for c, v in out.items()}})

    schema = "city_code int, origin date, " + ", ".join(f"{c} double" for c in HISTORY) + ", weekday_means array<double>"
    return spread(rows.select("city_code", "checkin", "n", F.weekday("checkin").alias("weekday")), "city_code").groupBy("city_code").applyInArrow(rolled, schema)


def with_origin_history(rows: DataFrame, log: Log) -> DataFrame:
    """Statistics as of min(checkin - horizon, cutoff), only for origins that rows ask for.

    A city's days are one array (bounded by time), and an origin's window is a slice of it, so nothing
    is rolled over dates that no row needs.
    """
    at = rows.withColumn("origin", F.least(F.date_sub("checkin", F.col("horizon")), F.lit(log.cfg.cutoff)))
    days = completed_history(log, None).groupBy("city_code").agg(F.array_sort(F.collect_list(F.struct("checkin", F.col("n").cast("double").alias("n")))).alias("_days"))
    place = F.datediff("origin", F.col("_days")[0]["checkin"]) + 1
    wanted = at.select("city_code", "origin").distinct().join(days, "city_code").withColumn("_i", place).filter("_i >= 1")
    length = F.least(F.col("_i"), F.lit(log.cfg.history_days))
    wanted = wanted.withColumn("_w", F.slice("_days", F.col("_i") - length + 1, length)).withColumn("_v", F.transform("_w", lambda x: x["n"]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = lambda xs: F.when(F.size(xs) > 0, total(xs) / F.size(xs))
    some = lambda keep: F.transform(F.filter("_w", keep), lambda x: x["n"])
    wanted = wanted.withColumns({"city_hist_mean": mean(F.col("_v")), "_s": F.array_sort("_v")})

    def quantile(q: float) -> Column:
        rank = q * (F.size("_s") - 1)
        low, high = F.element_at("_s", F.floor(rank).cast("int") + 1), F.element_at("_s", F.ceil(rank).cast("int") + 1)
        return low + (high - low) * (rank - F.floor(rank))

    squares = F.aggregate(F.transform("_v", lambda x: (x - F.col("city_hist_mean")) * (x - F.col("city_hist_mean"))), F.lit(0.0), lambda a, x: a + x)
    std = F.coalesce(F.when(F.size("_v") > 1, F.sqrt(squares / (F.size("_v") - 1))), F.lit(0.0))
    wanted = wanted.withColumns({"city_hist_median": quantile(0.5), "city_hist_p75": quantile(0.75), "city_hist_p90": quantile(0.9), "city_hist_std": std})
    end, work = mean(some(lambda x: F.weekday(x["checkin"]).isin(*WEEKEND))), mean(some(lambda x: ~F.weekday(x["checkin"]).isin(*WEEKEND)))
    by_day = F.array(*(F.coalesce(mean(some(lambda x, d=d: F.weekday(x["checkin"]) == d)), F.lit(0.0)) for d in range(7)))
    table = wanted.select("city_code", "origin", *HISTORY[:5], (F.col("city_hist_std") / (F.col("city_hist_mean") + EPS)).alias("city_volatility"), F.coalesce(end / (work + EPS), F.lit(1.0)).alias("city_weekend_ratio"), by_day.alias("_by_day"))
    out = at.join(table, ["city_code", "origin"], "left").withColumn("city_weekday_mean", F.coalesce(F.col("_by_day")[F.weekday("checkin")], F.lit(0.0)))
    return out.fillna(0.0, list(HISTORY)).drop("_by_day", "origin")
