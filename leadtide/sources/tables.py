"""The roles that the tables play: a two-clock event log, a city dimension, panels.

An event says how often a city was searched on `log_date` for a stay that begins on `checkin`. Line
items stand for searches: the supplier is the city, the ship date the check-in, and the lead time
comes from the keys.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import Config
from leadtide.sources.shared import written

EVENT_KEY = ("log_date", "city_code", "checkin")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item, keys not yet unique."""
    lead = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13, F.lit(60)).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("city_code"),
        F.to_date("l_shipdate").alias("checkin"),
        lead.alias("days_to_checkin"),
        F.col("l_quantity").cast("long").alias("search_count"),
    )
    return rows.select(F.date_sub("checkin", F.col("days_to_checkin")).alias("log_date"), "city_code", "checkin", "search_count", "days_to_checkin")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_date, city_code, checkin (the key), search_count, days_to_checkin."""
    rows = raw_events(spark, sf_dir)
    return rows.groupBy(*EVENT_KEY, "days_to_checkin").agg(F.sum("search_count").alias("search_count"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_code, province_code, lat, long, city, province."""
    supplier, nation, region = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    # Nations and regions are fixed lists of 25 and 5 rows.
    joined = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.col("s_suppkey")
    return joined.select(
        code.cast("int").alias("city_code"),
        F.col("n_regionkey").cast("int").alias("province_code"),
        (F.lit(25) + F.pmod(code * 37, F.lit(1500)) / 100.0).alias("lat"),
        (F.lit(44) + F.pmod(code * 53, F.lit(1900)) / 100.0).alias("long"),
        F.col("s_name").alias("city"),
        F.col("r_name").alias("province"),
    )


class Log:
    """The event log as a forecaster meets it at one or more cutoffs: the past whole, the target in part.

    Two groupings of the log, each one scan with a pushed range of dates, are written when first asked
    for, and curves, priors and grids of all folds are made of them: `pairs` and `sums`. `history`,
    `target` and `evaluation` are the events themselves, with the cutoff as `fold_cutoff`: they are
    dealt to folds by an explode, after the dates that no fold needs are filtered out. Sums need no
    unique keys, so line items stay as they are.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config, folds: tuple[date, ...] | None = None) -> None:
        self.spark, self.cfg = spark, cfg
        self.folds = folds or (cfg.cutoff,)
        self.all = raw_events(spark, sf_dir)
        self.cities = cities(spark, sf_dir)

    @property
    def cutoffs(self) -> Column:
        return F.array(*map(F.lit, self.folds))

    def dealt(self, events: DataFrame, belongs: Callable[[Column], Column]) -> DataFrame:
        """Events with the cutoff of each fold they belong to."""
        return events.withColumn("fold_cutoff", F.explode(F.filter(self.cutoffs, belongs)))

    @cached_property
    def pairs(self) -> DataFrame:
        """city_code, checkin, final (whole demand), lead (of the first search): check-ins up to the last cutoff, not dealt to folds."""
        past = self.all.filter(F.col("checkin") <= F.lit(max(self.folds)))
        return written(past.groupBy("city_code", "checkin").agg(F.sum("search_count").alias("final"), F.max("days_to_checkin").alias("lead")))

    @property
    def fold_pairs(self) -> DataFrame:
        """The pairs with the cutoff of each fold that has them in its past."""
        return self.dealt(self.pairs, lambda c: F.col("checkin") <= c)

    @cached_property
    def sums(self) -> DataFrame:
        """fold_cutoff, city_code, past, step, total, known: demand of the past by lead time (step), and of
        the target window by days ahead (step), with what of it was logged by the cutoff (known)."""
        days = self.cfg.target_days
        near = self.all.filter(F.col("checkin") <= F.lit(max(self.folds) + timedelta(days=days)))
        rows = self.dealt(near, lambda c: F.col("checkin") <= F.date_add(c, days)).withColumn("_ahead", F.datediff("checkin", "fold_cutoff"))
        past = F.col("_ahead") <= 0
        step = F.when(past, F.col("days_to_checkin")).otherwise(F.col("_ahead"))
        known = F.when(past | (F.col("log_date") <= F.col("fold_cutoff")), F.col("search_count"))
        return written(rows.groupBy("fold_cutoff", "city_code", past.alias("past"), step.alias("step")).agg(F.sum("search_count").alias("total"), F.sum(known).alias("known")))

    @property
    def leads(self) -> DataFrame:
        """fold_cutoff, city_code, days_to_checkin, search_count: demand of the past by lead time."""
        return self.sums.filter("past").select("fold_cutoff", "city_code", F.col("step").alias("days_to_checkin"), F.col("total").alias("search_count"))

    @property
    def windows(self) -> DataFrame:
        """fold_cutoff, city_code, checkin, observed (by the cutoff, null if nothing was), actual: pairs of the target windows."""
        rows = self.sums.filter("NOT past")
        return rows.select("fold_cutoff", "city_code", F.date_add("fold_cutoff", F.col("step")).alias("checkin"), F.col("known").alias("observed"), F.col("total").alias("actual"))

    @property
    def history(self) -> DataFrame:
        return self.dealt(self.all.filter(F.col("checkin") <= F.lit(max(self.folds))), lambda c: F.col("checkin") <= c)

    @property
    def target(self) -> DataFrame:
        """All events of the target windows, also those that come after the cutoff."""
        days = self.cfg.target_days
        near = self.all.filter((F.col("checkin") > F.lit(min(self.folds))) & (F.col("checkin") <= F.lit(max(self.folds) + timedelta(days=days))))
        return self.dealt(near, lambda c: (F.col("checkin") > c) & (F.col("checkin") <= F.date_add(c, days)))

    @property
    def evaluation(self) -> DataFrame:
        return self.target.filter(F.col("log_date") <= F.col("fold_cutoff"))


class FoldLog(Log):
    """A log at one of its cutoffs: its groupings are parts of the whole log's, so the events aren't scanned again."""

    def __init__(self, log: Log, cutoff: date) -> None:
        if cutoff not in log.folds:
            raise ValueError(f"{cutoff} is no cutoff of the log")
        self.spark, self.cfg, self.folds = log.spark, log.cfg.at(cutoff), (cutoff,)
        self.of, self.all, self.cities = log, log.all, log.cities

    @property
    def pairs(self) -> DataFrame:
        return self.of.pairs.filter(F.col("checkin") <= F.lit(self.cfg.cutoff))

    @property
    def sums(self) -> DataFrame:
        return self.of.sums.filter(F.col("fold_cutoff") == F.lit(self.cfg.cutoff))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: ds, entity_id (nation), destination_id (region), category_id, value; a row an order."""
    orders, customer, nation, region = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    named = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    named = named.select("c_custkey", F.col("n_name").alias("entity_id"), F.col("r_name").alias("destination_id"), F.col("c_mktsegment").alias("category_id"))
    return orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("ds"), "entity_id", "destination_id", "category_id", F.col("o_totalprice").alias("value"))


def demand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, ds, y (orders a day, sparse), price (mean value), destination_id."""
    rows = orders_panel(spark, sf_dir)
    return rows.groupBy("entity_id", "ds").agg(F.count(F.lit(1)).alias("y"), F.round(F.avg("value"), 4).alias("price"), F.min("destination_id").alias("destination_id"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table: ds, entity_id (user), category_id (type), value, k (from its JSON)."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.to_date("ts").alias("ds"), F.col("ts"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("category_id"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
