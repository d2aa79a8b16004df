"""Scoring over folds: simulated cutoffs of the past, each with what was known then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions.metrics import score
from leadtide.operators.asof import FOLD_PAIR, annotate, fold_frame
from leadtide.operators.curves import pickup_forecast, with_demand_prior
from leadtide.operators.order import quantiles as exact_quantiles
from leadtide.sources.tables import Log


def last_year(rows: DataFrame, log: Log, name: str = "last_year") -> DataFrame:
    """Adds the demand 364 days before, which keeps the weekday; 0 where there is none."""
    shifted = log.all.withColumn("checkin", F.date_add("checkin", 364))
    days = log.cfg.target_days
    old = log.dealt(shifted, lambda c: (F.col("checkin") > c) & (F.col("checkin") <= F.date_add(c, days)))
    old = old.groupBy(*FOLD_PAIR).agg(F.sum("search_count").alias(name))
    return rows.join(old, FOLD_PAIR, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def scored_frame(log: Log) -> DataFrame:
    """The scored grid of all folds, with the forecast, reference baselines and segments."""
    frame = pickup_forecast(log, fold_frame(log))
    return annotate(with_demand_prior(last_year(frame, log), log), log.cfg)


def reference_scores(frame: DataFrame, *by: str) -> DataFrame:
    """The three reference baselines, scored on the rows of the forecast: one pass, unpivoted."""
    names = {"observed": "observed_so_far", "last_year": "last_year_same_date", "city_weekday_mean": "city_weekday_mean"}
    long = frame.select(*by, "actual", F.explode(F.array(*(F.struct(F.lit(v).alias("reference"), F.col(k).cast("double").alias("value")) for k, v in names.items()))).alias("r"))
    return long.select(*by, "actual", "r.reference", "r.value").groupBy(*by, "reference").agg(*score("actual", "value"))


def pooled(scores: DataFrame, *by: str) -> DataFrame:
    """Fold scores, already rounded, pooled by the demand of the folds."""
    return scores.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.round(F.sum("actual_total"), 2).alias("actual_total"),
        F.round(F.try_divide(F.sum(F.col("wape") * F.col("actual_total")), F.sum("actual_total")), 6).alias("wape"),
        F.round(F.try_divide(F.sum(F.col("normalised_bias") * F.col("actual_total")), F.sum("actual_total")), 6).alias("normalised_bias"),
    )


def worst_cities(frame: DataFrame, limit: int = 20) -> DataFrame:
    """Of each fold the cities with the highest WAPE; ties go to the smaller code."""
    scored = frame.groupBy("fold_cutoff", "city_code").agg(*score()).filter("wape IS NOT NULL")
    order = Window.partitionBy("fold_cutoff").orderBy(F.desc("wape"), "city_code")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def city_wape_quantiles(frame: DataFrame) -> DataFrame:
    scored = frame.groupBy("fold_cutoff", "city_code").agg(*score()).filter("wape IS NOT NULL")
    names = ("p10", "p25", "p50", "p75", "p90")
    found = scored.groupBy("fold_cutoff").agg(F.percentile("wape", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q"))
    return found.select("fold_cutoff", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(names)))


def top_demand_scores(frame: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Scores of the rows at or above the quantiles of actual demand, within each fold."""
    edges = exact_quantiles(frame, ["fold_cutoff"], "actual", tuple(1 - s for s in shares)).select("fold_cutoff", F.col("q").alias("_edges"))
    labels = F.array(*(F.struct(F.lit(f"top_{s * 100:g}_pct").alias("slice"), F.lit(i).alias("i")) for i, s in enumerate(shares)))
    rows = frame.join(edges, "fold_cutoff").withColumn("_s", F.explode(labels))
    return rows.filter(F.col("actual") >= F.col("_edges")[F.col("_s.i")]).withColumn("slice", F.col("_s.slice")).groupBy("fold_cutoff", "slice").agg(*score())


def improvement(scores: DataFrame, greater_is_better: bool = False) -> DataFrame:
    """A leaderboard from model, is_baseline, primary_value: rank, the best baseline, the gain over it."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("primary_value").isNull(), F.desc("primary_value") if greater_is_better else F.asc("primary_value"), "model")
    best = scores.filter("is_baseline AND primary_value IS NOT NULL").agg((F.max_by if greater_is_better else F.min_by)(F.struct("model", "primary_value"), F.struct("primary_value", "model")).alias("_b"))
    # One row a model: a few dozen rows, so one window over all of them is no bottleneck.
    out = scores.withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(best))
    gain = (F.col("primary_value") - F.col("_b.primary_value")) * (1 if greater_is_better else -1)
    known = F.col("_b.primary_value") != 0
    return out.select("model", "is_baseline", "primary_value", "rank", F.when(known, F.col("_b.model")).alias("baseline_model"), F.when(known, F.round(gain / F.abs("_b.primary_value"), 4)).alias("improvement_vs_baseline"))
