"""Choices between methods as small frames: per fold, against a baseline, and as weights.

Scores have one row a method and fold, so every frame here is as small as that; the work is in making them.
Folds sort by their cutoff. A null WAPE (a fold without demand) adds nothing to an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtide.operators.quality import GRADES, PENALTY


def prequential_folds(scores: DataFrame, fallback: str, fold: str = "fold_cutoff") -> DataFrame:
    """fold, method, wape, actual_total: the method each fold would have used, chosen on the folds before it.

    scores: method, fold, wape, actual_total. The first fold uses ``fallback``; ties go to it, then by name.
    """
    before = Window.partitionBy("method").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    error = F.sum(F.col("wape") * F.col("actual_total")).over(before)
    pooled = scores.withColumn("_pooled", error / F.greatest(F.sum("actual_total").over(before), F.lit(1e-9)))
    # Without a fold before it every method's pooled error is null, and the fallback is the least.
    order = F.struct(F.coalesce("_pooled", F.lit(0.0)), (F.col("method") != fallback).cast("int"), F.col("method"))
    best = pooled.groupBy(fold).agg(F.min_by(F.struct("method", "wape", "actual_total"), order).alias("_b"))
    return best.select(fold, "_b.*")


def pooled_wape(chosen: DataFrame) -> DataFrame:
    """One row: the folds, and the WAPE over all of them."""
    return chosen.agg(F.count(F.lit(1)).alias("folds"), (F.sum(F.col("wape") * F.col("actual_total")) / F.greatest(F.sum("actual_total"), F.lit(1e-9))).alias("wape"))


def safe_methods(scores: DataFrame, baseline: str, most_worse: int = 1, least_gain: float = 0.01, fold: str = "fold_cutoff") -> DataFrame:
    """method, mean_wape, folds_worse, replaces: which methods may replace the baseline.

    One may if it is better on average by ``least_gain`` and worse on at most ``most_worse`` folds.
    """
    base = scores.filter(F.col("method") == baseline).select(fold, F.col("wape").alias("_base"))
    both = scores.filter(F.col("method") != baseline).join(base, fold)
    out = both.groupBy("method").agg(F.avg("wape").alias("mean_wape"), F.count_if(F.col("wape") > F.col("_base")).alias("folds_worse"), F.avg("_base").alias("_mean"))
    return out.withColumn("replaces", (F.col("folds_worse") <= most_worse) & (F.col("mean_wape") <= (1 - least_gain) * F.col("_mean"))).drop("_mean")


def model_weights(scores: DataFrame, model: str, error: str, worst: float = 1.35, top: int = 5, least: float = 0.02) -> DataFrame:
    """model, weight: weights that fall with a model's error over the best one's.

    Models over ``worst`` times the best one's error get none, the ``top`` best are kept, and weights below
    ``least`` are left out unless all are. Errors that are null, not finite or not positive take no part.
    """
    known = scores.filter((F.col(error) > 0) & (F.col(error) < float("inf")) & ~F.isnan(error))
    all_of = known.agg(F.array_sort(F.collect_list(F.struct(F.col(error).alias("e"), F.col(model).alias("m")))).alias("s"))
    ratio = F.transform(F.slice("s", 1, top), lambda x: F.struct(x.m.alias("m"), (x.e / F.col("s")[0].e).alias("r")))
    raw = F.transform(F.filter(ratio, lambda x: x.r <= worst), lambda x: F.struct(x.m.alias("m"), F.exp(-4 * (x.r - 1)).alias("w")))

    def shares(name: str):
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x.w)
        return F.transform(name, lambda x: F.struct(x.m.alias("m"), (x.w / total).alias("w")))

    out = all_of.filter(F.size("s") > 0).select(raw.alias("raw")).select(shares("raw").alias("raw"))
    kept = F.filter("raw", lambda x: x.w >= least)
    out = out.select(F.when(F.size(kept) > 0, kept).otherwise(F.col("raw")).alias("kept"))
    return out.select(F.explode(shares("kept")).alias("x")).select(F.col("x.m").alias(model), F.col("x.w").alias("weight"))


def health_of(findings: DataFrame, severity: dict[str, str]) -> DataFrame:
    """One row: broken_rules, score, grade. findings: rule, count; rules without a severity cost nothing."""
    cost = F.coalesce(F.create_map(*(F.lit(x) for rule, s in severity.items() for x in (rule, PENALTY[s])))[F.col("rule")], F.lit(0))
    broken = F.col("count") > 0
    out = findings.agg(F.count_if(broken).alias("broken_rules"), F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.when(broken, cost)), F.lit(0))).cast("int").alias("score"))
    grade = F.lit(GRADES[-1][1])
    for floor, name in reversed(GRADES):
        grade = F.when(F.col("score") >= floor, name).otherwise(grade)
    return out.withColumn("grade", grade)
