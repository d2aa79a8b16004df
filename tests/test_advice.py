"""What a review found missing: each test fails on the code before its change."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtide.config import DEFAULT
from leadtide.operators import calibration, clusters, features, marts, models
from leadtide.plans.base import log

SF = "/root/testdata/sf0.001"


def test_training_window_is_the_references(spark):
    got = features.training_counts(log(spark, SF))[0].agg(F.countDistinct("checkin").alias("n"), F.min("checkin").alias("first"), F.max("checkin").alias("last")).first()
    assert got.n == 752 and got.last == DEFAULT.cutoff
    assert (got.last - got.first).days == 751


def test_the_model_is_the_references():
    assert models.PRODUCTION == {"trees": 400, "leaves": 127, "step": 0.06, "least": 40, "rows": 0.9, "columns": 0.8}
    assert len(models.FEATURES) == 66 and models.BANDS == ((1, 14), (15, 30))


def test_frames_have_place_and_origin_history(spark):
    wanted = {"lat", "long", "city_weekday_mean", *features.HISTORY}
    assert wanted <= set(models.FEATURES)
    data = log(spark, SF)
    for frame in (features.training_frame(data), features.inference_frame(data)):
        assert wanted <= set(frame.columns)
    # At the cutoff the statistics are those of the whole history.
    now = {r.city_code: r for r in features.city_history(data).collect()}
    for r in features.inference_frame(data).select("city_code", "checkin", "lat", "city_hist_mean", "city_hist_p90").distinct().collect():
        assert abs(r.city_hist_mean - now[r.city_code].city_hist_mean) < 1e-9 and r.city_hist_p90 == now[r.city_code].city_hist_p90 and r.lat > 24


def test_cluster_block_needs_virtual_cities(spark):
    rows = spark.createDataFrame([(1,), (2,)], "city_code int")
    table = spark.createDataFrame([(1, 3, 5, 0.5)], "cluster_code int, n_cities_in_cluster long, cluster_min_member_volume long, cluster_max_member_share double")
    assert {tuple(r) for r in features.with_clusters(rows, table).collect()} == {(1, 3.0, 5.0, 0.5), (2, None, None, None)}
    with pytest.raises(ValueError, match="member_share"):
        features.with_clusters(rows, table.drop("cluster_max_member_share"))


def test_ward_needs_memory_for_points_only():
    points = np.random.default_rng(3).normal(size=(1500, 16))
    tracemalloc.start()
    merges = clusters.ward(points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 1499 and peak < 1500 * 1500 * 8
    heights = [m[2] for m in merges]
    assert heights == sorted(heights) and sorted(x for m in merges for x in m[:2]) == list(range(2 * 1500 - 2))


def test_bootstrap_of_many_folds_draws_samples(spark):
    scores = spark.createDataFrame([(100.0 + k, 0.1 + k / 100) for k in range(8)], "actual_total double, wape double")
    got, again = (calibration.fold_bootstrap(scores, 8).first() for _ in range(2))
    assert got == again and got.samples == 20_000
    assert 0.1 < got.lower < 0.135 < got.upper < 0.17
    other = calibration.fold_bootstrap(scores.limit(3), 3).first()
    assert other.samples == 27


def test_city_table_sums_in_ranges(spark):
    forecast = spark.range(500).select(F.col("id").cast("int").alias("city_code"), F.lit("c").alias("city"), F.lit("p").alias("province"), (F.col("id") % 97).alias("predicted_demand"), F.lit(0).cast("long").alias("observed_so_far"), F.lit(0).cast("long").alias("predicted_remaining"))
    momentum = spark.createDataFrame([(1, 1.0)], "city_code int, pickup_ratio double")
    history = spark.createDataFrame([(1, 1)], "city_code int, demand long")
    found = marts.city_table(forecast, momentum, history)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(found.collect(), key=lambda r: (-r.predicted_demand, r.city_code))
    total = 0.0
    for r in rows:
        total += r.share
        assert abs(r.cumulative_share - total) < 1e-9
    # The one window without a partition goes over the ranges.
    assert all("_own" in x for x in plan.splitlines() if x.strip(" +-:").startswith("Window") and "city_code" not in x) and "[_range#" in plan
