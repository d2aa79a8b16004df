"""Virtual cities: the pooled log against the log of cities, checks of the output, choices of level and shrinkage."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.operators import asof, clusters, curves, features, models, pooling
from leadtide.sources.tables import Log

SF = "/root/testdata/sf0.001"
PANEL = "cluster_code int, checkin string, actual long, predicted_demand double"


@pytest.fixture(scope="module")
def data(spark):
    return Log(spark, SF, C)


@pytest.fixture(scope="module")
def profiles(data):
    from leadtide.sources.shared import written

    return written(clusters.city_profiles(data))


def halves(data):
    return data.cities.select("city_code", F.min("city_code").over(Window.partitionBy("province_code")).alias("cluster_code"))


def test_pooled_log_conserves_demand(data, profiles):
    mapping = halves(data)
    pooled = pooling.PooledLog(data, mapping, pooling.virtual_cities(profiles, mapping, data.cities))
    for own, whole, value in ((pooled.pairs, data.pairs, "final"), (pooled.sums, data.sums, "total"), (pooled.sums, data.sums, "known"), (pooled.all, data.all, "search_count")):
        assert own.agg(F.sum(value)).first()[0] == whole.agg(F.sum(value)).first()[0] > 0
    assert pooled.pairs.groupBy("city_code", "checkin").count().filter("count > 1").count() == 0


def test_cities_by_themselves_are_the_panel_of_cities(data, profiles):
    mapping = data.cities.select("city_code", F.col("city_code").alias("cluster_code"))
    key = lambda r: tuple(r)
    mine = sorted(map(key, pooling.pooled_forecast(data, mapping, profiles).select("cluster_code", "checkin", "observed", "predicted_demand", "actual").collect()))
    city = sorted(map(key, curves.pickup_forecast(data, asof.fold_frame(data)).select("city_code", "checkin", "observed", "predicted_demand", "actual").collect()))
    assert mine == city


def test_fit_panel_hands_the_cluster_block_to_its_spec(data, profiles):
    mapping, seen = halves(data), {}

    def spec(lessons, ahead):
        seen.update(lessons=lessons.columns, ahead=ahead.columns, empty=lessons.filter("n_cities_in_cluster IS NULL").count())
        return models.baseline_spec(lessons, ahead)

    panel = pooling.fit_panel(data, mapping, profiles, spec)
    assert set(features.CLUSTER) <= set(seen["lessons"]) & set(seen["ahead"]) and seen["empty"] == 0
    assert panel.count() == mapping.select("cluster_code").distinct().count() * C.target_days
    assert panel.filter("predicted_demand < observed OR predicted_demand IS NULL").count() == 0


def test_output_checks_find_each_fault(spark):
    mapping = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "city_code int, cluster_code int")
    city = spark.createDataFrame([(c, "d", 2) for c in (1, 2, 3)], "city_code int, checkin string, observed long")
    schema = "cluster_code int, checkin string, name string, observed long, predicted_demand double"
    right = [(1, "d", "a", 4, 5.0), (3, "d", "b", 2, 2.0)]
    faults = {
        None: right, "missing_pair": right[:1], "unknown_pair": [*right, (9, "d", "c", 0, 0.0)], "duplicate_pair": [*right, right[0]], "not_finite": [(1, "d", "a", 4, float("nan")), right[1]],
        "below_observed": [(1, "d", "a", 4, 3.0), right[1]], "without_name": [(1, "d", None, 4, 5.0), right[1]], "observed_not_conserved": [(1, "d", "a", 3, 5.0), right[1]],
    }
    for fault, rows in faults.items():
        found = {r.rule for r in pooling.output_checks(spark.createDataFrame(rows, schema), city, mapping).collect() if r["count"]}
        assert found == ({fault} if fault else set())
    empty = pooling.output_checks(spark.createDataFrame([], schema), city, mapping).collect()
    assert {r.rule: r["count"] for r in empty}["missing_pair"] == 2


def test_arms_that_lose_rows_are_not_conserved(spark):
    one = spark.createDataFrame([(1, "a", 4, 5.0), (1, "b", 6, 6.0)], PANEL)
    lost = one.filter("checkin = 'a'")
    found = {r.arm: r for r in pooling.arm_scores({"x": one, "y": one.withColumn("predicted_demand", F.col("actual") * 2.0), "z": lost}).collect()}
    assert [found[a].conserved for a in "xyz"] == [True, True, False]
    assert {a: found[a].n for a in "xyz"} == {"x": 1, "y": 1, "z": 1} and found["x"].wape == 0.25 and found["y"].wape == 1.0


@pytest.mark.parametrize("wapes", [{1: 0.5, 2: 0.4, 5: 0.399}, {1: 0.5, 2: 0.499, 5: 0.498}, {1: 0.3, 2: 0.4, 5: 0.5}, {1: 0.5, 2: 0.45, 5: 0.3}])
def test_chosen_level_equals_the_plain_choice(spark, wapes):
    rows = [("f", level, s, w * 10, 10.0, w * 10 + s) for level, w in wapes.items() for s in (0.0, 1.0)]
    errors = spark.createDataFrame(rows, "fold_cutoff string, level int, shrinkage double, pooled double, actual double, blended double")
    assert [r.level for r in pooling.chosen_levels(errors).collect() if r.chosen] == [clusters.choose_level(wapes)]
    assert [r.shrinkage for r in pooling.chosen_shrinkage(errors, 2).collect() if r.chosen] == [0.0]
    assert pooling.chosen_levels(errors.filter("false")).count() == 0


def test_blend_takes_its_shrinkage_from_a_column(data, profiles):
    mapping = halves(data)
    city = curves.pickup_forecast(data, asof.fold_frame(data))
    pooled = clusters.pooled_panel(city, mapping).withColumn("predicted_demand", F.col("predicted_demand") * 1.1)
    pick = lambda x: sorted(map(tuple, x.select("city_code", "checkin", "blended_demand").collect()))
    assert pick(clusters.blended(city.withColumn("s", F.lit(500.0)), pooled, profiles, mapping, "s")) == pick(clusters.blended(city, pooled, profiles, mapping, 500.0))


def test_the_sweep_scans_the_events_once_and_drops_what_it_wrote(spark, data, monkeypatch):
    """All cutoffs share one log, and no plan holds more than a level, so the driver's memory doesn't grow with levels and cutoffs."""
    from pathlib import Path

    from leadtide.plans import pooling as plans
    from leadtide.sources import shared

    made, kept = [], len(list(Path(shared._folder(spark).removeprefix("file:")).glob("*")))
    monkeypatch.setattr(pooling, "written", lambda df: made.append(df) or shared.written(df))
    rows = pooling.sweep([plans.folds(spark, SF)], {b: plans._by_code(b) for b in (1, 5)}, (0.0, 10.0), clusters.city_volumes)
    found = {(r.fold_cutoff, r.level, r.shrinkage): r for r in rows.collect()}
    assert set(found) == {(str(c), b, s) for c in C.fold_cutoffs for b in (1, 5) for s in (0.0, 10.0)} and all(r.conserved for r in found.values())
    assert all(r.single == r.blended for (_, b, s), r in found.items() if b == 1 or s == 0)
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert not any("lineitem" in f for df in made for f in df.inputFiles())
    # The whole log's two groupings and the errors of two levels stay.
    assert len(list(Path(shared._folder(spark).removeprefix("file:")).glob("*"))) - kept == 4


def test_the_panel_forecast_is_the_pickup_forecast(spark):
    from leadtide.plans.base import folds

    data, names = folds(spark, SF), ("fold_cutoff", "city_code", "checkin", "horizon", "observed", "predicted_demand", "actual")
    pick = lambda x: sorted(map(tuple, x.select(*names).collect()))
    assert pick(curves.panel_forecast(data)) == pick(curves.pickup_forecast(data, asof.fold_frame(data)))
