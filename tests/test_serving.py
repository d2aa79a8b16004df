"""Bundles, backtests and kept tables on small data."""

import pytest
from pyspark.sql import functions as F

from leadtide.operators import models, quality, serving
from leadtide.sources import artifacts, shared


@pytest.fixture(scope="module")
def lessons(spark):
    rows = spark.range(200)
    features = {c: (F.col("id") * (i + 3) % 17).cast("double") for i, c in enumerate(models.FEATURES)}
    return shared.written(rows.withColumns(features | {"days_to_checkin": (F.col("id") % 30 + 1).cast("int"), "remaining_demand": F.col("id") % 11, "city_code": F.col("id").cast("int"), "checkin": F.lit("1999-07-01")}).drop("id"))


def test_bundles_are_refused_for_other_rows(spark, lessons, tmp_path):
    model = models.fit_bands(lessons, trees=2, leaves=4, least=5)
    path = f"file://{tmp_path}/bundle"
    models.save_bundle(model, lessons, path)
    again = models.load_bundle(spark, path, lessons)
    first = lambda m: sorted(r.model_demand for r in m.predict(lessons).select("model_demand").collect())
    assert first(again) == first(model)
    with pytest.raises(ValueError, match="training table"):
        models.load_bundle(spark, path, lessons.limit(199))
    other = models.fit_bands(lessons, features=models.FEATURES[:5], trees=1, leaves=4, least=5)
    models.save_bundle(other, lessons, path)
    with pytest.raises(ValueError, match="other features"):
        models.load_bundle(spark, path, lessons)
    assert models.load_bundle(spark, path, lessons, models.FEATURES[:5]).features == models.FEATURES[:5]


def test_kept_tables_follow_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    artifacts.write_table(spark.range(3), path)
    assert artifacts.current(spark, path).count() == 3 and artifacts.current(spark, path) is artifacts.current(spark, path)
    artifacts.write_table(spark.range(5), path)
    assert artifacts.current(spark, path).count() == 5


def test_outputs_and_files(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert tuple(serving.differences(a, b).first()) == (1, 1)
    assert tuple(quality.overlap(a.filter("k < 2"), b.filter("k > 1"), ["k"], "k").first()) == (False, 0)
    assert tuple(serving.limited(a, ["k"], 2)[1].first()) == (3, True)
    one = serving.constrained(spark.createDataFrame([(float("nan"),), (float("inf"),), (-3.0,), (2.6,), (None,)], "f double"), ["f"], whole=True)
    assert sorted(r.f for r in one.collect()) == [0, 0, 0, 0, 3]


def test_orders_of_quantiles_and_folds(spark):
    from datetime import date

    from leadtide.operators import calibration

    rows = calibration.monotone(spark.createDataFrame([(3.0, 1.0, 2.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert tuple(rows.first()) == (1.0, 2.0, 3.0)
    assert models.time_folds(date(2020, 1, 31), 10, 2)[-1] == (date(2020, 1, 21), date(2020, 1, 22), date(2020, 1, 31))
