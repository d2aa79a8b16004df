"""Operators on small hand-made logs and panels: leakage, conservation, contracts, known values."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leadtide.config import Config
from leadtide.functions import calendar, text
from leadtide.operators import asof, calibration, clusters, curves, features, models, panel, quality, signals
from leadtide.plans import base
from leadtide.sources import artifacts, readers
from leadtide.sources.tables import Log

CFG = Config(cutoff=date(2024, 3, 1), target_days=5, min_city_support=30, min_province_support=60, train_window_days=20, history_days=40, fold_cutoffs=(date(2024, 2, 10), date(2024, 3, 1)))


def small_log(spark, poison: bool = False) -> Log:
    rows = []
    for city in range(4):
        for d in range(60):
            checkin = date(2024, 1, 10) + timedelta(days=d)
            for lead in range(0, 12, 1 + city):
                log_date = checkin - timedelta(days=lead)
                n = 1 + (city * 7 + d * 3 + lead) % 5
                if poison and log_date > CFG.cutoff:
                    n = 9999
                rows.append((log_date, city, checkin, n, lead))
    log = Log.__new__(Log)
    log.spark, log.cfg, log.folds = spark, CFG, (CFG.cutoff,)
    log.all = spark.createDataFrame(rows, "log_date date, city_code int, checkin date, search_count long, days_to_checkin int")
    log.cities = spark.createDataFrame([(c, c % 2, 30.0 + c, 50.0, f"City {c}", f"P{c % 2}") for c in range(5)], "city_code int, province_code int, lat double, long double, city string, province string")
    return log


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("make", [lambda x: curves.pickup_forecast(x), lambda x: curves.all_curves(x), lambda x: curves.zero_prior(x), lambda x: features.inference_frame(x).select("city_code", "checkin", "observed_total", "pickup_surprise", "market_observed_total"), lambda x: features.city_history(x)])
def test_nothing_after_the_cutoff_counts(spark, make):
    assert rows_of(make(small_log(spark))) == rows_of(make(small_log(spark, poison=True)))


def test_curves_fall_from_one_and_forecasts_keep_the_floor(spark):
    log = small_log(spark)
    for r in curves.all_curves(log).filter("days_to_checkin = 0").collect():
        assert r.completion_fraction == 1.0
    assert curves.all_curves(log).groupBy("level", "key").agg(F.max("completion_fraction").alias("m")).filter("m > 1").count() == 0
    assert curves.pickup_forecast(log).filter("predicted_demand < observed").count() == 0
    assert curves.pickup_forecast(log, zero_policy="zero").filter("observed = 0 AND predicted_demand <> 0").count() == 0
    with pytest.raises(ValueError):
        curves.pickup_forecast(log, zero_policy="guess")


def test_pair_state_adds_up(spark):
    log = small_log(spark)
    grid = asof.complete_grid(log.cities.select("city_code"), date(2024, 2, 1), date(2024, 2, 5))
    state = asof.pair_state(grid, log.all)
    assert state.count() == 25
    assert state.filter(F.element_at("cum", 1) != F.aggregate("daily", F.lit(0).cast("long"), lambda a, x: a + x)).count() == 0
    assert state.filter(F.element_at("cum", 61) != 0).count() == 0


def test_demand_buckets_with_tied_edges(spark):
    rows = spark.createDataFrame([(0.0,)] * 6 + [(float(i),) for i in range(1, 5)], "actual double")
    found = {r.actual: r.demand_bucket for r in asof.demand_bucket(rows, "actual", (0.0, 0.5, 0.75, 0.9, 0.99, 1.0)).collect()}
    assert found[0.0] == "q0.00-0.50" and found[4.0] == "q0.90-0.99"  # one edge fewer: labels shift
    alike = spark.createDataFrame([(1.0,)] * 3, "actual double")
    assert {r.demand_bucket for r in asof.demand_bucket(alike, "actual", (0.0, 0.5, 1.0)).collect()} == {"all"}


def test_jalali_dates(spark):
    known = {date(2024, 3, 20): (1403, 1, 1), date(2021, 3, 20): (1399, 12, 30), date(2025, 12, 21): (1404, 9, 30), date(1979, 2, 11): (1357, 11, 22)}
    df = spark.createDataFrame([(d,) for d in known], "d date")
    y, m, n = calendar.jalali_parts("d")
    for r in df.select("d", y.alias("y"), m.alias("m"), n.alias("n"), calendar.from_jalali(y, m, n).alias("back")).collect():
        assert (r.y, r.m, r.n) == known[r.d] and r.back == r.d


def test_lenient_dates_and_digits(spark):
    cases = {"۱۴۰۳/۰۱/۰۱": date(2024, 3, 20), "2024-03-20": date(2024, 3, 20), "20/03/2024": date(2024, 3, 20), "1403-13-01": None, "x": None, None: None}
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    assert {r.t: r.d for r in df.select("t", text.lenient_date("t").alias("d")).collect()} == cases
    assert text.role_scores(["Check-in Date", "listing_id", "nightly_price"])["price"][0][0] == "nightly_price"


def test_interpolation_and_fills(spark):
    df = spark.createDataFrame([("a", date(2024, 1, i), v) for i, v in ((1, None), (2, 2.0), (3, None), (4, 6.0), (5, None))], "entity_id string, ds date, p double")
    assert [r.p for r in panel.interpolate(df, "p").orderBy("ds").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0]
    assert [r.p for r in panel.fill_both_ways(df, ["p"]).orderBy("ds").collect()] == [2.0, 2.0, 2.0, 6.0, 6.0]


def test_roll_up_conserves(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1), 1.0, 1), ("b", date(2024, 1, 1), 2.0, 1), ("c", date(2024, 1, 2), 4.0, 2)], "entity_id string, ds date, forecast double, horizon int")
    mapping = spark.createDataFrame([("a", "x", "all"), ("b", "x", "all")], "entity_id string, destination_id string, market_id string")
    stacked = panel.all_levels(df, mapping, {"destination": "destination_id", "market": "market_id"})
    assert {r.level: r.pct_diff for r in panel.coherence(stacked, "forecast").collect()} == {"destination": 0.0, "market": 0.0}
    assert {r.entity_id for r in stacked.filter("level = 'destination'").collect()} == {"x", "unknown"}


def test_spike_found_and_weekly_cycle_ignored(spark):
    start = date(2024, 1, 1)
    rows = [("a", start + timedelta(days=i), 60.0 if i == 45 else 10.0 + 0.01 * (i % 3), 10.0) for i in range(90)]
    found = signals.residual_anomalies(spark.createDataFrame(rows, "entity_id string, ds date, actual double, prediction double")).filter("severity = 'high'").collect()
    assert [(r.ds, r.type) for r in found] == [(start + timedelta(days=45), "spike")]
    past = spark.createDataFrame([("a", start + timedelta(days=i), 30.0 if i % 7 == 4 else 10.0) for i in range(70)], "entity_id string, ds date, y double")
    ahead = spark.createDataFrame([("a", start + timedelta(days=70 + i), 30.0 if (70 + i) % 7 == 4 else 10.0) for i in range(14)], "entity_id string, ds date, forecast double")
    assert signals.peak_runs(ahead, past).count() == 0


def test_censored_demand_is_never_below_what_was_seen(spark):
    start = date(2024, 1, 1)
    rows = [("a", start + timedelta(days=i), 10.0 if i % 4 == 0 else 4.0, 10.0) for i in range(70)]
    marked = signals.censored(spark.createDataFrame(rows, "entity_id string, ds date, y double, capacity double"))
    assert marked.filter("is_censored").count() == 18
    assert signals.unconstrained(marked).filter("estimate < y").count() == 0


def test_ward_cuts(spark):
    import numpy as np

    merges = clusters.ward(np.array([[0.0], [0.1], [5.0], [5.1], [20.0]]))
    assert {frozenset(m[:2]) for m in merges[:2]} == {frozenset((0, 1)), frozenset((2, 3))}
    assert [m[2] for m in merges] == sorted(m[2] for m in merges)
    cities = spark.createDataFrame([(i,) for i in range(5)], "city_code int")
    tree = spark.createDataFrame([(0, 1, 0, 0.1, 2), (0, 3, 2, 0.1, 2), (0, 2, 0, 9.0, 4)], clusters.MERGES)
    assert {r.city_code: r.cluster_code for r in clusters.cut(cities, tree, 1.0).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {r.cluster_code for r in clusters.cut(cities, tree, 10.0).collect()} == {0, 4}


def test_calibration_guards(spark):
    rows = [(h, 100, 200.0, 130 if h > 7 else 200, CFG.cutoff) for h in range(1, 31)]
    frame = spark.createDataFrame(rows, "horizon int, observed long, predicted_demand double, actual long, fold_cutoff date")
    cfg = Config(calibration_shrinkage=0.0)
    found = {r.bucket: r.factor for r in calibration.calibrator(frame, cfg, "guarded_bias_horizon").collect()}
    assert found["1-3"] == found["4-7"] == 1.0 and found["22-30"] == 0.95
    assert calibration.calibrated(frame, calibration.calibrator(frame, cfg, "horizon"), cfg).filter("calibrated_demand < observed").count() == 0
    with pytest.raises(ValueError):
        calibration.calibrator(frame, cfg, "best")


def test_ensemble_weights():
    w = calibration.ensemble_weights({"a": 0.1, "b": 0.12, "c": 0.5, "d": float("nan")})
    assert set(w) == {"a", "b"} and abs(sum(w.values()) - 1) < 1e-12 and w["a"] > w["b"]


def test_models_floor_and_bands(spark):
    log = small_log(spark)
    model = models.fit_bands(features.training_frame(log), ((1, 10), (11, 30)), trees=2, leaves=4, least=5)
    found = model.predict(features.inference_frame(log))
    assert found.count() == 25 and found.filter("model_demand < observed_total").count() == 0
    assert abs(sum(x for _, x in model.importances()) - 1) < 1e-6
    with pytest.raises(Exception, match="no band"):
        models.BandedModel(((1, 2),), model.models[:1]).predict(features.inference_frame(log)).collect()
    assert models.candidates(["naive", "gbt", "tweedie", "lightgbm"]) == ["gbt", "tweedie"]


def test_submission_rules_and_health(spark):
    assert quality.health([]) == (100, "A") and quality.health(["critical", "high", "medium"])[1] == "D"
    keys = spark.createDataFrame([(1, CFG.target_start, 5)], "cluster_code int, checkin date, observed long")
    bad = spark.createDataFrame([(1, str(CFG.target_start), "3"), (2, "2024-99-01", "1")], "cluster_code int, checkin string, predicted_demand string")
    found = {r.rule: r["count"] for r in quality.submission_findings(bad, keys, keys, CFG).collect()}
    assert found["bad_date"] == 1 and found["below_observed"] == 1 and found["missing_pair"] == 0 and found["empty"] == 0


def test_readers_and_artifacts(spark, tmp_path):
    (tmp_path / "log.csv").write_text("city_code,log_date,checkin,search_count,extra\n1,2024-01-01,2024-01-05,3,x\nz,2024-01-02,2024-01-05,4,y\n")
    events = readers.read_events(spark, str(tmp_path / "log.csv"))
    assert events.columns == ["log_date", "city_code", "checkin", "search_count", "days_to_checkin"] and events.filter("city_code IS NULL").count() == 1
    with pytest.raises(ValueError, match="lacks"):
        readers.read_dimension(spark, str(tmp_path / "log.csv"))
    (tmp_path / "semi.csv").write_text("date;n\n2024-01-01;1\n2024-01-02;2\n2024-01-03;4\n")
    df = readers.read_tabular(spark, str(tmp_path / "semi.csv"))
    assert df.columns == ["date", "n"] and readers.Contract("date", target="n").canonical(df).columns == ["ds", "y", "entity_id"]
    with pytest.raises(ValueError):
        readers.read_tabular(spark, str(tmp_path / "x.xls"))
    assert readers.read_holidays(df).count() == 3
    path = f"file://{tmp_path}/run"
    artifacts.write_run(spark, path, {"panel": df}, {"info": {"x": float("nan"), "y": [1.5]}})
    assert artifacts.read_json(spark, f"{path}/info.json") == {"x": None, "y": [1.5]}
    about = artifacts.manifest(df, "n", "date")
    assert artifacts.load_training(spark, f"{path}/panel", about).count() == 3
    with pytest.raises(ValueError):
        artifacts.verify(df.limit(2), about["digest"], "panel")


def test_streaming_ingest_drops_repeats(spark, tmp_path):
    from leadtide.streaming import ingest

    rows = [(date(2024, 1, 1), 1, date(2024, 1, 5), 3), (date(2024, 1, 1), 1, date(2024, 1, 5), 3), (date(2024, 1, 2), 1, date(2024, 1, 5), 2)]
    spark.createDataFrame(rows, readers.EVENTS).write.parquet(f"{tmp_path}/in")
    ingest.append_log(ingest.event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_empty_log(spark):
    log = small_log(spark)
    log.all = log.all.filter("false")
    assert curves.all_curves(log).count() == 0
    assert asof.forecast_grid(log).filter("observed <> 0").count() == 0


def test_registry_names_are_those_of_the_sql():
    from leadtide import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert base.sql("SELECT 1").startswith("WITH ev AS")


def test_choices_look_back_only():
    scores = {"raw": {"a": (0.2, 10), "b": (0.3, 10), "c": (0.2, 10)}, "cal": {"a": (0.1, 10), "b": (0.1, 10), "c": (0.5, 10)}}
    chosen, wape = calibration.prequential(scores, "raw")
    assert chosen == [("a", "raw"), ("b", "cal"), ("c", "cal")] and abs(wape - (0.2 + 0.1 + 0.5) / 3) < 1e-12
    assert calibration.safe_choice({"a": 0.1, "b": 0.2}, {"a": 0.2, "b": 0.3}) and not calibration.safe_choice({"a": 0.3, "b": 0.3}, {"a": 0.2, "b": 0.3})
    assert calibration.interval_choice({"x": (0.81, 9.0), "y": (0.79, 5.0), "z": (0.6, 1.0)}) == "y"
    assert calibration.calibration_cutoffs(date(2024, 3, 1), 30, 2) == [date(2024, 1, 31), date(2024, 1, 1)]
