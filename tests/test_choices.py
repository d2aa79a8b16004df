"""Choices as frames against the same choices over plain numbers, and their edge cases."""

from leadtide.operators import calibration, choices

SCORES = {"raw": {"a": (0.2, 10.0), "b": (0.3, 10.0), "c": (0.2, 10.0)}, "cal": {"a": (0.1, 10.0), "b": (0.1, 10.0), "c": (0.5, 10.0)}, "same": {"a": (0.2, 10.0), "b": (0.3, 10.0), "c": (0.2, 10.0)}}
SCHEMA = "method string, fold_cutoff string, wape double, actual_total double"


def frame(spark, scores=SCORES):
    return spark.createDataFrame([(m, f, w, d) for m, own in scores.items() for f, (w, d) in own.items()], SCHEMA)


def test_prequential_folds_equal_the_plain_choice(spark):
    want, wape = calibration.prequential(SCORES, "raw")
    found = choices.prequential_folds(frame(spark), "raw")
    assert sorted((r.fold_cutoff, r.method) for r in found.collect()) == want
    assert abs(choices.pooled_wape(found).first().wape - wape) < 1e-12
    # A fold without demand adds nothing; ties go to the fallback; no scores give no folds.
    empty = spark.createDataFrame([("raw", "a", None, 0.0), ("cal", "a", None, 0.0), ("raw", "b", 0.2, 5.0), ("cal", "b", 0.1, 5.0)], SCHEMA)
    assert sorted((r.fold_cutoff, r.method) for r in choices.prequential_folds(empty, "raw").collect()) == [("a", "raw"), ("b", "raw")]
    assert choices.prequential_folds(empty.filter("false"), "raw").count() == 0


def test_safe_methods_equal_the_plain_choice(spark):
    for most in (0, 1, 3):
        found = {r.method: r.replaces for r in choices.safe_methods(frame(spark), "raw", most_worse=most).collect()}
        plain = {m: {f: w for f, (w, _) in own.items()} for m, own in SCORES.items()}
        assert found == {m: calibration.safe_choice(plain[m], plain["raw"], most_worse=most) for m in ("cal", "same")}


def test_model_weights_equal_the_plain_ones(spark):
    for errors in ({"a": 0.1, "b": 0.12, "c": 0.5, "d": float("nan"), "e": None, "f": 0.0}, {"a": 0.2}, {m: 0.1 + 0.001 * i for i, m in enumerate("abcdefg")}):
        df = spark.createDataFrame(list(errors.items()), "model string, wape double")
        found = {r.model: r.weight for r in choices.model_weights(df, "model", "wape").collect()}
        want = calibration.ensemble_weights(errors)
        assert found.keys() == want.keys() and all(abs(found[m] - w) < 1e-12 for m, w in want.items())
    assert choices.model_weights(df.filter("false"), "model", "wape").count() == 0


def test_health_of_findings(spark):
    findings = spark.createDataFrame([("x", 3), ("y", 0), ("z", 1), ("unknown", 2)], "rule string, count long")
    assert tuple(choices.health_of(findings, {"x": "critical", "y": "critical", "z": "medium"}).first()) == (3, 69, "C")
    assert tuple(choices.health_of(findings.filter("false"), {"x": "low"}).first()) == (0, 100, "A")
