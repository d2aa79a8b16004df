"""Searches within a budget, runs that are taken up again, digests of files, the Jalali year before."""

import hashlib
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from leadtide.functions.calendar import jalali_parts, prior_jalali
from leadtide.operators import search
from leadtide.sources import artifacts


@pytest.fixture(scope="module")
def window(spark):
    lessons = spark.range(50).select("id", F.lit(10.0).alias("x"))
    held = spark.range(40).select("id", (F.col("id") + 1).cast("double").alias("x"), (2.0 * (F.col("id") + 1)).alias("actual"))
    return lessons, held


def times(params, budget):
    if params.get("fails"):
        raise RuntimeError("no such model")
    return lambda lessons, ahead: ahead.filter("id < 39 OR " + str(not params.get("drops", False))).withColumn("prediction", F.col("x") * params["k"])


def test_halving_finds_the_best_and_drops_failures(window):
    found = search.halving(times, [{"k": 1.5}, {"k": 2.1}, {"k": 2.0, "drops": True}, {"k": 2.0, "fails": True}, {"k": 5.0}], {"k": 1.0}, *window, ["id"], budgets=(1, 2))
    assert found.improved and found.params["k"] == 2.1 and abs(found.wape - 0.05) < 1e-9 and abs(found.default_wape - 0.5) < 1e-9
    assert [(t.trial, t.rung) for t in found.trials] == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (2, 1)]
    assert {t.trial: t.reason for t in found.trials if t.wape is None} == {3: "no finite score", 4: "RuntimeError: no such model"}
    worse = search.halving(times, [{"k": 0.5}], {"k": 1.0}, *window, ["id"], budgets=(1,))
    assert not worse.improved and worse.params == {"k": 1.0} and worse.reason == "nothing beat the defaults"
    bad = search.halving(times, [], {"k": 1.0, "fails": True}, *window, ["id"], budgets=(1,))
    assert bad.wape is None and "RuntimeError" in bad.reason
    assert "fewer than" in search.halving(times, [], {"k": 1.0}, window[0], window[1].limit(5), ["id"]).reason


def test_a_slow_fit_ends_with_the_best_so_far(window):
    def slow(params, budget):
        if params["k"] == 3.0:
            time.sleep(60)
        return times(params, budget)

    start = time.monotonic()
    found = search.halving(slow, [{"k": 1.9}, {"k": 3.0}], {"k": 1.0}, *window, ["id"], budgets=(1, 2), minutes=0.3)
    assert time.monotonic() - start < 45 and found.improved and found.params["k"] == 1.9 and found.reason.startswith("out of time")


def test_draws_and_split(spark):
    points = search.drawn(search.TREES, 50)
    assert points == search.drawn(search.TREES, 50) and all(31 <= p["leaves"] <= 255 and 0.02 <= p["step"] <= 0.12 and isinstance(p["least"], int) for p in points)
    days = spark.range(20).select(F.expr("date_add(DATE '2024-01-01', cast(id AS int))").alias("d"))
    before, after = search.time_split(days, "d", 5)
    assert before.count() == 15 and after.agg(F.min("d")).first()[0] == date(2024, 1, 16)


def test_arms_are_taken_up_where_a_run_broke_off(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")
    made = []

    def arm(name, fails=False):
        def make():
            if fails:
                raise RuntimeError("killed")
            made.append(name)
            return spark.range(len(name)).withColumn("arm", F.lit(name))

        return make

    contract = lambda: {"input": artifacts.input_digest(spark, f"file://{tmp_path}/in"), "cutoffs": [date(2024, 1, 1)]}
    path = f"file://{tmp_path}/run"
    with pytest.raises(RuntimeError, match="killed"):
        artifacts.run_arms(spark, path, contract(), {"one": arm("one"), "three": arm("three", True), "x": arm("x")})
    found = artifacts.run_arms(spark, path, contract(), {"one": arm("one"), "three": arm("three"), "x": arm("x")})
    assert made == ["one", "three", "x"] and {k: v.count() for k, v in found.items()} == {"one": 3, "three": 5, "x": 1}
    # Another version of one arm: that one is made again; then all stand.
    for _ in range(2):
        artifacts.run_arms(spark, path, contract(), {"one": arm("one"), "x": arm("x")}, {"one": "v2"})
    assert made == ["one", "three", "x", "one"]
    (tmp_path / "in" / "a.csv").write_text("x\n2\n")
    with pytest.raises(ValueError, match="another contract"):
        artifacts.run_arms(spark, path, contract(), {"one": arm("one")})


def test_file_digests_in_chunks(spark, tmp_path):
    files = {"a.bin": b"abcdefghij", "b.bin": b"", "sub/c.bin": b"x" * 7}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.split(f"{tmp_path}/")[1]: (r.bytes, r.sha256) for r in artifacts.file_digests(spark, f"file://{tmp_path}", 4).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {n: (len(c), sha("".join(sha(c[i : i + 4]) for i in range(0, len(c), 4)).encode())) for n, c in files.items() if c}
    assert got == want


def test_prior_jalali_day(spark):
    days = spark.sql("SELECT explode(sequence(DATE '1990-01-01', DATE '2030-01-01')) AS d").withColumn("p", prior_jalali("d"))
    y, m, n = jalali_parts("d")
    y2, m2, n2 = jalali_parts("p")
    rows = days.select("d", "p", y.alias("y"), m.alias("m"), n.alias("n"), y2.alias("y2"), m2.alias("m2"), n2.alias("n2")).collect()
    assert all(r.y2 == r.y - 1 and r.m2 == r.m and (r.n2 == r.n or (r.m, r.n, r.n2) == (12, 30, 29)) for r in rows)
    assert sum(r.n2 != r.n for r in rows) >= 9  # leap days
