import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtide.operators.order import order_statistics, quantiles


def _groups():
    draw = random.Random(5)
    return {
        "even": [draw.random() for _ in range(900)],
        "one value": [7.0] * 800,
        "ties and tails": [3.0] * 700 + [3.0 + 1e-13 * i for i in range(60)] + [1e300, -1e300, 5e-324, 0.0, -0.0],
        "powers": [s * 2.0**k for k in range(-1000, 1000, 7) for s in (1, -1)],
        "close": [1.0 + k * 2.0**-52 for k in range(600)] + [float("inf"), float("-inf")],
        "few": [2.0, 1.0],
        None: [float(i % 40) for i in range(500)],
    }


@pytest.mark.parametrize("few", [20, 100_000])
def test_ranks_are_those_of_the_sorted_values(spark, few):
    rows = [(g, v) for g, x in _groups().items() for v in x]
    random.Random(1).shuffle(rows)
    rows += [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = [0, 1, 2, 17, 350, 351, 777, 900, 10**9]
    found = {r.g: r for r in order_statistics(df, ["g"], "v", lambda n: F.array(*(F.lit(k) for k in at), n), few).collect()}
    assert set(found) == {*_groups(), "none"}
    assert found["none"].n == 0 and set(found["none"]["values"]) == {None}
    for g, x in _groups().items():
        x = sorted(x)
        assert found[g].n == len(x)
        assert found[g]["values"] == [x[k - 1] if 1 <= k <= len(x) else None for k in (*at, len(x))], g


def test_quantiles_are_those_of_the_whole(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.lognormal(0, 4, 3000), -draw.lognormal(0, 2, 500), np.zeros(900)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    one = quantiles(df, [], "v", points, few=30).first()
    assert one.n == len(x)
    assert np.allclose(one.q, np.quantile(x, points), rtol=1e-12, atol=0)
    assert one.q == df.agg(F.percentile("v", F.array(*map(F.lit, points))).alias("q")).first().q
    empty = quantiles(df.filter("v IS NULL"), [], "v", points).collect()
    assert [(r.n, r.q) for r in empty] == [(0, [None] * len(points))]
    assert quantiles(df.filter("v IS NULL").withColumn("g", F.lit(1)), ["g"], "v", points).collect() == []
    assert math.isclose(quantiles(df.limit(1), [], "v", (0.3,)).first().q[0], df.first().v)
