"""Ward's merges over many tasks against those of one, and cuts by pointers against a plain walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtide.operators import clusters

NAMES = [c for block in clusters.BLOCKS.values() for c in block]


def scaled(spark, points, province, share=0.0):
    rows = [(100 + i, p, share, *map(float, x)) for i, (x, p) in enumerate(zip(points, province, strict=True))]
    return spark.createDataFrame(rows, "city_code int, province_code int, demand_share double, " + ", ".join(f"{c} double" for c in NAMES))


def groups(merges, cities, height):
    """The clusters below a height by walking from each city."""
    to = {m.city_code: m.into for m in merges if m.height <= height}

    def end(x):
        while x in to:
            x = to[x]
        return x

    return {c: end(c) for c in cities}


def test_rounds_give_the_merges_of_one_task(spark):
    points = np.random.default_rng(5).normal(size=(900, len(NAMES)))
    frame = scaled(spark, points, [7] * 900)
    many = clusters.dendrograms(frame, 1.0, block=300).collect()
    want = clusters.ward(points)
    assert len(many) == 899 and len({m.city_code for m in many}) == 899 and all(m.into < m.city_code for m in many)
    np.testing.assert_allclose(sorted(m.height for m in many), [m[2] for m in want], rtol=1e-9)
    assert max(m.n_cities for m in many) == 900
    one = clusters.dendrograms(frame, 1.0, block=5000).collect()
    heights = sorted(m.height for m in many)
    for k in (200, 700, 890):
        at = (heights[k] + heights[k + 1]) / 2
        assert groups(many, range(100, 1000), at) == groups(one, range(100, 1000), at)


def test_provinces_repeats_and_odd_points(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(90, len(NAMES)))
    points[10:40] = points[10]  # thirty cities at one place
    points[88, 3], points[89, 3] = np.nan, np.inf
    province = [1] * 60 + [None] * 25 + [2] * 5
    frame = scaled(spark, points, province)
    for block in (20, 1000):
        got = clusters.dendrograms(frame, 1.0, block=block).collect()
        assert sum(m.province_code == 1 for m in got) == 59 and sum(m.province_code is None for m in got) == 24 and sum(m.province_code == 2 for m in got) == 2
        assert sum(m.height == 0 for m in got) == 29
        want = [m[2] for rows in (points[:60], points[60:85], points[85:88]) for m in clusters.ward(rows)]
        np.testing.assert_allclose(sorted(m.height for m in got), sorted(want), rtol=1e-9, atol=1e-12)
    assert clusters.dendrograms(frame.filter("false"), 1.0).count() == 0
    assert clusters.dendrograms(scaled(spark, points[:5], [1] * 5, 0.5), 0.1).count() == 0


@pytest.mark.parametrize("length", [1, 2, 9, 64])
def test_cut_follows_long_chains(spark, length):
    merges = spark.createDataFrame([(1, i + 1, i, float(length - i), 2) for i in range(length)], clusters.MERGES)
    cities = spark.range(length + 2).select(F.col("id").cast("int").alias("city_code"))
    got = {r.city_code: r.cluster_code for r in clusters.cut(cities, merges, float(length)).collect()}
    assert got == {i: 0 if i <= length else i for i in range(length + 2)}
    none = clusters.cut(cities, merges, 0.0)
    assert none.filter("city_code <> cluster_code").count() == 0
