"""The training frame made city by city against the same by joins, and what it moves."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import small_log

from leadtide.operators import boosting, features, frames, models
from leadtide.plans import features as plans
from leadtide.plans.base import log
from leadtide.sources import shared

SF = "/root/testdata/sf0.001"


def rows(frame, names):
    near = lambda x: float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x
    return sorted(tuple(map(near, r)) for r in frame.select("city_code", "checkin", "horizon", *(F.coalesce(F.col(c).cast("double"), F.lit(-9.25)) for c in names)).collect())


@pytest.mark.parametrize("make", [lambda s: log(s, SF), small_log], ids=["tables", "small"])
def test_cities_give_the_joined_frame(spark, make):
    data = make(spark)
    got, want = features.training_frame(data), features.joined_training_frame(data)
    assert got.dtypes == want.dtypes
    names = [c for c in got.columns if c not in ("city_code", "checkin", "horizon", "fold_cutoff")]
    some = F.pmod(F.xxhash64("city_code", "checkin"), F.lit(3)) == 0
    assert got.count() == want.count() > 0
    mine, theirs = rows(got.filter(some), names), rows(want.filter(some), names)
    assert len(mine) == len(theirs) and np.allclose([r[3:] for r in mine], [r[3:] for r in theirs], rtol=1e-9, atol=1e-12)
    assert [r[:3] for r in mine] == [r[:3] for r in theirs]


def test_gate_counts_those_of_the_frame(spark):
    data = small_log(spark)
    names = [c for c in frames.COLUMNS if c not in ("checkin", "fold_cutoff")]
    key = lambda x: sorted(map(tuple, x.select("feature", "nulls", "infinite", "allowed").collect()))
    got = key(features.allowed(frames.gate_counts(data, tuple(names))))
    assert got == key(features.quality_gate(features.joined_training_frame(data), names)) and any(r[1] for r in got)


def test_history_of_large_counts_is_exact():
    """Products of sums past 64 bits."""
    days = np.array([0, 10**9, 3, 0, 2 * 10**9, 5], np.int64)
    got = frames.rolled(days, 100, 101, np.arange(99, 106), 4)
    for i, o in enumerate(range(99, 106)):
        own = days[max(o - 3, 101) - 100 : o - 99] if o >= 101 else days[:0]
        assert got["city_hist_mean"][i] == (own.mean() if len(own) else 0)
        assert np.isclose(got["city_hist_std"][i], own.std(ddof=1) if len(own) > 1 else 0, rtol=1e-12)
        assert got["city_hist_p75"][i] == (np.quantile(own, 0.75) if len(own) else 0)


def test_rounding_is_half_away_from_zero():
    assert frames.half_up(np.array([0.5, -0.5, 2.5, 1.4, -1.6, np.inf, -0.0]), 0).tolist() == [1, -1, 3, 1, -2, np.inf, 0]


@pytest.mark.parametrize("query", ["training_frame", "compact_features", "feature_gate", "pickup_features", "curve_features", "history_features"])
def test_no_wide_frame_is_dealt(spark, query):
    """Above the step that makes the rows there is no exchange of them: sums of the gate at most."""
    plan = getattr(plans, query)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Repartition" not in above and ("Aggregate" in above) == (query == "feature_gate")


@pytest.mark.parametrize("cluster", [False, True])
def test_lessons_of_cities_are_the_frames(spark, cluster):
    """Counts, starting points and bytes of every row, without a written frame."""
    data, bands, p = small_log(spark), ((1, 10), (11, 30)), boosting.with_params(block_rows=500, bins=16)
    extra = spark.createDataFrame([(c, float(c * c)) for c in range(4)], "city_code int, size double") if cluster else None
    names = (*features.FEATURES, "size") if cluster else features.FEATURES
    lessons = frames.CityLessons([data], bands, names, True, extra)
    frame = features.joined_training_frame(data)
    frame = frame.join(extra, "city_code", "left") if cluster else frame
    table = frame.select(models.in_band(bands).alias("m"), F.log1p(F.col("remaining_demand").cast("double")).alias("y"), *(F.col(c).cast("double").alias(c) for c in names)).toPandas()
    counts, edges = lessons.counts(p), lessons.edges(names, p, 2)
    assert counts == table.groupby("m").size().to_dict()
    for (m, a), q in lessons.starts((0.1, 0.5, 0.9), p).items():
        assert np.isclose(q, np.quantile(table.y[table.m == m], a, method="inverted_cdf"))
    found = {m: [] for m in counts}
    blocks = lessons.blocks(names, p, edges, counts).collect()
    for r in blocks:
        x, y = boosting.opened(r.x, np.uint8, r.n, len(names)), boosting.opened(r.y, np.float64, r.n)
        found[r.model] += [(round(v, 9), bytes(k)) for k, v in zip(x.T, y, strict=True)]
    assert len(blocks) == sum(-(-n // 500) for n in counts.values()) and max(r.n for r in blocks) < 650
    near = 0
    for m, rows_ in found.items():
        own = table[table.m == m]
        want = np.stack([boosting.binned(own[c].to_numpy(float), edges[m][j]) for j, c in enumerate(names)], 1)
        near += sum((Counter(rows_) - Counter((round(v, 9), bytes(k)) for v, k in zip(own.y, want, strict=True))).values())
    assert near == 0


def test_models_learn_from_logs_without_a_written_frame(spark, monkeypatch):
    data, made = small_log(spark), []
    for module in (frames, boosting, models):
        monkeypatch.setattr(module, "written", lambda df, real=shared.written: made.append(df.columns) or real(df))
    whole = models.fit_logs([data, data], ((1, 10), (11, 30)), trees=3, leaves=4, least=5)[0.5]
    assert len(whole) == 2 and all(len(m.trees) == 3 for x in whole for m in x.models)
    assert not any("observed_total" in c for c in made) and len(made) == 2
    assert whole[0].predict(features.inference_frame(data)).filter("model_demand < observed_total").count() == 0
