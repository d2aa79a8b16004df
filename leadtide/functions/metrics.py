"""Error measures as aggregate columns.

Rows where the actual or the predicted value is null take no part. A measure without a denominator is
null, never NaN or infinite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def _pair(actual: str, predicted: str) -> tuple[Column, Column]:
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    return F.when(both, F.col(actual).cast("double")), F.when(both, F.col(predicted).cast("double"))


def _over(top: Column, bottom: Column) -> Column:
    return F.when(bottom > TINY, top / bottom)


def mae(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    return F.avg(F.abs(a - p))


def rmse(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    return F.sqrt(F.avg((a - p) * (a - p)))


def wape(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    return _over(F.sum(F.abs(a - p)), F.sum(F.abs(a)))


def mape(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    return F.avg(F.when(F.abs(a) > TINY, F.abs((a - p) / a))) * 100


def smape(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    middle = (F.abs(a) + F.abs(p)) / 2
    return F.avg(F.when(middle > TINY, F.abs(a - p) / middle)) * 100


def rmsle(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    gap = F.log1p(F.greatest(a, F.lit(0.0))) - F.log1p(F.greatest(p, F.lit(0.0)))
    return F.sqrt(F.avg(gap * gap))


def r2(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    total = F.var_pop(a) * F.count(a)
    return 1 - _over(F.sum((a - p) * (a - p)), total)


def bias(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    return F.avg(p - a)


def normalised_bias(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    return F.when(F.abs(F.sum(a)) > TINY, F.sum(p - a) / F.sum(a))


def poisson_deviance(actual: str, predicted: str) -> Column:
    a, p = _pair(actual, predicted)
    a, p = F.greatest(a, F.lit(0.0)), F.greatest(p, F.lit(TINY))
    return 2 * F.avg(F.when(a > 0, a * F.ln(a / p)).otherwise(F.when(a.isNotNull(), 0.0)) - (a - p))


def mase(actual: str, predicted: str, step: str) -> Column:
    """``step``: the absolute change of the actual from the row before, made with lag()."""
    return _over(mae(actual, predicted), F.avg(F.abs(F.col(step))))


def pinball(actual: str, predicted: str, quantile: float) -> Column:
    a, p = _pair(actual, predicted)
    return F.avg(F.greatest(quantile * (a - p), (quantile - 1) * (a - p)))


def coverage(actual: str, lower: str, upper: str) -> Column:
    a, low, high = (F.col(x) for x in (actual, lower, upper))
    return F.avg(F.when(a.isNotNull() & low.isNotNull() & high.isNotNull(), ((a >= low) & (a <= high)).cast("double")))


#: Measures by name, as other modules ask for them.
MEASURES = {f.__name__: f for f in (mae, rmse, wape, mape, smape, rmsle, r2, bias, normalised_bias, poisson_deviance)}
GREATER_IS_BETTER = frozenset(("r2",))


def score(actual: str = "actual", predicted: str = "predicted_demand") -> list[Column]:
    """The score record: n, totals, WAPE, MAE and normalised bias, rounded."""
    total = lambda x: F.round(F.sum(F.col(x).cast("double")), 2)
    return [
        F.count(F.lit(1)).alias("n"),
        total(actual).alias("actual_total"),
        total(predicted).alias("predicted_total"),
        F.round(wape(actual, predicted), 6).alias("wape"),
        F.round(mae(actual, predicted), 4).alias("mae"),
        F.round(normalised_bias(actual, predicted), 6).alias("normalised_bias"),
    ]
