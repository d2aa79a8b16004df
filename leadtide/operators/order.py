"""Exact order statistics of groups of any size, several at once.

An aggregate of exact percentiles keeps all distinct values of a group in one buffer. Here every wanted rank has a bracket,
at first the group's least and greatest value. A round counts the rows of each bracket in 4,096 bins, and the bin that holds
the rank becomes the bracket, until it is one value or holds few rows; only these are put in order. Counts are summed before
they are shuffled, so a group may hold all rows.

Rounds are few whatever the values: the first divides by sign and power of two, later ones divide evenly. Within a power of
two numbers have 52 bits, of which a round settles 12, so there are six at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadtide.sources.shared import drop, written

BINS = 4096
#: Rows of a bracket that are put in order in one task, and brackets that are broadcast (some 100 bytes each), at most.
FEW = 100_000
BROADCAST = 50_000


def _by_power(v: Column) -> Column:
    """Ascending with v, about 1 for each power of two; infinities lie apart from all numbers."""
    far = F.least(F.log2(F.abs(v)), F.lit(1100.0)) + 1075
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * far)


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], Column], few: int = FEW) -> DataFrame:
    """by, n (the group's values), values: those whose ranks, counted from the least as 1, are in the array ranks(n).

    Equal values take a rank each. Nulls and NaN are no values; ranks below 1 or above n give null, and so does every rank of
    a group without values. Without ``by`` there is one row, even for an empty table. Groups with null keys are groups.
    """
    v, key = F.col(value).cast("double"), F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("_0"))
    source = written(rows.select(key.alias("_g"), F.when(~F.isnan(v), v).alias("_v")))
    facts = [F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    sizes = source.groupBy("_g").agg(*facts) if by else source.agg(*facts).withColumn("_g", key)
    groups = written(sizes.withColumn("_want", ranks(F.col("n")).cast("array<long>")))
    first = groups.select("_g", F.explode(F.array_distinct("_want")).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_inside"))
    brackets = written(first.filter("_rank BETWEEN 1 AND _inside"))
    place = ["_g", "_lo", "_hi", "_before"]

    def inside(which: DataFrame) -> DataFrame:
        """The rows of each bracket, which ranks may share."""
        own = which.select(*place).distinct()
        small = which.limit(BROADCAST + 1).count() <= BROADCAST
        return source.join(F.broadcast(own) if small else own, "_g").filter("_v BETWEEN _lo AND _hi")

    def holding(which: DataFrame, counted: DataFrame, order: str) -> DataFrame:
        """Each rank with the part of its bracket (column ``order``, _c rows) that holds it, _upto being the last rank there."""
        upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*place).orderBy(order))
        parts = counted.withColumn("_upto", upto)
        return which.join(parts, place).filter("_rank > _upto - _c AND _rank <= _upto")

    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > few)
    by_power = True
    while not (open_ := brackets.filter(wide)).isEmpty():
        scale = _by_power if by_power else (lambda x: x)
        low, high = scale(F.col("_lo")), scale(F.col("_hi"))
        share = F.coalesce(F.try_divide(scale(F.col("_v")) - low, high - low), F.lit(0.0))
        bins = inside(open_).groupBy(*place, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_bin"))
        counted = bins.agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        found = holding(open_, counted, "_bin")
        narrower = found.select("_g", "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_upto") - F.col("_c")).alias("_before"), F.col("_c").alias("_inside"))
        before, brackets, by_power = brackets, written(brackets.filter(~wide).unionByName(narrower)), False
        drop(before)

    one = brackets.filter("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_v"))
    rest = brackets.filter("_lo < _hi")
    ordered = holding(rest, inside(rest).groupBy(*place, "_v").agg(F.count(F.lit(1)).alias("_c")), "_v").select("_g", "_rank", "_v")
    known = one.unionByName(ordered).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # as many as ranks
    values = F.transform("_want", lambda r: F.try_element_at("_at", r)).alias("values")
    out = written(groups.join(known, "_g", "left").select(*(F.col("_g")[c].alias(c) for c in by), "n", values))
    for x in (source, groups, brackets):
        drop(x)
    return out


def quantiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...], few: int = FEW) -> DataFrame:
    """by, n, q: an array of the quantiles at ``points``, between the two nearest values in proportion; see order_statistics."""
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in points]
    found = order_statistics(rows, by, value, lambda n: F.array(*(f(F.lit(float(p)) * (n - 1)) + 1 for p in points for f in (F.floor, F.ceil))), few)

    def between(i: int) -> Column:
        low, high = F.col("values")[2 * i], F.col("values")[2 * i + 1]
        return F.when(low == high, low).otherwise((F.ceil(at[i]) - at[i]) * low + (at[i] - F.floor(at[i])) * high)

    return found.select(*by, "n", F.array(*(between(i) for i in range(len(points)))).alias("q"))
