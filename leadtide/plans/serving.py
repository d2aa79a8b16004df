"""Covariate blocks, drawn horizons, and checks of what is served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.functions import metrics
from leadtide.operators import calibration, covariates, marts, panel, quality, serving
from leadtide.plans.backtest import FOLDS
from leadtide.plans.base import log, rounded
from leadtide.plans.base import sql as log_sql
from leadtide.plans.calibration import _UNB, _frame
from leadtide.plans.marts import NF
from leadtide.plans.panel import DAYS, MAP, NV, ORIGIN, SG, dense, naive, sql
from leadtide.registry import query
from leadtide.sources import tables

_DS = "strftime(ds, '%Y-%m-%d') AS ds"
_W = "OVER (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_W7, _W28 = _W.format(n=6), _W.format(n=27)


@query(
    "past_covariates",
    sql(
        f"SELECT entity_id, {_DS}, round(price, 3) AS past_price_last, round(avg(price) {_W7}, 3) AS past_price_mean_7, round(avg(price) {_W28}, 3) AS past_price_mean_28, round(avg(price) {_W7} / (avg(y) {_W7} + 1), 3) AS past_price_per_demand_7, round(avg(price) {_W28} / (avg(y) {_W28} + 1), 3) AS past_price_per_demand_28 FROM tl"
    ),
)
def past_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = covariates.past_block(dense(spark, sf_dir), "price")
    return rounded(rows.select("entity_id", "ds", *(c for c in rows.columns if c.startswith("past_"))), 3)


@query(
    "future_covariates",
    sql(
        f"""SELECT nv.entity_id, strftime(nv.ds, '%Y-%m-%d') AS ds, nv.horizon, round(t.price, 3) AS fut_price, round(t.price / (abs(o.price) + 1e-6), 6) AS fut_price_vs_origin, round(t.price / (abs(o.m) + 1e-6), 6) AS fut_price_vs_recent_avg
        FROM nv LEFT JOIN tl t ON t.entity_id = nv.entity_id AND t.ds = nv.ds LEFT JOIN (SELECT entity_id, ds, price, avg(price) {_W28} AS m FROM tl) o ON o.entity_id = nv.entity_id AND o.ds = DATE '{ORIGIN}'""",
        NV,
    ),
)
def future_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = dense(spark, sf_dir)
    rows = panel.horizon_rows(history.filter(F.col("ds") <= F.lit(ORIGIN)), ORIGIN, DAYS)
    return rounded(covariates.future_block(rows, history, "price").drop("origin"), fut_price=3)


_U = "CAST('0x' || substr(md5(concat_ws('|', '42', entity_id, strftime(ds, '%Y-%m-%d'), draw)), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "sampled_horizons",
    sql(
        f"""SELECT entity_id, {_DS}, draw, horizon FROM (SELECT *, CAST(least(greatest(floor(exp({_U}::DOUBLE * ln({DAYS + 1}))), 1), {DAYS}) AS INTEGER) AS horizon
        FROM (SELECT entity_id, ds, CAST(unnest([1, 2, 3]) AS INTEGER) AS draw, first_ds FROM tl JOIN (SELECT entity_id, min(ds) AS first_ds FROM tl GROUP BY ALL) USING (entity_id) WHERE observed AND ds <= DATE '{ORIGIN}')) WHERE ds - horizon >= first_ds + 28"""
    ),
)
def sampled_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariates.sampled_horizons(dense(spark, sf_dir), ORIGIN, DAYS))


@query(
    "daily_calibration",
    log_sql(
        f"SELECT strftime(CAST(checkin AS DATE), '%Y-%m-%d') AS checkin, round(sum(predicted), 4) AS predicted_demand_raw, round(sum(greatest(observed + f * greatest(predicted - observed, 0), observed)), 4) AS predicted_demand_calibrated, round(sum(greatest(observed + f * greatest(predicted - observed, 0), observed)) - sum(predicted), 4) AS delta FROM folds, (SELECT {_UNB} AS f FROM folds) GROUP BY checkin",
        FOLDS, folds=True,
    ),
)
def daily_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds' forecasts by day, raw and with the factor that matches their total."""
    from leadtide.sources.shared import written

    frame = written(_frame(spark, sf_dir).select("fold_cutoff", "checkin", "horizon", "observed", "actual", "predicted_demand"))
    after = calibration.calibrated(frame, calibration.calibrator(frame, C, "bias_global"), C)
    return rounded(serving.daily_difference(frame, after.drop("predicted_demand").withColumnRenamed("calibrated_demand", "predicted_demand")), 4)


_G = """g AS (SELECT l_returnflag || '/' || l_linenumber AS driver, sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem) AS share, avg(l_discount) - (SELECT avg(l_discount) FROM lineitem) AS effect FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY share DESC, driver) AS k FROM g)"""


@query("folded_drivers", f"WITH {_G} SELECT CASE WHEN k <= 8 THEN driver ELSE 'other' END AS driver, round(sum(share), 6) AS share, round(sum(effect), 8) AS effect, CAST(count(*) AS BIGINT) AS groups, CASE WHEN sum(effect) > 0 THEN 'positive' WHEN sum(effect) < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM r GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY CASE WHEN k <= 8 THEN driver ELSE 'other' END").replace("lineitem GROUP BY CASE WHEN k <= 8 THEN driver ELSE 'other' END)", "lineitem GROUP BY ALL)"))
def folded_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of line items as if they drove a forecast: the largest and the rest as one."""
    rows = tables.table(spark, sf_dir, "lineitem")
    all_ = F.broadcast(rows.agg(F.sum("l_extendedprice").alias("_t"), F.avg("l_discount").alias("_d")))  # one row
    own = rows.groupBy(F.concat_ws("/", "l_returnflag", "l_linenumber").alias("driver")).agg(F.sum("l_extendedprice").alias("_s"), F.avg("l_discount").alias("_a"))
    groups = own.crossJoin(all_).select("driver", (F.col("_s") / F.col("_t")).alias("share"), (F.col("_a") - F.col("_d")).alias("effect"))
    return rounded(serving.folded_drivers(groups), effect=8)


@query("output_differences", log_sql("SELECT CAST(count(*) FILTER (city_code % 7 = 0) + count(*) FILTER (city_code % 7 = 1) AS BIGINT) AS only_left, CAST(count(*) FILTER (city_code % 7 = 0) AS BIGINT) AS only_right FROM nf", NF))
def output_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named forecast against a copy with some rows changed and some left out."""
    named = marts.named_forecast(log(spark, sf_dir)).select("city_code", "checkin", "predicted_demand")
    other = named.filter("city_code % 7 <> 1").withColumn("predicted_demand", F.when(F.col("city_code") % 7 == 0, F.col("predicted_demand") + 1).otherwise(F.col("predicted_demand")))
    return serving.differences(named, other)


_M = {"seasonal_naive": 0.5, "moving_average": 0.3, "historical_mean": 0.2}


def _blend(side: str, width: float) -> str:
    have = lambda m: f"(CASE WHEN {m} > 3 THEN {m} * {width} END)"
    top = " + ".join(f"{w} * coalesce({have(m)}, 0)" for m, w in _M.items())
    bottom = " + ".join(f"CASE WHEN {have(m)} IS NOT NULL THEN {w} ELSE 0 END" for m, w in _M.items())
    return f"round(CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) END, 6) AS {side}"


@query("ensemble_bounds", sql(f"SELECT entity_id, {_DS}, horizon, round(seasonal_mean, 6) AS prediction, {_blend('lower', 0.8)}, {_blend('upper', 1.2)} FROM nv", NV))
def ensemble_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of three members, each of which has them only where its forecast is above 3."""
    rows = naive(spark, sf_dir)
    keys = ["entity_id", "ds", "horizon"]
    sides = {f"{m}_{s}": F.when(F.col(m) > 3, F.col(m) * w) for m in _M for s, w in (("lower", 0.8), ("upper", 1.2))}
    return rounded(serving.ensemble_bounds(rows.select(*keys, F.col("seasonal_mean").alias("prediction")), rows.select(*keys, *(v.alias(k) for k, v in sides.items())), _M, keys))


@query("served_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 OR l_quantity < 25 THEN CAST(0 AS BIGINT) ELSE CAST(round(l_extendedprice * (l_quantity - 25)) AS BIGINT) END AS forecast FROM lineitem")
def served_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") * (F.col("l_quantity") - 25))
    return serving.constrained(rows.select("l_orderkey", "l_linenumber", value.alias("forecast")), ["forecast"], whole=True)


@query("truncated_report", sql(f"SELECT CAST(count(*) AS BIGINT) AS count, count(*) > 100 AS truncated FROM nv", NV))
def truncated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.limited(naive(spark, sf_dir), [F.desc("seasonal_mean"), "entity_id", "ds"], 100)[1]


@query("pinball_scores", sql(" UNION ALL ".join(f"SELECT {q} AS quantile, round(avg(greatest({q} * (actual - seasonal_mean * {w}), ({q} - 1) * (actual - seasonal_mean * {w}))), 6) AS pinball FROM sg" for q, w in ((0.1, 0.8), (0.5, 1.0), (0.9, 1.2))), NV, MAP, SG))
def pinball_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = naive(spark, sf_dir).join(dense(spark, sf_dir).select("entity_id", "ds", F.col("y").alias("actual")), ["entity_id", "ds"])
    rows = rows.select("actual", *((F.col("seasonal_mean") * w).alias(f"q{n}") for n, w in ((10, 0.8), (50, 1.0), (90, 1.2))))
    found = rows.agg(*(metrics.pinball("actual", f"q{n}", n / 100).alias(f"q{n}") for n in (10, 50, 90)))
    return rounded(found.select(F.explode(F.array(*(F.struct(F.lit(n / 100).alias("quantile"), F.col(f"q{n}").alias("pinball")) for n in (10, 50, 90)))).alias("x")).select("x.quantile", "x.pinball"))


@query("file_overlap", log_sql(f"SELECT CAST((SELECT max(checkin) FROM ev WHERE checkin <= DATE '{C.cutoff}' + 3) >= (SELECT min(checkin) FROM ev WHERE checkin > DATE '{C.cutoff}') AS BOOLEAN) AS ranges_overlap, CAST(count(*) AS BIGINT) AS shared_keys FROM (SELECT DISTINCT log_date, city_code, checkin FROM ev WHERE checkin > DATE '{C.cutoff}' AND checkin <= DATE '{C.cutoff}' + 3)"))
def file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history that runs three days too far against the target's file."""
    rows = tables.events(spark, sf_dir)
    return quality.overlap(rows.filter(F.col("checkin") <= F.date_add(F.lit(C.cutoff), 3)), rows.filter(F.col("checkin") > F.lit(C.cutoff)), ["log_date", "city_code", "checkin"], "checkin")


_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("column_findings", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 'x' AS fixed FROM orders), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS d, count(*) AS n FROM o" for c in (*_COLS, "fixed")) + ") SELECT name, CAST(d AS BIGINT) AS distinct_values, d <= 1 AS is_constant, d > 200 AND d > 0.5 * n AS high_cardinality FROM s")
def column_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(*_COLS, F.lit("x").alias("fixed"))
    return quality.column_findings(rows, [*_COLS, "fixed"])
