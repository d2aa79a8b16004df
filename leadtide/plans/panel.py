"""The generic panel: orders a day by nation, and the activity of users."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.functions import metrics
from leadtide.operators import panel
from leadtide.plans.base import rounded
from leadtide.registry import query
from leadtide.sources import tables

ORIGIN = date(2001, 5, 31)
DAYS = 30
PA = """pa AS (SELECT n_name AS entity_id, CAST(o_orderdate AS DATE) AS ds, CAST(count(*) AS BIGINT) AS y, round(avg(o_totalprice), 4) AS price, min(r_name) AS destination_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
TL = """tl AS (SELECT e.entity_id, CAST(d AS DATE) AS ds, CAST(coalesce(pa.y, 0) AS BIGINT) AS y, pa.price, pa.y IS NOT NULL AS observed
    FROM (SELECT entity_id, unnest(generate_series(min(ds), (SELECT max(ds) FROM pa), INTERVAL 1 DAY)) AS d FROM pa GROUP BY entity_id) e LEFT JOIN pa ON pa.entity_id = e.entity_id AND pa.ds = CAST(e.d AS DATE))"""
_DS = "strftime(ds, '%Y-%m-%d') AS ds"


def sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([PA, TL, *more]) + "\n" + body


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.timeline(tables.demand_panel(spark, sf_dir)).drop("destination_id")


@query("panel_timeline", sql(f"SELECT entity_id, {_DS}, y, round(price, 3) AS price, observed FROM tl"))
def panel_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dense(spark, sf_dir), 3)


@query("collapsed_panel", f"SELECT c_mktsegment AS category_id, strftime(o_orderdate, '%Y-%m-%d') AS ds, CAST(count(*) AS BIGINT) AS y, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 3) AS ticket FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, strftime(o_orderdate, '%Y-%m-%d')")
def collapsed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders_panel(spark, sf_dir).select("category_id", "ds", F.col("value").alias("revenue"), F.col("value").alias("ticket"))
    return rounded(panel.collapse(rows, ["category_id", "ds"], None, "count"), 3, revenue=2)


@query(
    "covariate_fill",
    sql(
        f"""SELECT entity_id, {_DS}, round(coalesce(price, CASE WHEN a.i IS NOT NULL AND b.i IS NOT NULL THEN a.v + (b.v - a.v) * (i - a.i) / (b.i - a.i) ELSE coalesce(a.v, b.v) END), 3) AS price FROM (
        SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
        FROM (SELECT *, CASE WHEN price IS NOT NULL THEN {{'i': i, 'v': price}} END AS k FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds) AS i FROM tl)))"""
    ),
)
def covariate_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.interpolate(dense(spark, sf_dir), "price").select("entity_id", "ds", "price"), 3)


@query("forward_fill", sql(f"SELECT entity_id, {_DS}, round(coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(price IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 3) AS price FROM tl"))
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.fill_both_ways(dense(spark, sf_dir), ["price"]).select("entity_id", "ds", "price"), 3)


_W = "OVER (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_ROLL = ", ".join(
    f"round(avg(y) {_W.format(n=w - 1)}, 6) AS y_roll_mean_{w}, round(CASE WHEN count(y) {_W.format(n=w - 1)} > 1 THEN stddev_pop(y) {_W.format(n=w - 1)} END, 5) AS y_roll_std_{w}, min(y) {_W.format(n=w - 1)} AS y_roll_min_{w}, max(y) {_W.format(n=w - 1)} AS y_roll_max_{w}" for w in (7, 28)
)


@query("rolling_features", sql(f"SELECT entity_id, {_DS}, {_ROLL} FROM tl"))
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense(spark, sf_dir).withColumns({k: v for w in (7, 28) for k, v in panel.rolling("y", w).items()})
    return rounded(rows.select("entity_id", "ds", *(c for c in rows.columns if "roll" in c)), y_roll_std_7=5, y_roll_std_28=5)


@query("lag_features", sql(f"SELECT entity_id, {_DS}, " + ", ".join(f"lag(y, {k}) OVER (PARTITION BY entity_id ORDER BY ds) AS y_lag_{k}" for k in (1, 7, 14, 28)) + ", CAST(ds - min(ds) OVER (PARTITION BY entity_id) + 1 AS INTEGER) AS entity_history_len FROM tl"))
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.origin_features(dense(spark, sf_dir))
    return rounded(rows.select("entity_id", "ds", *(f"y_lag_{k}" for k in (1, 7, 14, 28)), "entity_history_len"))


@query("trend_features", sql(f"SELECT entity_id, {_DS}, round(avg(y) {_W.format(n=6)} / (avg(y) {_W.format(n=27)} + 1e-6), 5) AS y_trend_ratio FROM tl"))
def trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.origin_features(dense(spark, sf_dir)).select("entity_id", "ds", "y_trend_ratio"), 5)


NV = f"""nv AS (SELECT e.entity_id, CAST(DATE '{ORIGIN}' + h AS DATE) AS ds, CAST(h AS INTEGER) AS horizon, m.m AS historical_mean,
    (SELECT y FROM tl WHERE tl.entity_id = e.entity_id AND tl.ds = DATE '{ORIGIN}') AS naive,
    (SELECT avg(y) FROM tl WHERE tl.entity_id = e.entity_id AND tl.ds > DATE '{ORIGIN}' - 28 AND tl.ds <= DATE '{ORIGIN}') AS moving_average,
    (SELECT y FROM tl WHERE tl.entity_id = e.entity_id AND tl.ds = DATE '{ORIGIN}' + CAST(h - 7 * ceil(h / 7.0) AS INTEGER)) AS seasonal_naive,
    (SELECT avg(y) FROM tl WHERE tl.entity_id = e.entity_id AND tl.ds <= DATE '{ORIGIN}' + CAST(h - 7 * ceil(h / 7.0) AS INTEGER) AND tl.ds > DATE '{ORIGIN}' + CAST(h - 7 * ceil(h / 7.0) AS INTEGER) - 56 AND isodow(tl.ds) = isodow(CAST(DATE '{ORIGIN}' + h AS DATE))) AS seasonal_mean
    FROM (SELECT DISTINCT entity_id FROM tl WHERE ds <= DATE '{ORIGIN}') e CROSS JOIN (SELECT CAST(h AS INTEGER) AS h FROM range(1, {DAYS + 1}) t(h)) JOIN (SELECT entity_id, avg(y) AS m FROM tl WHERE ds <= DATE '{ORIGIN}' GROUP BY ALL) m ON m.entity_id = e.entity_id)"""


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.naive_forecasts(dense(spark, sf_dir), ORIGIN, DAYS)


@query("naive_forecasts", sql(f"SELECT entity_id, {_DS}, horizon, naive::DOUBLE AS naive, round(seasonal_naive, 6) AS seasonal_naive, round(moving_average, 6) AS moving_average, round(historical_mean, 6) AS historical_mean, round(seasonal_mean, 6) AS seasonal_mean FROM nv", NV))
def naive_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(naive(spark, sf_dir))


MAP = "mp AS (SELECT entity_id, min(destination_id) AS destination_id FROM pa GROUP BY ALL)"
_LV = "lv AS (SELECT 'listing' AS level, entity_id, ds, horizon, seasonal_mean AS forecast, 0.8 * seasonal_mean AS lower, naive::DOUBLE AS reference FROM nv UNION ALL SELECT 'destination', destination_id, ds, min(horizon), sum(seasonal_mean), sum(0.8 * seasonal_mean), avg(naive) FROM nv JOIN mp USING (entity_id) GROUP BY ALL UNION ALL SELECT 'market', 'all', ds, min(horizon), sum(seasonal_mean), sum(0.8 * seasonal_mean), avg(naive) FROM nv GROUP BY ALL)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = naive(spark, sf_dir).select("entity_id", "ds", "horizon", F.col("seasonal_mean").alias("forecast"), (F.col("seasonal_mean") * 0.8).alias("lower"), F.col("naive").alias("reference"))
    mapping = panel.entity_map(tables.demand_panel(spark, sf_dir))
    return panel.all_levels(rows, mapping, {"destination": "destination_id", "market": "market_id"})


@query("hierarchy_rollup", sql(f"SELECT level, entity_id, {_DS}, horizon, round(forecast, 6) AS forecast, round(lower, 6) AS lower, round(reference, 6) AS reference FROM lv", NV, MAP, _LV))
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_levels(spark, sf_dir))


@query("hierarchy_coherence", sql("SELECT level, round((sum(forecast) - (SELECT sum(forecast) FROM lv WHERE level = 'listing')) / (SELECT sum(forecast) FROM lv WHERE level = 'listing') * 100, 4) + 0.0 AS pct_diff FROM lv WHERE level <> 'listing' GROUP BY ALL", NV, MAP, _LV))
def hierarchy_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.coherence(_levels(spark, sf_dir), "forecast")
    return found.select("level", (F.round("pct_diff", 4) + F.lit(0.0)).alias("pct_diff"))


@query("level_members", sql("SELECT level, entity_id, round(sum(forecast), 6) AS forecast_total, CAST(row_number() OVER (PARTITION BY level ORDER BY round(sum(forecast), 6) DESC, entity_id) AS INTEGER) AS rank FROM lv GROUP BY level, entity_id", NV, MAP, _LV))
def level_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sums = _levels(spark, sf_dir).groupBy("level", "entity_id").agg(F.round(F.sum("forecast"), 6).alias("forecast_total"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("forecast_total"), "entity_id")))


SG = "sg AS (SELECT nv.*, tl.y AS actual, destination_id FROM nv JOIN tl USING (entity_id, ds) JOIN mp USING (entity_id))"


@query("segment_scores", sql("SELECT destination_id AS segment, round(sum(abs(actual - seasonal_mean)) / sum(actual), 6) AS wape, round(avg(abs(actual - seasonal_mean)), 6) AS mae, CAST(count(*) AS BIGINT) AS rows FROM sg GROUP BY ALL HAVING count(*) > 10", NV, MAP, SG))
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = naive(spark, sf_dir).join(dense(spark, sf_dir).select("entity_id", "ds", F.col("y").alias("actual")), ["entity_id", "ds"]).join(panel.entity_map(tables.demand_panel(spark, sf_dir)), "entity_id")
    return rounded(panel.segments(rows, "destination_id", [metrics.wape("actual", "seasonal_mean").alias("wape"), metrics.mae("actual", "seasonal_mean").alias("mae")], 10))


_NB = ("naive", "seasonal_naive", "moving_average", "historical_mean", "seasonal_mean")


@query("model_scores", sql(" UNION ALL ".join(f"SELECT '{m}' AS model, round(sum(abs(actual - {m})) / sum(actual), 6) AS wape, round(sqrt(avg((actual - {m}) ** 2)), 6) AS rmse, round(avg({m} - actual), 6) AS bias FROM sg" for m in _NB), NV, MAP, SG))
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = naive(spark, sf_dir).join(dense(spark, sf_dir).select("entity_id", "ds", F.col("y").alias("actual")), ["entity_id", "ds"])
    long = rows.select("actual", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in _NB))).alias("x")).select("actual", "x.model", "x.p")
    return rounded(long.groupBy("model").agg(metrics.wape("actual", "p").alias("wape"), metrics.rmse("actual", "p").alias("rmse"), metrics.bias("actual", "p").alias("bias")))


@query("fold_collapse", sql("SELECT entity_id, strftime(ds, '%Y-%m-%d') AS ds, round(avg(p), 6) AS prediction, avg(actual)::DOUBLE AS actual, CAST(min(horizon) AS INTEGER) AS horizon, CAST(count(*) AS BIGINT) AS folds FROM (SELECT entity_id, ds, horizon, seasonal_mean AS p, actual FROM sg UNION ALL SELECT entity_id, ds, horizon + 5, moving_average, actual FROM sg WHERE horizon <= 20) GROUP BY entity_id, ds", NV, MAP, SG))
def fold_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = naive(spark, sf_dir).join(dense(spark, sf_dir).select("entity_id", "ds", F.col("y").alias("actual")), ["entity_id", "ds"])
    one = rows.select("entity_id", "ds", "horizon", F.col("seasonal_mean").alias("prediction"), "actual")
    two = rows.filter("horizon <= 20").select("entity_id", "ds", (F.col("horizon") + 5).alias("horizon"), F.col("moving_average").alias("prediction"), "actual")
    return rounded(panel.fold_collapse(one.unionByName(two)))


@query("merged_timeline", sql(f"SELECT entity_id, {_DS}, y AS history, round(forecast, 6) AS forecast FROM (SELECT entity_id, ds, y FROM tl WHERE ds > DATE '{ORIGIN}' - 60) FULL JOIN (SELECT entity_id, ds, seasonal_mean AS forecast FROM nv) USING (entity_id, ds)", NV))
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = dense(spark, sf_dir).filter(F.col("ds") > F.date_sub(F.lit(ORIGIN), 60)).select("entity_id", "ds", F.col("y").alias("history"))
    return rounded(past.join(naive(spark, sf_dir).select("entity_id", "ds", F.col("seasonal_mean").alias("forecast")), ["entity_id", "ds"], "full"))


@query("side_join", "SELECT o_orderkey, o_orderpriority, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_mktsegment END AS c_mktsegment FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey AND c.c_custkey % 3 <> 0")
def side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = tables.table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    joined, _ = panel.side_join(orders, customer.unionByName(customer.withColumn("c_mktsegment", F.lit("~"))), ["custkey"], ["c_mktsegment"])
    return joined.select("o_orderkey", "o_orderpriority", "c_mktsegment")


@query("side_join_rate", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (o_custkey % 3 <> 0) AS BIGINT) AS matched, round(count(*) FILTER (o_custkey % 3 <> 0) / count(*), 6) AS match_rate FROM orders JOIN customer ON o_custkey = c_custkey")
def side_join_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = tables.table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return rounded(panel.side_join(orders, customer, ["custkey"], ["c_mktsegment"])[1])


_CV = f"cv AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS k FROM pa WHERE ds <= DATE '{ORIGIN}')"


@query(
    "projected_covariate",
    sql(
        f"""SELECT nv.entity_id, strftime(nv.ds, '%Y-%m-%d') AS ds, round(CASE WHEN nv.horizon = 3 THEN 100.0 WHEN nv.horizon = 4 AND nv.entity_id = 'NATION_07' THEN 50.0 ELSE l.m * least(greatest(coalesce(p.m / l.m, 1), 0.5), 2.0) END, 2) AS price
        FROM nv JOIN (SELECT entity_id, avg(price) AS m FROM cv WHERE k <= 28 GROUP BY ALL) l USING (entity_id) LEFT JOIN (SELECT entity_id, isodow(ds) AS w, avg(price) AS m FROM cv WHERE k <= 28 GROUP BY ALL) p ON p.entity_id = nv.entity_id AND p.w = isodow(nv.ds)""",
        NV, _CV,
    ),
)
def projected_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices to come, with one day given for all and one for a single nation."""
    past = tables.demand_panel(spark, sf_dir).filter(F.col("ds") <= F.lit(ORIGIN))
    dates = panel.horizon_rows(past, ORIGIN, DAYS).select("entity_id", "ds")
    given = spark.createDataFrame([(None, date(2001, 6, 3), 100.0), ("NATION_07", date(2001, 6, 4), 50.0)], "entity_id string, ds date, price double")
    return rounded(panel.override(panel.project_covariate(past, "price", dates, "price"), given, "price"), 2)


@query("sampled_rows")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: a thousand pairs, the same on every run."""
    return rounded(panel.sample_rows(dense(spark, sf_dir), ["entity_id", "ds"], 1000), 3)


@query("activity_panel", "SELECT user_id AS entity_id, strftime(ts, '%Y-%m-%d') AS ds, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS y, round(avg(CAST(json_extract(props, '$.k') AS INTEGER)), 5) AS k FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')")
def activity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.activity(spark, sf_dir)
    return rounded(rows.groupBy("entity_id", "ds").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("y"), F.avg("k").alias("k")), 5, y=2)
