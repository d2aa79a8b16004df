"""Findings and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.functions.text import ROLES
from leadtide.operators import asof, curves, quality, roles
from leadtide.plans.base import day, log, rounded, sql
from leadtide.plans.panel import dense
from leadtide.plans.panel import sql as panel_sql
from leadtide.plans.signals import TR, regions
from leadtide.registry import query
from leadtide.sources import tables

_RULES = f"""SELECT 'count_below_one' AS rule, count(*) FILTER (n < 1) AS c FROM ev UNION ALL SELECT 'checkin_before_log', count(*) FILTER (checkin < log_date) FROM ev UNION ALL SELECT 'lead_too_long', count(*) FILTER (checkin - log_date > {C.max_lead}) FROM ev
    UNION ALL SELECT 'null_in_key', count(*) FILTER (log_date IS NULL OR city_code IS NULL OR checkin IS NULL OR n IS NULL) FROM ev UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (log_date, city_code, checkin)) FROM ev
    UNION ALL SELECT 'unknown_city', (SELECT count(*) FROM (SELECT city_code FROM ev EXCEPT SELECT city_code FROM ci)) UNION ALL SELECT 'silent_city', (SELECT count(*) FROM (SELECT city_code FROM ci EXCEPT SELECT city_code FROM ev)) UNION ALL SELECT 'overlap_of_files', 0"""


@query("event_findings", sql(f'SELECT rule, CAST(c AS BIGINT) AS "count" FROM ({_RULES})'))
def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.event_findings(tables.events(spark, sf_dir), tables.cities(spark, sf_dir), C)


@query("event_summary", sql("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT city_code) AS BIGINT) AS cities, CAST(sum(n) AS BIGINT) AS searches, strftime(min(log_date), '%Y-%m-%d') AS first_log, strftime(max(log_date), '%Y-%m-%d') AS last_log, strftime(min(checkin), '%Y-%m-%d') AS first_checkin, strftime(max(checkin), '%Y-%m-%d') AS last_checkin, min(lead) AS least_lead, max(lead) AS greatest_lead FROM ev"))
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.event_summary(tables.events(spark, sf_dir)))


_SUB = """sb AS (SELECT city_code AS cluster_code, CASE WHEN city_code % 17 = 3 AND horizon = 2 THEN '1999/07/02' ELSE strftime(checkin, '%Y-%m-%d') END AS checkin,
    CASE WHEN city_code % 13 = 5 AND horizon = 3 THEN 'x' WHEN city_code % 11 = 4 AND horizon = 4 THEN '-1' WHEN city_code % 7 = 1 AND horizon = 5 THEN '2.5' ELSE CAST(observed AS VARCHAR) END AS p FROM grid WHERE NOT (city_code % 19 = 2 AND horizon = 6)
    UNION ALL SELECT city_code, strftime(checkin, '%Y-%m-%d'), CAST(observed AS VARCHAR) FROM grid WHERE city_code % 23 = 1 AND horizon = 7 UNION ALL SELECT 999999, '1999-07-03', '1')"""
_SB2 = "s2 AS (SELECT cluster_code, TRY_CAST(CASE WHEN checkin LIKE '%/%' THEN NULL ELSE checkin END AS DATE) AS d, TRY_CAST(p AS DOUBLE) AS v, checkin FROM sb)"


@query(
    "submission_findings",
    sql(
        f"""SELECT rule, CAST(c AS BIGINT) AS "count" FROM (SELECT 'bad_date' AS rule, count(*) FILTER (d IS NULL) AS c FROM s2 UNION ALL SELECT 'outside_window', count(*) FILTER (d < DATE '{C.target_start}' OR d > DATE '{C.target_end}') FROM s2 UNION ALL SELECT 'null_cluster', count(*) FILTER (cluster_code IS NULL) FROM s2
        UNION ALL SELECT 'not_a_number', count(*) FILTER (v IS NULL) FROM s2 UNION ALL SELECT 'negative', count(*) FILTER (v < 0) FROM s2 UNION ALL SELECT 'not_whole', count(*) FILTER (v <> floor(v)) FROM s2 UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (cluster_code, checkin)) FROM s2
        UNION ALL SELECT 'missing_pair', (SELECT count(*) FROM (SELECT city_code, checkin FROM grid EXCEPT SELECT cluster_code, d FROM s2)) UNION ALL SELECT 'unexpected_pair', (SELECT count(*) FROM (SELECT cluster_code, d FROM s2 EXCEPT SELECT city_code, checkin FROM grid))
        UNION ALL SELECT 'below_observed', (SELECT count(*) FROM s2 JOIN grid ON city_code = cluster_code AND grid.checkin = d WHERE v < observed) UNION ALL SELECT 'empty', 0)""",
        _SUB, _SB2,
    ),
)
def submission_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission with planted faults against what is expected."""
    grid = asof.forecast_grid(log(spark, sf_dir))
    c, h = F.col("city_code"), F.col("horizon")
    p = F.when((c % 13 == 5) & (h == 3), "x").when((c % 11 == 4) & (h == 4), "-1").when((c % 7 == 1) & (h == 5), "2.5").otherwise(F.col("observed").cast("string"))
    d = F.when((c % 17 == 3) & (h == 2), "1999/07/02").otherwise(F.date_format("checkin", "yyyy-MM-dd"))
    rows = grid.filter(~((c % 19 == 2) & (h == 6))).select(c.alias("cluster_code"), d.alias("checkin"), p.alias("predicted_demand"))
    rows = rows.unionByName(grid.filter((c % 23 == 1) & (h == 7)).select(c.alias("cluster_code"), day("checkin"), F.col("observed").cast("string").alias("predicted_demand")))
    rows = rows.unionByName(spark.createDataFrame([(999999, "1999-07-03", "1")], "cluster_code int, checkin string, predicted_demand string"))
    keys = grid.select(c.alias("cluster_code"), "checkin", "observed")
    return quality.submission_findings(rows, keys, keys, C)


@query("submission_check", sql("SELECT rule, CAST(0 AS BIGINT) AS \"count\" FROM (SELECT unnest(['bad_date', 'outside_window', 'null_cluster', 'not_a_number', 'negative', 'not_whole', 'duplicate_keys', 'missing_pair', 'unexpected_pair', 'below_observed', 'empty']) AS rule)"))
def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast's own submission passes every rule."""
    found = curves.pickup_forecast(log(spark, sf_dir))
    whole = F.greatest(F.rint("predicted_demand").cast("long"), F.col("observed"))
    rows = found.select(F.col("city_code").alias("cluster_code"), day("checkin"), whole.cast("string").alias("predicted_demand"))
    keys = found.select(F.col("city_code").alias("cluster_code"), "checkin", "observed")
    return quality.submission_findings(rows, keys, keys, C)


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        number = kind == "number"
        stat = lambda e, c=c, number=number: f"round({e.replace('X', c + '::DOUBLE')}, 5)" if number else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", {stat('min(X)')} AS min, {stat('max(X)')} AS max, {stat('avg(X)')} AS mean, {stat('stddev_samp(X)')} AS std, {stat('avg(CASE WHEN X = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_share, {stat('avg(CASE WHEN X < 0 THEN 1.0 ELSE 0.0 END)')} AS negative_share, {f'coalesce(bool_and({c} = floor({c})), false)' if number else 'false'} AS integer_like FROM {table}")
    return " UNION ALL ".join(parts)


@query("profile_customer", _profile_sql("customer", {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.profile(tables.table(spark, sf_dir, "customer")), 5)


@query("profile_events", _profile_sql("events", {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.profile(tables.table(spark, sf_dir, "events")), 5)


@query("frequency_gaps", panel_sql("SELECT round(quantile_cont(g, 0.5), 6) AS median_gap, CASE WHEN quantile_cont(g, 0.5) < 1 THEN 'h' WHEN quantile_cont(g, 0.5) <= 2 THEN 'D' WHEN quantile_cont(g, 0.5) <= 10 THEN 'W' WHEN quantile_cont(g, 0.5) <= 45 THEN 'MS' ELSE 'irregular' END AS frequency FROM (SELECT ds - lag(ds) OVER (PARTITION BY entity_id ORDER BY ds) AS g FROM pa)"))
def frequency_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.frequency(tables.demand_panel(spark, sf_dir), "ds", "entity_id"))


@query("transactional_check", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT (c_mktsegment, CAST(o_orderdate AS DATE))) AS BIGINT) AS keys, round(1 - count(DISTINCT (c_mktsegment, CAST(o_orderdate AS DATE))) / count(*), 6) AS duplicate_share, round(count(*) / count(DISTINCT (c_mktsegment, CAST(o_orderdate AS DATE))), 6) AS rows_per_key, 1 - count(DISTINCT (c_mktsegment, CAST(o_orderdate AS DATE))) / count(*) > 0.3 AND count(*) / count(DISTINCT (c_mktsegment, CAST(o_orderdate AS DATE))) > 1.5 AS is_transactional FROM orders JOIN customer ON o_custkey = c_custkey")
def transactional_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.transactional(tables.orders_panel(spark, sf_dir), ["category_id", "ds"]))


@query("null_ratios", panel_sql("SELECT 'entity_id' AS \"column\", 0.0::DOUBLE AS null_ratio UNION ALL SELECT 'ds', 0 UNION ALL SELECT 'y', 0 UNION ALL SELECT 'price', (SELECT round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM tl) UNION ALL SELECT 'observed', 0"))
def null_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.null_ratios(dense(spark, sf_dir)))


@query("leakage_suspects", "SELECT 'twice' AS \"column\", round(corr(2 * l_quantity + l_tax, l_quantity), 6) AS correlation FROM lineitem")
def leakage_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax"))
    return rounded(quality.suspects(rows, "l_quantity", ["twice", "l_discount", "l_tax"]))


@query("panel_outliers", panel_sql("SELECT tr.entity_id, strftime(ds, '%Y-%m-%d') AS ds, round(0.6745 * (y - m) / d, 6) AS robust_z FROM tr JOIN (SELECT tr.entity_id, x.m, quantile_cont(abs(y - x.m), 0.5) AS d FROM tr JOIN (SELECT entity_id, quantile_cont(y, 0.5) AS m FROM tr GROUP BY ALL) x ON x.entity_id = tr.entity_id GROUP BY ALL) s USING (entity_id) WHERE d > 0 AND abs(0.6745 * (y - m) / d) > 3", TR))
def panel_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.outliers(regions(spark, sf_dir), "y", "entity_id", 3.0).select("entity_id", "ds", "robust_z"))


@query("short_histories", "SELECT user_id AS entity_id, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY user_id HAVING count(*) < 60")
def short_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.short_histories(tables.activity(spark, sf_dir), "entity_id", 60)


#: Tables whose columns are taken as unknown, with the kinds of their columns.
_UNKNOWN = {
    "orders": {"o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text"},
    "events": {"event_id": "whole", "ts": "time", "user_id": "whole", "event_type": "text", "value": "number", "props": "text"},
    "lineitem": {"l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
}
_ASKED = ("category", "entity_id", "price", "target", "timestamp")
_WORDS = ", ".join(f"('{r}', '{w}')" for r in _ASKED for w in ROLES[r])
_FACTS = " UNION ALL ".join(
    f"SELECT '{t}' AS t, {i} AS p, '{c}' AS c, '{k}' AS kind, count({c}) AS n, count(DISTINCT {c}) AS d, {f'min({c}) < 0' if k in ('whole', 'number') else 'false'} AS neg, {f'coalesce(avg(CASE WHEN regexp_matches({c}, ' + chr(39) + r'^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}' + chr(39) + ') THEN 1.0 ELSE 0.0 END), 0)' if k == 'text' else '0.0'} AS ds FROM {t}"
    for t, columns in _UNKNOWN.items()
    for i, (c, k) in enumerate(columns.items())
)
_ROLES_SQL = f"""WITH words(role, w) AS (VALUES {_WORDS}), facts AS ({_FACTS}),
named AS (SELECT t, p, c, kind, n, d, neg, ds, role, max(CASE WHEN list_contains(string_split(c, '_'), w) THEN 1000 WHEN length(w) > 1 AND c LIKE '%' || replace(w, '_', '\\_') ESCAPE '\\' THEN 800 WHEN length(w) > 3 AND contains(c, w) THEN 500 WHEN role = 'price' THEN 0 ELSE 200 END) AS m FROM facts, words GROUP BY ALL),
ided AS (SELECT *, max(CASE WHEN role = 'entity_id' THEN m END) OVER (PARTITION BY t, c) >= 800 AS isid FROM named),
fits AS (SELECT t, p, c, role, CAST(floor(m * CASE WHEN role = 'timestamp' THEN CASE WHEN kind = 'time' THEN 10 WHEN ds >= 0.8 THEN 9 ELSE 0 END WHEN d < 2 THEN 0
 WHEN role = 'entity_id' THEN CASE WHEN kind NOT IN ('whole', 'text') OR ds >= 0.8 THEN 0 WHEN d > 0.9 * n THEN 3 WHEN n < 8 * d THEN 8 ELSE 10 END
 WHEN role = 'category' THEN CASE WHEN d > 50 THEN 0 WHEN kind = 'text' THEN 10 WHEN kind = 'whole' THEN 5 ELSE 0 END
 WHEN kind NOT IN ('whole', 'number') OR isid THEN 0 WHEN NOT neg THEN 10 WHEN role = 'target' THEN 7 ELSE 0 END / 10) AS INTEGER) AS x FROM ided),
ok AS (SELECT t, p, c, role, x FROM fits WHERE x >= 150 UNION ALL SELECT DISTINCT t, 999, NULL, role, 0 FROM fits),
a AS (SELECT * FROM ok WHERE role = 'category'), b AS (SELECT * FROM ok WHERE role = 'entity_id'), d AS (SELECT * FROM ok WHERE role = 'price'), e AS (SELECT * FROM ok WHERE role = 'target'), f AS (SELECT * FROM ok WHERE role = 'timestamp'),
ways AS (SELECT a.t, [a.c, b.c, d.c, e.c, f.c] AS cs, [a.x, b.x, d.x, e.x, f.x] AS xs, [a.p, b.p, d.p, e.p, f.p] AS ps, a.x + b.x + d.x + e.x + f.x AS total FROM a JOIN b ON a.t = b.t AND (a.c IS NULL OR a.c IS DISTINCT FROM b.c) JOIN d ON a.t = d.t AND (d.c IS NULL OR d.c IS DISTINCT FROM a.c AND d.c IS DISTINCT FROM b.c) JOIN e ON a.t = e.t AND (e.c IS NULL OR e.c IS DISTINCT FROM a.c AND e.c IS DISTINCT FROM b.c AND e.c IS DISTINCT FROM d.c) JOIN f ON a.t = f.t AND (f.c IS NULL OR f.c IS DISTINCT FROM a.c AND f.c IS DISTINCT FROM b.c AND f.c IS DISTINCT FROM d.c AND f.c IS DISTINCT FROM e.c)),
won AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY t ORDER BY total DESC, ps) = 1)
SELECT "table", role, "column", points FROM (SELECT t AS "table", unnest({list(_ASKED)}) AS role, unnest(cs) AS "column", unnest(xs) AS points FROM won) WHERE "column" IS NOT NULL"""


@query("suggested_roles", _ROLES_SQL)
def suggested_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of three tables are most likely for, all roles of a table chosen together."""
    found = [roles.suggested_roles(tables.table(spark, sf_dir, t)).withColumn("table", F.lit(t)) for t in _UNKNOWN]
    return reduce(DataFrame.unionByName, found).select("table", "role", "column", "points")
