"""Profiles, clusters and pooled panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES as C
from leadtide.operators import asof, clusters, curves
from leadtide.plans.base import day, log, rounded, sql
from leadtide.plans.features import _HD
from leadtide.registry import query
from leadtide.sources import tables

_WEEK = ", ".join(f"coalesce(avg(n) FILTER (wd = {k}), 0) AS w{k}" for k in range(7))
PF = f"""pf AS (SELECT x.*, ci.province_code, ci.lat, ci.long, volume / (SELECT sum(n) FROM hd) AS demand_share, ln(1 + volume) AS log_volume, std / greatest(mean, 1e-6) AS volatility, p75 / greatest(mean, 1e-6) AS p75_over_mean, p90 / greatest(mean, 1e-6) AS p90_over_mean,
    {', '.join(f'CASE WHEN volume > 0 THEN w{k} / greatest(w0 + w1 + w2 + w3 + w4 + w5 + w6, 1e-6) ELSE 1 / 7.0::DOUBLE END AS weekday_share_{k}' for k in range(7))}, CASE WHEN volume > 0 THEN (w3 + w4) / 2 / greatest((w0 + w1 + w2 + w5 + w6) / 5, 1e-6) ELSE 1 END AS weekend_ratio
    FROM (SELECT city_code, CAST(sum(n) AS BIGINT) AS volume, avg(n) AS mean, stddev_pop(n) AS std, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.9) AS p90, avg(CASE WHEN n <= 0 THEN 1.0 ELSE 0.0 END) AS zero_day_share, {_WEEK} FROM hd GROUP BY city_code) x JOIN ci USING (city_code))"""
_NUM = ("mean", "std", "zero_day_share", "log_volume", "volatility", "p75_over_mean", "p90_over_mean", *(f"weekday_share_{k}" for k in range(7)), "weekend_ratio", "demand_share", "lat", "long")
#: The clustering of the queries with SQL: cities whose codes agree in all but the last digit.
MP = "mp AS (SELECT city_code, province_code, min(city_code) OVER (PARTITION BY province_code, city_code // 10) AS cluster_code FROM ci)"


def _mapping(cities: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    block = F.floor(F.col("city_code") / 10)
    return cities.select("city_code", F.min("city_code").over(Window.partitionBy("province_code", block)).alias("cluster_code"))


@query("city_profiles", sql("SELECT city_code, province_code, volume, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUM) + " FROM pf", _HD, PF))
def city_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.city_profiles(log(spark, sf_dir)).select("city_code", "province_code", "volume", *_NUM))


_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-6 THEN stddev_pop({c}) OVER () ELSE 1 END / {len(names) ** 0.5!r}, 5) AS {c}" for names in clusters.BLOCKS.values() for c in names)


@query("city_profiles_scaled", sql(f"SELECT city_code, {_Z} FROM pf", _HD, PF))
def city_profiles_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.standardised(clusters.city_profiles(log(spark, sf_dir))).drop("province_code", "volume", "demand_share"), 5)


@query("protected_hubs", sql("SELECT city_code, round(demand_share, 6) AS demand_share FROM pf WHERE demand_share >= 0.0105", _HD, PF))
def protected_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.hubs(clusters.city_profiles(log(spark, sf_dir)), 0.0105).select("city_code", "demand_share"))


@query("ward_merges")
def ward_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dendrograms(clusters.standardised(clusters.city_profiles(log(spark, sf_dir))), 1.0)


@query("ward_clusters")
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    profiles = clusters.city_profiles(data)
    merges = clusters.dendrograms(clusters.standardised(profiles), 1.0)
    return rounded(clusters.cluster_table(profiles, clusters.cut(data.cities, merges, 2.0)))


@query("cluster_heights")
def cluster_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.height_ladder(clusters.dendrograms(clusters.standardised(clusters.city_profiles(log(spark, sf_dir))), 1.0), 6))


@query(
    "cluster_table",
    sql(
        """SELECT cluster_code, min(pf.province_code) AS province_code, round(sum(lat * greatest(volume, 1)) / sum(greatest(volume, 1)), 6) AS lat, round(sum(long * greatest(volume, 1)) / sum(greatest(volume, 1)), 6) AS long, CAST(count(*) AS BIGINT) AS n_cities_in_cluster,
        CAST(sum(volume) AS BIGINT) AS cluster_volume, min(volume) AS cluster_min_member_volume, max(volume) AS cluster_max_member_volume, CASE WHEN sum(volume) > 0 THEN round(max(volume) / sum(volume), 6) ELSE 1 END AS cluster_max_member_share FROM pf JOIN mp USING (city_code) GROUP BY cluster_code""",
        _HD, PF, MP,
    ),
)
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(clusters.cluster_table(clusters.city_profiles(data), _mapping(data.cities)))


@query("cluster_members", sql("SELECT city_code, cluster_code, round(CASE WHEN sum(volume) OVER w > 0 THEN volume / sum(volume) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS member_share FROM pf JOIN mp USING (city_code) WINDOW w AS (PARTITION BY cluster_code)", _HD, PF, MP))
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(clusters.member_shares(clusters.city_profiles(data), _mapping(data.cities)).select("city_code", "cluster_code", "member_share"))


@query("cluster_names", sql("SELECT cluster_code, CASE WHEN count(*) > 1 THEN arg_min(city, (-volume, city_code)) || ' +' || (count(*) - 1) ELSE min(city) END AS name FROM pf JOIN mp USING (city_code) JOIN (SELECT city_code, city FROM ci) USING (city_code) GROUP BY cluster_code", _HD, PF, MP))
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return clusters.cluster_names(clusters.city_profiles(data), _mapping(data.cities), data.cities)


@query("clustered_events", sql("SELECT strftime(log_date, '%Y-%m-%d') AS log_date, cluster_code AS city_code, strftime(checkin, '%Y-%m-%d') AS checkin, lead AS days_to_checkin, CAST(sum(n) AS BIGINT) AS search_count FROM ev JOIN mp USING (city_code) GROUP BY ALL", MP))
def clustered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.rekeyed(tables.events(spark, sf_dir), _mapping(tables.cities(spark, sf_dir)))
    return found.select(day("log_date"), "city_code", day("checkin"), "days_to_checkin", "search_count")


PN = "pn AS (SELECT cluster_code, checkin, CAST(sum(observed) AS BIGINT) AS observed, sum(predicted) AS predicted, CAST(sum(actual) AS BIGINT) AS actual FROM pred JOIN (SELECT city_code, cluster_code FROM mp) USING (city_code) GROUP BY ALL)"


@query("pooled_panel", sql("SELECT cluster_code, strftime(checkin, '%Y-%m-%d') AS checkin, observed, round(predicted, 6) AS predicted_demand, actual FROM pn", MP, PN))
def pooled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    panel = curves.pickup_forecast(data, asof.fold_frame(data))
    return rounded(clusters.pooled_panel(panel, _mapping(data.cities)))


@query(
    "blended_panel",
    sql(
        """SELECT p.city_code, strftime(p.checkin, '%Y-%m-%d') AS checkin, round(w, 6) AS blend_weight, round(greatest(p.observed + w * (p.predicted - p.observed) + (1 - w) * coalesce(s * (pn.predicted * 0.9 - pn.observed * 0.9), 0), p.observed), 6) AS blended_demand
        FROM pred p JOIN (SELECT city_code, cluster_code, CASE WHEN sum(volume) OVER c > 0 THEN volume / sum(volume) OVER c ELSE 1.0 / count(*) OVER c END AS s, CASE WHEN count(*) OVER c <= 1 THEN 1.0 ELSE volume / (volume + 1000.0) END AS w FROM pf JOIN (SELECT city_code, cluster_code FROM mp) USING (city_code) WINDOW c AS (PARTITION BY cluster_code)) x USING (city_code)
        LEFT JOIN pn ON pn.cluster_code = x.cluster_code AND pn.checkin = p.checkin""",
        _HD, PF, MP, PN,
    ),
)
def blended_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City forecasts and nine tenths of what their clusters still expect, a thousand searches the balance."""
    data = log(spark, sf_dir)
    mapping = _mapping(data.cities)
    panel = curves.pickup_forecast(data, asof.fold_frame(data))
    pooled = clusters.pooled_panel(panel, mapping).withColumns({"predicted_demand": F.col("predicted_demand") * 0.9, "observed": F.col("observed") * 0.9})
    found = clusters.blended(panel, pooled, clusters.city_profiles(data), mapping, 1000.0)
    return rounded(found.select("city_code", "checkin", "blend_weight", "blended_demand"))


@query(
    "merged_error",
    sql(
        "SELECT kind, CAST(count(*) AS BIGINT) AS rows, round(sum(actual) / (SELECT sum(actual) FROM pn), 6) AS actual_share, round(sum(abs(actual - predicted)), 6) AS absolute_error, round(sum(abs(actual - predicted)) / (SELECT sum(actual) FROM pn), 6) AS wape_contribution FROM (SELECT pn.*, CASE WHEN (SELECT count(*) FROM mp WHERE mp.cluster_code = pn.cluster_code) > 1 THEN 'merged' ELSE 'single' END AS kind FROM pn) GROUP BY kind",
        MP, PN,
    ),
)
def merged_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(clusters.merged_error(curves.pickup_forecast(data, asof.fold_frame(data)), _mapping(data.cities)))


@query("merged_rows", sql("SELECT city_code, strftime(checkin, '%Y-%m-%d') AS checkin, observed FROM grid WHERE city_code IN (SELECT city_code FROM mp WHERE cluster_code IN (SELECT cluster_code FROM mp GROUP BY 1 HAVING count(*) > 1))", MP))
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = log(spark, sf_dir)
    return rounded(clusters.merged_rows(asof.forecast_grid(data), _mapping(data.cities)).select("city_code", "checkin", "observed"))
