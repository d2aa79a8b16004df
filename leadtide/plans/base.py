"""What queries share: the log at the default cutoff, and the SQL of its parts for the other engine.

The SQL is written on its own terms (grids are made, curves come from inequality joins), so that it
checks the Spark plans instead of repeating them.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.config import TABLES, Config
from leadtide.sources.tables import Log


def log(spark: SparkSession, sf_dir: str, cfg: Config = TABLES) -> Log:
    return Log(spark, sf_dir, cfg)


def folds(spark: SparkSession, sf_dir: str, cfg: Config = TABLES) -> Log:
    """The log at all simulated cutoffs."""
    return Log(spark, sf_dir, cfg, cfg.fold_cutoffs)


def day(col: str) -> Column:
    """Dates leave queries as text, which all engines compare alike."""
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Dates as text and doubles rounded, for comparison; ``other``: digits of single columns."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(F.round(f.name, other.get(f.name, digits)).alias(f.name) if kind == "double" else day(f.name) if kind == "date" else F.col(f.name))
    return df.select(*out)


EVENTS = """ev AS (
    SELECT CAST(l_shipdate AS DATE) - CAST((l_orderkey * 7 + l_linenumber * 13) % 60 AS INTEGER) AS log_date,
           CAST(l_suppkey AS INTEGER) AS city_code, CAST(l_shipdate AS DATE) AS checkin,
           CAST((l_orderkey * 7 + l_linenumber * 13) % 60 AS INTEGER) AS lead,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
    FROM lineitem GROUP BY ALL)"""
CITIES = """ci AS (
    SELECT CAST(s_suppkey AS INTEGER) AS city_code, n_regionkey AS province_code,
           25 + (s_suppkey * 37 % 1500) / 100.0::DOUBLE AS lat, 44 + (s_suppkey * 53 % 1900) / 100.0::DOUBLE AS long,
           s_name AS city, r_name AS province
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def buckets_sql(col: str, cfg: Config = TABLES, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in cfg.horizon_buckets) + f" ELSE {other} END"


def fold_sql(cfg: Config = TABLES, s: str = "") -> list[str]:
    """CTEs with suffix ``s``: hist, evl, grid (with observed, actual), the curves, zero, pred."""
    c = cfg.cutoff
    h, late = cfg.target_days, 0 if not cfg.strict_zero_prior else 1
    return [
        f"hist{s} AS (SELECT ev.*, province_code FROM ev LEFT JOIN ci USING (city_code) WHERE checkin <= DATE '{c}')",
        f"evl{s} AS (SELECT * FROM ev WHERE checkin > DATE '{c}' AND checkin <= DATE '{cfg.target_end}' AND log_date <= DATE '{c}')",
        f"""grid{s} AS (SELECT g.*, CAST(coalesce(o.n, 0) AS BIGINT) AS observed, CAST(coalesce(f.n, 0) AS BIGINT) AS actual FROM
            (SELECT city_code, province_code, CAST(d AS DATE) AS checkin, CAST(CAST(d AS DATE) - DATE '{c}' AS INTEGER) AS horizon
             FROM ci, generate_series(DATE '{cfg.target_start}', DATE '{cfg.target_end}', INTERVAL 1 DAY) t(d)) g
            LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM ev WHERE log_date <= DATE '{c}' GROUP BY ALL) o USING (city_code, checkin)
            LEFT JOIN (SELECT city_code, checkin, sum(n) AS n FROM ev GROUP BY ALL) f USING (city_code, checkin))""",
        f"steps{s} AS (SELECT CAST(h AS INTEGER) AS h FROM range(0, {cfg.max_lead + 1}) t(h))",
        f"""cc{s} AS (SELECT city_code AS key, h, CAST(sum(CASE WHEN lead >= h THEN n ELSE 0 END) AS BIGINT) / sum(n)::DOUBLE AS f, CAST(sum(n) AS BIGINT) AS support
            FROM hist{s}, steps{s} GROUP BY ALL HAVING sum(n) >= {cfg.min_city_support})""",
        f"""pc{s} AS (SELECT province_code AS key, h, CAST(sum(CASE WHEN lead >= h THEN n ELSE 0 END) AS BIGINT) / sum(n)::DOUBLE AS f, CAST(sum(n) AS BIGINT) AS support
            FROM hist{s}, steps{s} WHERE province_code IS NOT NULL GROUP BY ALL HAVING sum(n) >= {cfg.min_province_support})""",
        f"""gc{s} AS (SELECT h, CAST(sum(CASE WHEN lead >= h THEN n ELSE 0 END) AS BIGINT) / sum(n)::DOUBLE AS f, CAST(sum(n) AS BIGINT) AS support FROM hist{s}, steps{s} GROUP BY ALL)""",
        f"""hp{s} AS (SELECT city_code, province_code, CAST(d AS DATE) AS checkin, coalesce(n, 0) AS n,
                CASE WHEN coalesce(n, 0) > 0 THEN least(greatest(lead + 1 - {late}, 0), {h}) ELSE 0 END AS bucket
            FROM (SELECT city_code, province_code, d FROM ci, generate_series((SELECT min(checkin) FROM hist{s}), DATE '{c}', INTERVAL 1 DAY) t(d)) g
            LEFT JOIN (SELECT city_code, checkin, sum(n) AS n, max(lead) AS lead FROM hist{s} GROUP BY ALL) p ON p.city_code = g.city_code AND p.checkin = CAST(g.d AS DATE))"""
        .replace("SELECT city_code, province_code, CAST(d", "SELECT g.city_code, province_code, CAST(d"),
        f"hz{s} AS (SELECT CAST(h AS INTEGER) AS horizon FROM range(1, {h + 1}) t(h))",
        f"""zp{s} AS (SELECT city_code, horizon, sum(CASE WHEN bucket < horizon THEN n ELSE 0 END)::DOUBLE / greatest(count(*) FILTER (bucket < horizon), 1) AS expected FROM hp{s}, hz{s} GROUP BY ALL)""",
        f"""pred{s} AS (SELECT g.*, greatest(least(coalesce(cc.f, pc.f, gc.f), 1.0), {cfg.min_fraction}) AS fraction,
                CASE WHEN cc.f IS NOT NULL THEN 'city' WHEN pc.f IS NOT NULL THEN 'province' ELSE 'global' END AS source,
                CASE WHEN observed > 0 THEN greatest(observed / greatest(least(coalesce(cc.f, pc.f, gc.f), 1.0), {cfg.min_fraction}), observed) ELSE zp.expected END AS predicted
            FROM grid{s} g LEFT JOIN cc{s} cc ON cc.key = city_code AND cc.h = g.horizon LEFT JOIN pc{s} pc ON pc.key = province_code AND pc.h = g.horizon
            LEFT JOIN gc{s} gc ON gc.h = g.horizon LEFT JOIN zp{s} zp ON zp.city_code = g.city_code AND zp.horizon = g.horizon)""",
    ]


def sql(body: str, *more: str, cfg: Config = TABLES, folds: bool = False) -> str:
    """A statement over the CTEs above; ``more`` are further CTEs."""
    parts = [EVENTS, CITIES]
    if folds:
        for i, cutoff in enumerate(cfg.fold_cutoffs):
            parts += fold_sql(cfg.at(cutoff), f"_{i}")
    else:
        parts += fold_sql(cfg)
    return "WITH " + ",\n".join([*parts, *more]) + "\n" + body


def days_before(d, n: int):
    return d - timedelta(days=n)
