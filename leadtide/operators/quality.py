"""Findings about logs, submissions and panels; profiles of unknown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.config import Config

#: What a finding costs, by severity, and the grades.
PENALTY = {"critical": 25, "high": 12, "medium": 6, "low": 2, "info": 0}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"), (0, "F"))


def rules(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, count: rows that break each rule, all in one pass."""
    sums = df.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("count")) for n in checks))).alias("r")).select("r.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return found.agg(F.lit("duplicate_keys").alias("rule"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("count"))


def missing(left: DataFrame, right: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("count"))


def event_findings(events: DataFrame, cities: DataFrame, cfg: Config) -> DataFrame:
    """One row a rule over the event log and its dimension."""
    nulls = F.lit(False)
    for c in ("log_date", "city_code", "checkin", "search_count"):
        nulls = nulls | F.col(c).isNull()
    lead = F.datediff("checkin", "log_date")
    out = rules(events, {"count_below_one": F.col("search_count") < 1, "checkin_before_log": lead < 0, "lead_too_long": lead > cfg.max_lead, "null_in_key": nulls})
    out = out.unionByName(duplicates(events, ["log_date", "city_code", "checkin"]))
    out = out.unionByName(missing(events, cities, ["city_code"], "unknown_city")).unionByName(missing(cities, events, ["city_code"], "silent_city"))
    # The two files of the log: what has passed at the cutoff, and what was logged by then of the target. Cut from one
    # log they can't overlap; files that come apart are compared by overlap() itself.
    history = events.filter(F.col("checkin") <= F.lit(cfg.cutoff))
    target = events.filter((F.col("checkin") > F.lit(cfg.cutoff)) & (F.col("log_date") <= F.lit(cfg.cutoff)))
    found = overlap(history, target, ["log_date", "city_code", "checkin"], "checkin")
    return out.unionByName(found.select(F.lit("overlap_of_files").alias("rule"), F.col("shared_keys").alias("count")))


def overlap(earlier: DataFrame, later: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Whether the dates of two files that should follow each other overlap, and how many keys both have."""
    last, first = earlier.agg(F.max(day).alias("_last")), later.agg(F.min(day).alias("_first"))  # one row each
    shared = earlier.select(*keys).distinct().join(later.select(*keys).distinct(), keys).agg(F.count(F.lit(1)).alias("shared_keys"))
    return last.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(shared)).select(F.coalesce(F.col("_last") >= F.col("_first"), F.lit(False)).alias("ranges_overlap"), "shared_keys")


def column_findings(df: DataFrame, columns: list[str], most: int = 200) -> DataFrame:
    """name, distinct_values, is_constant, high_cardinality (over ``most`` values and half of the rows).

    Values are counted by (column, value), so a row is spread once over its columns and nothing is expanded again.
    """
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x"))
    counted = pairs.groupBy("x.name", "x.v").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy("name").agg(F.count("v").alias("distinct_values"), F.sum("n").alias("_rows"))
    return out.select("name", "distinct_values", (F.col("distinct_values") <= 1).alias("is_constant"), ((F.col("distinct_values") > most) & (F.col("distinct_values") > 0.5 * F.col("_rows"))).alias("high_cardinality"))


def event_summary(events: DataFrame) -> DataFrame:
    lead = F.datediff("checkin", "log_date")
    return events.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("city_code").alias("cities"), F.sum("search_count").alias("searches"), F.min("log_date").alias("first_log"), F.max("log_date").alias("last_log"), F.min("checkin").alias("first_checkin"), F.max("checkin").alias("last_checkin"), F.min(lead).alias("least_lead"), F.max(lead).alias("greatest_lead"))


def submission_findings(result: DataFrame, expected: DataFrame, observed: DataFrame, cfg: Config) -> DataFrame:
    """All rules of a submission (cluster_code, checkin as text, predicted_demand as text) at once.

    expected: the keys it must have; observed: what it must not be below.
    """
    day = F.to_date(F.try_to_timestamp("checkin", F.lit("yyyy-MM-dd")))
    number = F.expr("try_cast(predicted_demand AS double)")
    rows = result.withColumns({"_day": day, "_n": number})
    checks = {
        "bad_date": F.col("_day").isNull(),
        "outside_window": (F.col("_day") < F.lit(cfg.target_start)) | (F.col("_day") > F.lit(cfg.target_end)),
        "null_cluster": F.col("cluster_code").isNull(),
        "not_a_number": F.col("_n").isNull() | F.isnan("_n") | (F.abs("_n") == float("inf")),
        "negative": F.col("_n") < 0,
        "not_whole": F.col("_n") != F.rint("_n"),
    }
    out = rules(rows, checks).unionByName(duplicates(result, ["cluster_code", "checkin"]))
    keys = rows.select("cluster_code", F.col("_day").alias("checkin"), F.col("_n").alias("n"))
    out = out.unionByName(missing(expected, keys, ["cluster_code", "checkin"], "missing_pair")).unionByName(missing(keys, expected, ["cluster_code", "checkin"], "unexpected_pair"))
    below = keys.join(observed, ["cluster_code", "checkin"]).agg(F.lit("below_observed").alias("rule"), F.count_if(F.col("n") < F.col("observed")).alias("count"))
    size = result.agg(F.lit("empty").alias("rule"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("count"))
    return out.unionByName(below).unionByName(size)


def profile(df: DataFrame) -> DataFrame:
    """column, kind, rows, nulls, distinct, min, max, mean, std, zero and negative shares; one pass, unpivoted.

    Distinct values are exact: each column counts its own, so wide tables are better profiled in parts.
    """
    parts = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        number = kind in ("int", "bigint", "double", "float", "smallint")
        c = F.col(f.name)
        d = c.cast("double") if number else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit("number" if number else "time" if kind.startswith(("timestamp", "date")) else "text").alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.countDistinct(c).alias("distinct"),
                F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.avg((d == 0).cast("double")).alias("zero_share"), F.avg((d < 0).cast("double")).alias("negative_share"),
                F.coalesce(F.bool_and(d == F.floor(d)), F.lit(False)).alias("integer_like"),
            )
        )
    made = df.agg(*(p.alias(f"_{i}") for i, p in enumerate(parts)))
    return made.select(F.explode(F.array(*(f"_{i}" for i in range(len(parts))))).alias("p")).select("p.*")


def frequency(df: DataFrame, day: str, by: str) -> DataFrame:
    """The median gap in days between an entity's dates, and the frequency it stands for."""
    order = Window.partitionBy(by).orderBy(day)
    gaps = df.select(by, day).distinct().withColumn("_gap", F.datediff(day, F.lag(day).over(order)))
    out = gaps.agg(F.percentile("_gap", F.lit(0.5)).alias("median_gap"))
    g = F.col("median_gap")
    return out.withColumn("frequency", F.when(g < 1, "h").when(g <= 2, "D").when(g <= 10, "W").when(g <= 45, "MS").otherwise("irregular"))


def transactional(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether rows are single transactions: keys repeat in over 0.3 of rows, and over 1.5 rows a key."""
    pairs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys"))
    share, per = 1 - F.try_divide("keys", "rows"), F.try_divide("rows", "keys")
    return pairs.withColumns({"duplicate_share": share, "rows_per_key": per, "is_transactional": (share > 0.3) & (per > 1.5)})


def null_ratios(df: DataFrame) -> DataFrame:
    made = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return made.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_ratio")) for c in df.columns))).alias("r")).select("r.*")


def suspects(df: DataFrame, target: str, columns: list[str], least: float = 0.9, top: int = 5) -> DataFrame:
    """Columns that follow the target suspiciously closely."""
    made = df.agg(*(F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns))
    long = made.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("correlation")) for c in columns))).alias("r")).select("r.*")
    return long.filter(F.abs("correlation") >= least).orderBy(F.desc(F.abs("correlation")), "column").limit(top)


def outliers(df: DataFrame, value: str, by: str, least: float = 10.0) -> DataFrame:
    """Rows whose distance from the entity's median is over ``least`` of its median deviations."""
    mid = df.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    rows = df.join(mid, by)
    mad = rows.groupBy(by).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_d"))
    return rows.join(mad, by).withColumn("robust_z", F.try_divide(0.6745 * (F.col(value) - F.col("_m")), F.col("_d"))).filter(F.abs("robust_z") > least).drop("_m", "_d")


def short_histories(df: DataFrame, by: str, least: int) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < least)


def health(findings: list[str]) -> tuple[int, str]:
    """A score from severities, and its grade."""
    score = max(0, 100 - sum(PENALTY[x] for x in findings))
    return score, next(grade for least, grade in GRADES if score >= least)
