"""Readers of event logs, dimensions and unknown tables; the contract that gives columns their roles."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadtide.functions.text import column_name, lenient_date
from leadtide.sources.sheets import read_sheet

EVENTS = T.StructType([T.StructField("log_date", T.DateType()), T.StructField("city_code", T.IntegerType()), T.StructField("checkin", T.DateType()), T.StructField("search_count", T.LongType())])
CITIES = T.StructType([T.StructField("city_code", T.IntegerType()), T.StructField("province_code", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("long", T.DoubleType())])
NAMES = T.StructType([T.StructField("city", T.StringType()), T.StructField("city_code", T.IntegerType()), T.StructField("province", T.StringType()), T.StructField("province_code", T.IntegerType())])


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """Only these columns; a missing one is an error, further ones are dropped."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{what} lacks the columns {', '.join(lacking)}")
    return df.select(*columns)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType, what: str) -> DataFrame:
    """A CSV file with a header, in any order of columns, as the types of a schema; no inference pass.

    A value that is not of its type is null, for the quality rules to count.
    """
    raw = require(spark.read.option("header", True).csv(path), schema.names, what)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def read_events(spark: SparkSession, path: str, what: str = "the event log") -> DataFrame:
    rows = typed_csv(spark, path, EVENTS, what)
    return rows.withColumn("days_to_checkin", F.datediff("checkin", "log_date"))


def read_dimension(spark: SparkSession, path: str, schema: T.StructType = CITIES, key: str = "city_code") -> DataFrame:
    """Rows without any value go; of rows with one key the least stays."""
    rows = typed_csv(spark, path, schema, "the dimension").na.drop("all")
    order = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in schema.names))
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def delimiter(spark: SparkSession, path: str) -> str:
    """The separator of a text table, from its first lines; read by Spark, so any store will do."""
    lines = [r.value for r in spark.read.text(path).limit(20).collect()]
    try:
        return csv.Sniffer().sniff("\n".join(lines), ",;\t|").delimiter
    except csv.Error:
        return ","


def read_tabular(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A table by the ending of its name: csv, tsv, txt, parquet, json, jsonl, xlsx (the first sheet)."""
    end = PurePosixPath(path).suffix.lower()
    if end == ".parquet":
        df = spark.read.parquet(path)
    elif end in (".json", ".jsonl", ".ndjson"):
        df = spark.read.option("multiLine", end == ".json").json(path)
    elif end in (".csv", ".tsv", ".txt"):
        df = spark.read.options(header=True, sep="\t" if end == ".tsv" else delimiter(spark, path), inferSchema=True).csv(path)
    elif end in (".xlsx", ".xlsm"):
        df = read_sheet(spark, path)
    elif end == ".xls":
        raise ValueError("binary spreadsheets can't be read: save the sheet as xlsx or CSV")
    else:
        raise ValueError(f"no reader for {end or 'a name without an ending'}")
    return df if rows is None else df.limit(rows)


def read_holidays(df: DataFrame) -> DataFrame:
    """ds, is_holiday from a table with a column named like a date; without a flag every row is one."""
    day = next((c for c in df.columns if column_name(c) in ("date", "ds", "day", "timestamp")), None)
    if day is None:
        raise ValueError("a holiday table needs a column named date, ds, day or timestamp")
    flag = next((c for c in df.columns if "holiday" in column_name(c)), None)
    on = F.coalesce((F.col(flag).cast("double") > 0), F.lit(False)) if flag else F.lit(True)
    return df.select(lenient_date(F.col(day).cast("string")).alias("ds"), on.cast("int").alias("is_holiday")).filter("ds IS NOT NULL").groupBy("ds").agg(F.max("is_holiday").alias("is_holiday"))


def read_overrides(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Given future values: a date column under any of its names becomes ds; without entities they hold for all."""
    day = next((c for c in df.columns if c in ("ds", "date", "timestamp", "day")), None)
    if day is None:
        raise ValueError("overrides need a column ds, date, timestamp or day")
    out = df.withColumn("ds", lenient_date(F.col(day).cast("string")))
    out = out if day == "ds" else out.drop(day)
    return out if entity in out.columns else out.withColumn(entity, F.lit(None).cast("string"))


@dataclass
class Contract:
    """Which columns of a table have which roles."""

    timestamp: str
    entity_id: str | None = None
    target: str | None = None
    destination: str | None = None
    category: str | None = None
    price: list[str] = field(default_factory=list)
    aggregate: str = "sum"

    def canonical(self, df: DataFrame) -> DataFrame:
        """ds, entity_id, y and the other roles under their names; further columns stay as they are."""
        names = {self.timestamp: "ds", self.entity_id: "entity_id", self.target: "y", self.destination: "destination_id", self.category: "category_id"}
        require(df, [c for c in names if c], "the table")
        out = df.select(*(F.col(c).alias(names.get(c, column_name(c))) for c in df.columns))
        kind = out.schema["ds"].dataType.simpleString()
        day = F.to_date("ds") if kind.startswith(("timestamp", "date")) else lenient_date("ds")
        out = out.withColumn("ds", day)
        return out if self.entity_id else out.withColumn("entity_id", F.lit("all"))
