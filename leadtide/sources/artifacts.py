"""Tables and documents of a run: written whole or not at all, with digests and manifests."""

from __future__ import annotations

import hashlib
import inspect
import json
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _path(spark, path)
    return store.exists(at)


def _replace(spark: SparkSession, fresh: str, path: str) -> None:
    new, store = _path(spark, fresh)
    old, _ = _path(spark, path)
    store.mkdirs(old.getParent())
    # The table that was there steps aside first, so a crash in between leaves one of the two.
    aside = None
    if store.exists(old):
        aside, _ = _path(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
        if not store.rename(old, aside):
            raise OSError(f"{path} could not be moved aside")
    if not store.rename(new, old):
        if aside is not None:
            store.rename(aside, old)
        raise OSError(f"{path} could not be replaced")
    if aside is not None:
        store.delete(aside, True)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Parquet with zstd, written beside and then renamed."""
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(fresh)
    _replace(spark, fresh, path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A result as one CSV file with a header, for people: only for results of a bounded size."""
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(fresh)
    _replace(df.sparkSession, fresh, path)


def strict(value):
    """The same without NaN and infinities."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict(v) for v in value]
    return value


def write_json(spark: SparkSession, value, path: str) -> None:
    """Strict JSON, written beside and then renamed."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    at, store = _path(spark, fresh)
    out = store.create(at)
    out.write(bytearray(json.dumps(strict(value), ensure_ascii=False, indent=2, allow_nan=False).encode()))
    out.close()
    _replace(spark, fresh, path)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: sums of two hashes of each row, and the count."""
    row = F.struct(*sorted(df.columns))
    sums = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.hash(row).cast("decimal(38,0)"))).first()
    return "-".join(str(x or 0) for x in sums)


def verify(df: DataFrame, expected: str, what: str) -> DataFrame:
    """The table, if its digest is the one expected."""
    found = digest(df)
    if found != expected:
        raise ValueError(f"{what} is not the table it was made from: {found}, not {expected}")
    return df


def manifest(df: DataFrame, target: str, by: str) -> dict:
    """What a training table holds: rows, schema, target quantiles, rows by horizon, digest."""
    q = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    head = df.agg(F.count(F.lit(1)).alias("n"), F.percentile(target, F.array(*map(F.lit, q))).alias("q")).first()
    rows = {str(r[0]): r[1] for r in df.groupBy(by).agg(F.count(F.lit(1))).collect()}  # a row a horizon
    return {"rows": head.n, "schema": df.schema.simpleString(), "target_quantiles": dict(zip(map(str, q), head.q or [], strict=False)), f"rows_by_{by}": rows, "digest": digest(df)}


def load_training(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """A training table, if schema and digest are those of its manifest."""
    df = spark.read.parquet(path)
    if df.schema.simpleString() != about["schema"]:
        raise ValueError(f"{path} has another schema than its manifest")
    return verify(df, about["digest"], path)


_read: dict[str, tuple[int, DataFrame]] = {}


def changed(spark: SparkSession, path: str) -> int:
    """The latest modification time below a path."""
    at, store = _path(spark, path)
    return max((x.getModificationTime() for x in store.listStatus(at)), default=0)


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table that is read once and kept in memory until its files change."""
    key, now = f"{spark.sparkContext.applicationId}:{path}", changed(spark, path)
    held = _read.get(key)
    if held is None or held[0] != now:
        if held is not None:
            held[1].unpersist()
        spark.catalog.refreshByPath(path)
        _read[key] = (now, spark.read.parquet(path).cache())
    return _read[key][1]


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is made only where it is not there yet."""
    return spark.read.parquet(path) if exists(spark, path) else write_table(make(), path)


def write_run(spark: SparkSession, path: str, tables: dict[str, DataFrame], documents: dict) -> None:
    """All tables and documents of a run below one path."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")
    for name, value in documents.items():
        write_json(spark, value, f"{path}/{name}.json")


#: Bytes of a file that one row of ``file_digests`` stands for.
CHUNK = 64 << 20


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        out = []
        for path, start, size in zip(batch["path"], batch["start"], batch["size"], strict=True):
            store, name = FileSystem.from_uri(path)
            own, left = hashlib.sha256(), int(size)
            with store.open_input_file(name) as file:
                file.seek(int(start))
                while left and (block := file.read(min(left, 1 << 20))):
                    own.update(block)
                    left -= len(block)
            if left:
                raise OSError(f"{path} is shorter than it was when listed")
            out.append(own.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "start": batch["start"], "size": batch["size"], "own": out})


def file_digests(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """path, bytes, sha256 of each file at or below a path.

    Files are cut into chunks that tasks read in blocks, so no file is held whole; the digest is that of the chunks' digests
    in order (of a file of one chunk too). Files without a byte have no row, as Spark passes them over.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").filter("length > 0")
    parts = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start"), "length")
    parts = parts.select("path", "start", F.least(F.lit(chunk), F.col("length") - F.col("start")).cast("long").alias("size"))
    hashed = parts.repartition(4 * spark.sparkContext.defaultParallelism, "path", "start").mapInPandas(_hashed, "path string, start long, size long, own string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "own"))), lambda x: x["own"])
    return hashed.groupBy("path").agg(F.sum("size").alias("bytes"), F.sha2(F.concat_ws("", ordered), 256).alias("sha256"))


def input_digest(spark: SparkSession, *paths: str) -> str:
    """One digest of all files at some paths: of their names below the path, sizes and digests."""
    whole = hashlib.sha256()
    for path in paths:
        top = F.lit(path.rstrip("/").rsplit("/", 1)[-1])
        named = file_digests(spark, path).select(F.concat(top, F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1], -1)).alias("name"), "bytes", "sha256")
        row = F.sha2(F.concat_ws("|", "name", "bytes", "sha256"), 256)
        # A digest for each of 4,096 groups of files, so what the driver gets is bounded.
        groups = named.groupBy(F.pmod(F.xxhash64("name"), F.lit(4096)).alias("g")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(row))), 256).alias("s"))
        whole.update("".join(r.s for r in groups.orderBy("g").collect()).encode())
    return whole.hexdigest()


def _sealed(value) -> str:
    return hashlib.sha256(json.dumps(strict(value), sort_keys=True, default=str).encode()).hexdigest()


def run_arms(spark: SparkSession, path: str, contract: dict, arms: dict[str, Callable[[], DataFrame]], versions: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a run's arms below a path; an arm that is there from a run that broke off is not made again.

    contract: what all arms rest on (the digest of the input, cutoffs, parameters). A path that holds a
    run under another contract is refused. Beside each table stand the contract's digest and the arm's
    version (by default the digest of the module that defines it); an arm of another version, without
    that note or without its table is made anew. The note is written after the table, so a
    crash in between costs that arm only.
    """
    sealed = _sealed(contract)
    at = f"{path.rstrip('/')}/contract.json"
    if exists(spark, at):
        if read_json(spark, at)["digest"] != sealed:
            raise ValueError(f"{path} holds a run under another contract: take a new folder")
    else:
        write_json(spark, {"digest": sealed, "contract": json.loads(json.dumps(strict(contract), default=str))}, at)
    out = {}
    for name, make in arms.items():
        table, note = f"{path.rstrip('/')}/{name}", f"{path.rstrip('/')}/{name}.json"
        version = (versions or {}).get(name) or _sealed(inspect.getsource(inspect.getmodule(make)))
        want = {"contract": sealed, "version": version}
        if not (exists(spark, note) and exists(spark, table) and read_json(spark, note) == want):
            write_table(make(), table)
            write_json(spark, want, note)
        out[name] = spark.read.parquet(table)
    return out
