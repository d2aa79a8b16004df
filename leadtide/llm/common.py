"""What the operators of this subpackage share: reading tables, the shared folder, batches, joins with hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders of sessions on one machine that name none, by application.
_own: dict[str, str] = {}


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme.

    It is the session's ``spark.checkpoint.dir``, else the context's checkpoint folder. Only a session on
    one machine may have neither: a temporary folder serves it. On a cluster that is an error, as each
    machine would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        top = _own[app]
    # A path without a scheme belongs to Spark's default file system, on executors too.
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share; the current scratch owns it."""
    path = f"{shared_top(spark)}/leadtide-{uuid.uuid4().hex}"
    held = _current.get()
    if held is not None:
        held.own.append(path)
    return path


#: Rows of a file, where their number is known before.
ROWS_A_FILE = 100_000


class Scratch:
    """Tables of one operator in the shared folder; those that no later step reads are dropped early."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}
        #: All paths that were made, and names of tables in the catalog by their paths.
        self.own: list[str] = []
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: how many there are at most, if known; small frames are then written by few tasks."""
        path = f"{shared_top(self.spark)}/leadtide-{uuid.uuid4().hex}"
        self.own.append(path)
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.delete(self.paths.pop(id(df)))

    def drop_others(self, *frames: DataFrame) -> None:
        """Drop all but what these frames, as write() returned them, read."""
        kept = {self.paths[id(df)] for df in frames}
        for path in [x for x in self.own if x not in kept]:
            self.delete(path)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.own.remove(path)
        if path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")


#: The scratch that materialise() and shared_dir() write to, in each thread its own.
_current: ContextVar[Scratch | None] = ContextVar("leadtide_scratch", default=None)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that made them ends, where Spark can do so."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
    except Exception:  # noqa: BLE001  a session that doesn't know the setting
        before = None
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(key, before or "false")


@contextlib.contextmanager
def alone(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder within it goes at its end."""
    inner = Scratch(spark)
    token = _current.set(inner)
    try:
        yield
    finally:
        _current.reset(token)
        for path in list(inner.own):
            inner.delete(path)


def materialise_alone(spark: SparkSession, df_of: Callable[[], DataFrame]) -> DataFrame:
    """materialise() of a frame; what making it has written to the shared folder goes at once."""
    outer = current_scratch(spark)
    with alone(spark):
        return outer.write(df_of())


def current_scratch(spark: SparkSession) -> Scratch:
    return _current.get() or Scratch(spark)


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write to the shared folder as Parquet and read it again: later steps neither repeat the work
    nor depend on executors that may be lost. ``rows``: as for Scratch.write()."""
    return current_scratch(df.sparkSession).write(df, rows)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of ``df`` begins with."""
    lead = "_"
    while any(c.lower().startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + n for n in names]


def parallelism(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: A class with more rows than this share of a task's is spread over salts.
HOT_SHARE = 4


def with_salts(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Both frames with a column `__salt`, to be joined by ``keys`` and it.

    ``classes`` has one row for each key with its number of rows, ``copies``; ``total`` is the number of all rows.
    Keys with more rows than a quarter of what a task gets are spread over as many salts as they are
    times larger; there are at most four times as many such keys as tasks, so they are broadcast. Rows
    are salted by their position in a partition, so repeated rows part too.
    """
    bound = max(16, total // (HOT_SHARE * parallelism(rows)))
    salts = F.ceil(F.col(copies) / bound).cast("int")
    hot = classes.filter(F.col(copies) > bound).select(*(F.col(k).alias(f"__{k}") for k in keys), salts.alias("__salts"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(hot), same, "left").withColumn("__salt", salt).drop("__salts", *(f"__{k}" for k in keys))
    spread = classes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted, spread.hint("merge")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes at most (a longer value is alone)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
