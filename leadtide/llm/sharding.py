"""Shards in a random order of the whole table: a two-pass external shuffle.

The first pass scatters records uniformly into buckets that fit a task's memory, by a seeded hash of the whole record.
The second brings each bucket into an order that depends on its records only, shuffles it by Fisher and Yates with a
generator seeded by the seed and the bucket, and writes it with its place in the bucket. Buckets one after another are
a random order of the table. Their sizes, counted in what was written, give each record its place in that order, and the
order is cut into shards whose numbers of records differ by one at most (the law `rows`). A shard's records are then
written to a folder of its own.

Records that are equal in all columns have one hash. Where so many of them share it that they would be over a quarter of
a bucket, they are numbered into as many buckets as that takes; they can't be told apart, so it doesn't matter which goes where.

Defined cases: a null text has no bytes; null ids, repeated rows and equal texts are records like any other, so copies
spread over all shards; a very long text is in a bucket with the others that its hash brings there, and memory must hold
it; with fewer records than shards the last shards are empty; an empty table gives an empty result; other columns are
kept as they are (a map doesn't take part in the hash), and columns named `shard` or `slot` are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import alone, free_names, materialise, parallelism, shared_dir

#: Bytes of text that a bucket holds on average, and how many buckets a task has at least. Beyond 32 TB buckets grow
#: (100 MB at 100 TB), so that the table of their starts, which is broadcast, has a million rows at most.
BUCKET_BYTES, TURNS, MOST_BUCKETS = 32 << 20, 4, 1 << 20
#: Added to the bytes of a text for what a record takes besides.
OVERHEAD = 16


def size_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD


def sharded(docs: DataFrame, shards: int, seed: int = 42, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, as written below ``path`` (a folder of the session if not given), a folder a shard."""
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    spark = docs.sparkSession
    volume, total = docs.agg(F.sum(size_of(text_col)), F.count(F.lit(1))).first()
    if not total:
        return docs.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    path = path or shared_dir(spark)
    bucket, place, count, at, chunk, below, before = free_names(docs, "bucket", "place", "count", "at", "chunk", "below", "before")
    buckets = min(max(-(-volume // bucket_bytes), TURNS * parallelism(docs)), MOST_BUCKETS)
    with alone(spark):
        shuffled = materialise(in_buckets(docs, seed, buckets, total, bucket, place))
        # What lies before a bucket: before its 1024, and within them. The first is one window over a row for 1024 buckets.
        counts = shuffled.groupBy(bucket).agg(F.count(F.lit(1)).alias(count)).withColumn(chunk, F.expr(f"`{bucket}` DIV 1024"))
        past = Window.rowsBetween(Window.unboundedPreceding, -1)
        chunks = counts.groupBy(chunk).agg(F.sum(count).alias(below))
        chunks = chunks.select(chunk, F.coalesce(F.sum(below).over(past.orderBy(chunk)), F.lit(0)).alias(below))
        inside = F.coalesce(F.sum(count).over(past.partitionBy(chunk).orderBy(bucket)), F.lit(0))
        starts = counts.withColumn(before, inside).join(chunks, chunk).select(bucket, (F.col(before) + F.col(below)).alias(before))
        # The first shards have one record more than the others.
        least, more = divmod(total, shards)
        edge = more * (least + 1)
        shard = F.expr(f"IF(`{at}` < {edge}, `{at}` DIV {least + 1}, {more} + (`{at}` - {edge}) DIV {max(least, 1)})")
        slot = F.expr(f"IF(`{at}` < {edge}, `{at}` % {least + 1}, (`{at}` - {edge}) % {max(least, 1)})")
        placed = shuffled.join(F.broadcast(starts), bucket).withColumn(at, F.col(before) + F.col(place))
        placed = placed.select(*docs.columns, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
        placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def in_buckets(docs: DataFrame, seed: int, buckets: int, rows: int, bucket: str, place: str) -> DataFrame:
    """The rows with their bucket and their place in it after the shuffle."""
    low, high, kind, turns = free_names(docs, "low", "high", "kind", "turns")
    hashed = [c.name for c in docs.schema if not isinstance(c.dataType, MapType)]
    keyed = docs.withColumns({low: F.xxhash64(F.lit(seed), *hashed), high: F.xxhash64(F.lit(seed + 1), *hashed, F.lit("again"))})
    # Equal records that would be over a quarter of a bucket: there are fewer than four such kinds a bucket.
    bound = max(16, rows // (4 * buckets))
    hot = keyed.groupBy(F.col(low).alias(kind)).agg(F.count(F.lit(1)).alias(turns)).filter(F.col(turns) > bound)
    hot = materialise(hot.withColumn(turns, F.ceil(F.col(turns) / bound)))
    turn = F.lit(0).cast("long")
    if hot.limit(1).count():
        keyed = keyed.join(hot, F.col(low) == F.col(kind), "left")
        turn = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(turns)), turn)
    keyed = keyed.withColumn(bucket, F.pmod(F.xxhash64(F.col(low), turn), F.lit(buckets)))

    def shuffle(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column(high), column(low)))
        fisher_yates(order, np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, int(column(bucket)[0])])))
        out = table.drop_columns([low, high]).take(pa.array(order))
        return out.append_column(place, pa.array(np.arange(len(order), dtype=np.int64)))

    schema = docs.withColumns({bucket: F.lit(0).cast("long"), place: F.lit(0).cast("long")}).schema
    return keyed.select(*docs.columns, low, high, bucket).groupBy(bucket).applyInArrow(shuffle, schema)


def fisher_yates(order: np.ndarray, random: np.random.Generator) -> None:
    """Shuffle in place: from the last place down, each is swapped with one at or before it."""
    picks = random.integers(0, np.arange(len(order), 0, -1))
    for i, j in zip(range(len(order) - 1, 0, -1), picks.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]


def shard_digests(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: what stands where in the shards that were written."""
    written = sharded(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shards, seed)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return written.select("doc_id", size_of("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
