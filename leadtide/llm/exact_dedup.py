"""Exact deduplication with DataFrame functions only.

Rows are grouped by a 128-bit content hash; the bytes inside every group are then compared, so that a
hash collision never merges different texts. Large groups are spread over salts, the more the larger: a
group may hold a third of all rows and still no task gets more than a fraction of its share.

Defined cases: a null text equals the empty text; a null id never stays while its group has another
id; rows that repeat an id and a text count each; an empty table gives an empty result; other columns
of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise, with_salts


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    fingerprint: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    keep: "min" or "max", which id of a group stays. fingerprint: the content hash, MD5 unless given.
    """
    fingerprint = fingerprint or (lambda text: F.unhex(F.md5(text)))
    stays = {"min": F.min, "max": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", "text", fingerprint(F.col("text").cast("binary")).alias("h"), F.unhex(F.sha2("text", 256)).alias("text_sha256"))
    rows = materialise(keyed.select("doc_id", "h", "text_sha256"))
    total = rows.count()
    # Partial counts per salt first, so that a hot hash is a few rows by the time it meets.
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), stays("doc_id").alias("keep_id"))
    copies = materialise(groups.filter("group_size > 1"))

    # Least and greatest text of a group are the same bytes exactly if all its texts are.
    held, again = with_salts(keyed.select("h", "text"), copies.select("h", "group_size"), ["h"], "group_size", total)
    compared = (
        held.join(again, ["h", "__salt"])
        .groupBy("h", "__salt")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .groupBy("h")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    collided = compared.filter(F.col("low") != F.col("high")).select("h").limit(1).count() > 0
    if collided:
        # Different texts share a hash somewhere: the text itself decides there.
        groups = keyed.groupBy("h", "text_sha256", "text").agg(F.count(F.lit(1)).alias("group_size"), stays("doc_id").alias("keep_id"))
        held, split = with_salts(keyed, groups.filter("group_size > 1"), ["h", "text_sha256", "text"], "group_size", total)
        found = held.join(split, ["h", "text_sha256", "text", "__salt"], "left")
    else:
        held, again = with_salts(rows, copies, ["h"], "group_size", total)
        found = held.join(again, ["h", "__salt"], "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep_id = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one for each text.

    Of rows that repeat an id and a text one stays. A null text equals the empty one.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = exact_dedup(docs, id_col, text_col, keep)
    by_id, by_digest, n, row = free_names(docs, "id", "digest", "n", "row")
    # A row without an id never stays beside one with an id, so ids and digests name the rows that go.
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(by_id), F.col("text_sha256").alias(by_digest))
    again = found.filter("kept AND group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias(n))
    again = again.filter(F.col(n) > 1).select(F.col("doc_id").alias(by_id), F.col("text_sha256").alias(by_digest))
    same = F.col(id_col).eqNullSafe(F.col(by_id)) & (digest == F.col(by_digest))
    kept = docs.join(gone.hint("merge"), same, "left_anti")
    if not again.limit(1).count():
        return kept
    one = kept.join(again.hint("merge"), same, "left_semi")
    columns = docs.columns
    first = one.groupBy(F.col(id_col).alias(by_id), digest.alias(by_digest)).agg(F.min_by(F.struct(*(F.col(c) for c in columns)), F.xxhash64(*columns)).alias(row))
    return kept.join(again.hint("merge"), same, "left_anti").unionByName(first.select(f"{row}.*"))
