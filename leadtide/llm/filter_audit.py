"""What each of several filters does in every order in which they can be applied.

A document enters the audit as the set of filters it fails and a few marks. Documents are counted by part, set and
marks first, so all that follows works on a few rows a part. Every order of the filters is a path through the lattice
of subsets: step by step, the edge (filters already applied, next filter). For five filters there are 80 edges. A set
of failed filters says what its documents do on an edge: they are gone already, go here, or pass. The counts of the
edges are summed once, and the 600 steps of the 120 orders read them by a join with a table of fixed size.

Equal texts are found by their SHA-256. The least id of a text is joined back to its rows; texts with many
copies are spread over salts.

Defined cases: a null text counts as empty; a null part is the empty string; a null id comes after all others, and of
rows with one text those with the least id are no copies (several, if the id repeats); labels that are null or missing
count as neither good nor toxic, and of labels that repeat an id one is enough; an empty table gives no parts and so an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_salts

#: Counts of a set of failed filters, which edges sum up.
COUNTS = ("docs", "good", "toxic")


def few_words(words: Column, least: int) -> Column:
    return F.size(words) < least


def repeated_words(words: Column, percent: int) -> Column:
    """Fewer distinct words than so many of a hundred."""
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(text: Column, percent: int) -> Column:
    """More of A to Z than so many of a hundred code points."""
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.char_length(text)


def holds_any(text: Column, signs: str) -> Column:
    return text.rlike(signs)


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Callable[[Column, Column], Column]],
    copies: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``conditions``: by a letter, which texts fail that filter, from the text and its words; ``copies`` is the letter of the filter that texts of
    a smaller id fail. Filters are named by single letters; eight of them have 322,560 steps a part, so that is the bound.
    """
    letters = sorted([*conditions, copies])
    if len(set(letters)) < len(letters) or len(letters) > 8 or any(len(x) != 1 for x in letters):
        raise ValueError(f"the audit takes up to 8 filters named by different letters, not {letters}")
    sets = fail_sets(docs, labels, conditions, copies, letters, id_col, text_col, part_col)
    return along_orders(edge_counts(sets, letters), letters)


def fail_sets(docs: DataFrame, labels: DataFrame, conditions: dict[str, Callable[[Column, Column], Column]], copies: str, letters: list[str], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, fails (bits of the filters, in the order of ``letters``), docs, good, toxic."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = sum((F.when(fails(F.col("text"), F.col("words")), 1 << letters.index(x)).otherwise(0) for x, fails in conditions.items()), F.lit(0))
    rows = materialise(texts.select("doc_id", "part", bits.alias("own"), F.unhex(F.sha2("text", 256)).alias("h")))
    total = rows.count()
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    again = materialise(groups.filter("n > 1"))
    held, spread = with_salts(rows, again, ["h"], "n", total)
    found = held.join(spread.select("h", "__salt", "first_id", "n"), ["h", "__salt"], "left")
    is_copy = F.col("n").isNotNull() & F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("first_id").isNotNull())
    marked = found.select("doc_id", "part", (F.col("own") + F.when(is_copy, 1 << letters.index(copies)).otherwise(0)).alias("fails"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    # Rows without an id have no label: they stay out of the join, where they would be one key.
    labelled = marked.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(marked.filter("doc_id IS NULL"), allowMissingColumns=True)
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias("good" if c == "quality" else c)
    return labelled.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("docs"), some("quality"), some("toxic"))


def edge_counts(sets: DataFrame, letters: list[str]) -> DataFrame:
    """part, applied (bits), next (place of the filter), and the counts of every edge of the lattice."""
    n = len(letters)
    edges = [(sum(1 << i for i in s), f) for f in range(n) for k in range(n) for s in combinations([i for i in range(n) if i != f], k)]
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("own")) for s, f in edges))  # n * 2 ** (n - 1) of them
    fails_next = F.col("fails").bitwiseAND(F.col("own")) != 0
    here = F.col("fails").bitwiseAND(F.col("applied")) == 0
    only = F.col("fails") == F.col("own")
    count = lambda condition, c="docs": F.sum(F.when(condition, F.col(c)).otherwise(0))
    return (
        sets.select("*", F.inline(every))
        .groupBy("part", "applied", "next")
        .agg(
            count(here & ~fails_next).alias("kept"),
            count(here & fails_next).alias("removed"),
            count(~here & fails_next).alias("redundant"),
            count(only).alias("unique_fails"),
            count(here & fails_next, "good").alias("good_lost"),
            count(here & fails_next, "toxic").alias("toxic_lost"),
        )
    )


def along_orders(edges: DataFrame, letters: list[str]) -> DataFrame:
    """Every order as a path: each of its steps with the counts of its edge, and each filter's sum over all orders."""
    spark, n = edges.sparkSession, len(letters)
    # How many orders pass through an edge: those of the filters before it times those after it.
    size = F.bit_count("applied")
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n))), size.cast("int") + 1)
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = []
    for order in permutations(range(n)):
        name = "".join(letters[i] for i in order)
        steps += [(name, k + 1, sum(1 << i for i in order[:k]), f) for k, f in enumerate(order)]
    table = spark.createDataFrame(steps, "filter_order string, step int, applied int, next int")  # n * n! rows
    out = edges.join(shares, ["part", "next"]).join(F.broadcast(table), ["applied", "next"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
