"""Collocations: phrases of a few words that occur more often than their parts let expect.

Texts are counted shard by shard, a shard being what a task has read up to some megabytes. Its words become ids, its
pieces one sequence of ids with breaks. A suffix array of that sequence, built by prefix doubling (ranks of one word, two,
four), brings equal beginnings together, and every LCP interval of n words or more is an n-gram with its count. The
counts of all shards are summed by language and phrase.

A phrase is as frequent as its parts at most. So words are counted first, then pairs of frequent words, then longer
phrases all of whose pairs are frequent. What is frequent reaches the tasks as a bitmap of fixed size: a phrase whose bit
another one has set is counted in vain, none is missed.

Every language is apart (a null one is `und`). A text's pieces end at the delimiters, its words at spaces and tabs.

Defined cases: null and empty texts have no words; repeated rows and copies count each; overlapping occurrences count
all; a table without a frequent phrase gives an empty result; other columns are not looked at. A very long text is in
one shard with others that the task has read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, current_scratch, materialise, parallelism

#: Bytes of text in a shard, and bits of the table of frequent words or pairs (a power of two).
SHARD_BYTES, BITS = 8 << 20, 1 << 26
#: Upper to lower case; tabs are spaces; delimiters end a piece.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
#: Between pieces; no byte of UTF-8.
BREAK = b"\xff"


class Shard:
    """The words of some texts as ids: 0 for a break, one id for a word of one language."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        by_lang: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(langs, texts, strict=True):
            by_lang[lang].append(text)
        parts, self.words, of = [np.zeros(1, np.int32)], [""], [0]
        self.langs = list(by_lang)
        for number, own in enumerate(by_lang.values()):
            ids: dict[bytes, int] = defaultdict(count(len(self.words)).__next__)
            ids[BREAK], ids[b""] = 0, -1  # nothing stands between two spaces
            for text in chunks(own):
                tokens = text.translate(FOLD).replace(b"\n", b" " + BREAK + b" ").split(b" ")
                found = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
                parts += [found[found >= 0], np.zeros(1, np.int32)]
            new = [w for w, i in ids.items() if i > 0]
            self.words += [w.decode() for w in new]
            of += [number] * len(new)
        self.ids, self.lang = np.concatenate(parts), np.array(of)

    @property
    def hashes(self) -> np.ndarray:
        """A number of 32 bits for each word with its language."""
        names = [zlib.crc32(x.encode()) for x in self.langs]
        own = np.fromiter((zlib.crc32(w.encode()) for w in self.words), np.int64, len(self.words))
        return (own + np.array(names or [0], np.int64)[self.lang]) % (1 << 32)

    def table(self, at: np.ndarray, n: int, counts: np.ndarray) -> pa.RecordBatch:
        """lang, size, phrase, f of the n-grams that begin at some places."""
        words, joined = pa.array(self.words, pa.string()), None
        for k in range(n):
            own = words.take(pa.array(self.ids[at + k]))
            joined = own if joined is None else pc.binary_join_element_wise(joined, own, " ")
        langs = pa.array(self.langs or [""], pa.string()).take(pa.array(self.lang[self.ids[at]]))
        return pa.record_batch([langs, pa.array(np.full(len(at), n, np.int32)), joined, pa.array(counts)], ["lang", "size", "phrase", "f"])


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[bytes]:
    """The texts, a line break between them, in pieces of about ``limit`` bytes: words of so many at a time are Python objects."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def suffix_order(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The places ``starts`` in the order of the ``depth`` ids from them on, by doubling the length that ranks compare."""
    ranks, length = ids, 1
    while 2 * length < depth:
        ranks = np.unique(pairs_at(ranks, length), return_inverse=True)[1].astype(np.int32)
        length *= 2
    return starts[np.argsort((pairs_at(ranks, length) if length < depth else ranks)[starts], kind="stable")]


def pairs_at(ranks: np.ndarray, length: int) -> np.ndarray:
    """The rank of each place and that of ``length`` places on, as one number."""
    out = ranks.astype(np.int64) * (int(ranks.max()) + 1)
    out[:-length] += ranks[length:]
    return out


def intervals(ids: np.ndarray, reach: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, places, counts of all different n-grams: one place of each, and its number of places.

    ``reach``: how many ids from a place on, itself included, belong together. Neighbours in the suffix order share a
    prefix; where it is shorter than n an LCP interval of n ends. Prefixes of a place that don't reach so far don't count.
    """
    starts = np.flatnonzero(reach >= min(sizes))
    if not len(starts):
        return
    order = suffix_order(ids, starts, max(sizes))
    padded = np.concatenate([ids, np.zeros(max(sizes), ids.dtype)])
    lcp, same = np.zeros(len(order), np.int32), np.ones(max(len(order) - 1, 0), bool)
    for k in range(max(sizes)):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
        lcp[1:] += same
    for n in sizes:
        first = np.flatnonzero(lcp < n)
        counts = np.diff(np.append(first, len(order)))
        whole = reach[order[first]] >= n
        yield n, order[first[whole]], counts[whole]


def reaches(linked: np.ndarray, most: int) -> np.ndarray:
    """From flags that an id belongs with the next one: how many ids from each on belong together, ``most`` at most."""
    out = np.ones(len(linked), np.int32)
    run = linked.copy()
    for k in range(1, most):
        out += run
        run[:-k] &= linked[k:]
        run[-k:] = False
    return out


def bit(first: np.ndarray | Column, then: np.ndarray | Column | int = 0):
    """The place of a word (its hash and 0) or a pair in the bitmap; numbers stay below 2 ** 63."""
    return (first * 31337 + then) % BITS


def marked(bits: Broadcast, at: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits.value, np.uint8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def gram_counts(docs: DataFrame, sizes: tuple[int, ...], words: Broadcast | None = None, pairs: Broadcast | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, size, phrase, f: counts of all phrases of these sizes, of frequent words and pairs only where bitmaps say which."""

    def of_shard(langs: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        shard = Shard(langs, texts)
        ids = shard.ids
        known = ids > 0
        if words:
            known &= marked(words, bit(shard.hashes))[ids]
        linked = np.append(known[:-1] & known[1:], False)
        if pairs:
            at = np.flatnonzero(linked)
            h = shard.hashes[ids]
            linked[at] = marked(pairs, bit(h[at], h[at + 1]))
        reach = np.where(known, reaches(linked, max(sizes)), 0)
        for n, places, counts in intervals(ids, reach, sizes):
            for i in range(0, len(places), 1 << 16):
                yield shard.table(places[i : i + (1 << 16)], n, counts[i : i + (1 << 16)])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts, held = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                langs.append(lang)
                texts.append(text)
                held += len(text)
                if held >= shard_bytes:
                    yield from of_shard(langs, texts)
                    langs, texts, held = [], [], 0
        if texts:
            yield from of_shard(langs, texts)

    own = docs.mapInArrow(of_task, "lang string, size int, phrase string, f long")
    return own.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def word_hash(lang: Column, word: Column) -> Column:
    return (F.crc32(word.cast("binary")) + F.crc32(lang.cast("binary"))) % (1 << 32)


def bitmap(places: DataFrame) -> Broadcast:
    """The bits at ``places`` (column `at`), a table of fixed size, for all tasks."""
    at = F.col("at") + 1
    chunks = places.select(F.bitmap_bucket_number(at).alias("n"), F.bitmap_bit_position(at).alias("bit")).groupBy("n").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = bytearray(BITS // 8)
    for n, bits in chunks.collect():  # 4 kB each, BITS / 32,768 of them at most
        table[(n - 1) * 4096 : (n - 1) * 4096 + len(bits)] = bits
    return places.sparkSession.sparkContext.broadcast(bytes(table))


def collocations(docs: DataFrame, least: int, most_words: int = 4, scale: int = 2_000_000, inside: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``most_words`` words with ``least`` occurrences.

    A phrase scores floor(scale * a / (l + r)) by the cut into two parts that makes least of it (the first of equal ones).
    Phrases go where a longer frequent one holds them and has ``inside`` of a hundred of their occurrences.
    """
    spark = docs.sparkSession
    outer = current_scratch(spark)
    with alone(spark):
        texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text != ''")
        vocabulary = materialise(gram_counts(texts, (1,), shard_bytes=shard_bytes))
        frequent = vocabulary.filter(F.col("f") >= least)
        words = bitmap(frequent.select(bit(word_hash(F.col("lang"), F.col("phrase"))).alias("at")))
        two = materialise(gram_counts(texts, (2,), words, shard_bytes=shard_bytes).filter(F.col("f") >= least))
        parts = F.split("phrase", " ")
        pairs = bitmap(two.select(bit(word_hash(F.col("lang"), parts[0]), word_hash(F.col("lang"), parts[1])).alias("at")))
        found = frequent.unionByName(two)
        if most_words > 2:
            found = found.unionByName(materialise(gram_counts(texts, tuple(range(3, most_words + 1)), words, pairs, shard_bytes).filter(F.col("f") >= least)))
        out = outer.write(ranked(found, vocabulary, scale, inside, top))
        words.destroy()
        pairs.destroy()
    return out


def ranked(found: DataFrame, vocabulary: DataFrame, scale: int, inside: int, top: int) -> DataFrame:
    """The best phrases of each language, from the counts of all frequent ones and of all words."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products may pass 64 bits
    phrases = found.filter("size > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(split, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    # A frequent word is the first part of many phrases: partitions that are too large are split at run time.
    left, right = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    score = F.expr(f"(CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    holders = phrases.filter("size > 2")
    sizes = F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    within = holders.select("lang", "a", "size", split.alias("w"), sizes.alias("m"))
    within = within.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    within = within.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * exact("held") < inside * exact("a")))
    kept = kept.select("lang", "phrase", "a", "cut.*").drop("k")

    # The best of slices of a language first, so that no task sorts all of its phrases.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    slices = F.pmod(F.xxhash64("phrase"), F.lit(min(256, 4 * parallelism(found))))
    kept = kept.withColumn("slice", slices).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
