"""Removal of long repeated byte strings by run-length compressed indexes.

A byte goes if a string of ``least`` bytes that covers it also starts anywhere else in the corpus. One
index of the whole corpus would have to be built by one task, so strings are routed first and indexed
in parts that can hold all their repeats:

1. Distinct texts are written once, bucketed by content hash. Copies of a text count; if it is long
   enough all of it repeats.
2. Of the 32-byte grams in a string the one with the least hash, the leftmost of equals, is its anchor.
   Equal strings have equal anchors at equal places, and each position of a text has one anchor, so
   neighbouring strings share it: an occurrence of an anchor owns a range of starts. Anchors whose gram
   occurs once own no repeats and go.
3. Occurrences that own the same bytes are counted by a strong hash: two or more, and all the owned
   bytes repeat. They are indexed once from then on, however many texts hold them.
4. Different ranges with one gram are told apart by 158-byte cores around the gram: starts are divided
   into four classes, and in each class equal strings have equal cores. Ranges whose core is alone go.
5. The rest is cut out of the texts and dealt by core. A task builds the Burrows-Wheeler transform of
   its strings, keeps its runs with the suffixes at their ends, takes the matches with both neighbours
   there (the irreducible ones), and streams over the text: between samples a match gets one byte
   shorter with each step. A start whose longest match elsewhere reaches ``least`` is marked. A core
   with very many ranges is not given to one task: its strings are counted by hash with partial sums.
6. Marks go back to all occurrences, are joined to the texts, and overlapping ones are merged.

Defined cases: a null text is empty; texts shorter than ``least`` bytes lose nothing; a byte run longer
than ``least`` repeats within itself and goes; rows that repeat an id are rows like others; matches
never cross texts; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, current_scratch, free_names, materialise, materialise_alone, parallelism, shared_top, with_salts

GRAM = 32
#: Classes of starts within the range of an anchor.
CLASSES = 4
#: Ranges with one core that a task may index; cores with more are counted by hash.
HOT = 4096
#: Bytes that are indexed at once.
INDEX_BYTES = 1 << 19

_RANDOM = np.random.default_rng(20240101)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = {n: np.uint64(int(_RANDOM.integers(1, 1 << 62)) * 2 + 1) for n in (1, 2, 4, 8, 16)}
#: Starts of a text that are hashed at once; positions within fit in 16 bits.
_CHUNK = 1 << 15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on, by doubling."""
    h = _BYTE[data]
    for n in (1, 2, 4, 8, 16):
        h = h[:-n] * _STEP[n] + h[n:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor its gram's hash, its position, and the first and last start that it owns."""
    width = least - GRAM + 1
    starts = len(data) - least + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 4
    owner, hashes = [], []
    for base in range(0, starts, _CHUNK):
        here = min(_CHUNK, starts - base)
        h = gram_hashes(data[base : base + here + least - 1])
        key = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        low = key
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:here], low[width - step : width - step + here])
        at = (low & np.uint64(0xFFFF)).astype(np.int64)
        owner.append(at + base)
        hashes.append(h[at])
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    last = np.concatenate([first[1:], [starts]]) - 1
    return hashes[first].view(np.int64), owner[first], first, last


def class_bounds(least: int) -> list[tuple[int, int]]:
    """Of each class of starts the least and the greatest number of bytes right of the gram."""
    free = least - GRAM
    edges = [free * j // CLASSES for j in range(CLASSES)] + [free + 1]
    return [(edges[j], edges[j + 1] - 1) for j in range(CLASSES)]


def index_repeats(pieces: list[bytes], least: int) -> list[np.ndarray]:
    """For each piece the starts of strings of ``least`` bytes that occur elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    data = np.zeros(int(ends[-1]) + 1, np.int64)
    # Ends of pieces are signs of their own, so no match crosses them.
    data[:] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + len(pieces)
    data[ends] = np.arange(len(pieces))
    n = len(data)

    # Suffix order by doubling; ranks of every power of two stay, to measure matches.
    ranks = [data]
    step = 1
    while True:
        rank = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        fresh = np.empty(n, np.int32)
        ordered = key[order]
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        ranks.append(fresh)
        if fresh[order[-1]] == n - 1:
            break

    # Runs of the transform; the suffixes at their borders are the samples.
    before = data[order - 1]
    border = np.flatnonzero(before[1:] != before[:-1]) + 1
    upper, lower = order[border - 1], order[border]
    a, b, match = upper.copy(), lower.copy(), np.zeros(len(border), np.int64)
    for t in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[t][a[inside]] == ranks[t][b[inside]]
        match[same] += 1 << t
        a[same] += 1 << t
        b[same] += 1 << t

    # Matching statistics: position + match never falls along the text, so samples carry on.
    longest = np.zeros(n, np.int64)
    for sample in (upper, lower):
        reach = np.zeros(n, np.int64)
        np.maximum.at(reach, sample, match + sample)
        longest = np.maximum(longest, np.maximum.accumulate(reach) - np.arange(n))
    hit = longest >= least
    return [np.flatnonzero(hit[end - size : end]) for size, end in zip(sizes, ends, strict=True)]


def merged(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Intervals that cover the strings from these sorted starts on."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > least) + 1
    return [(int(part[0]), int(part[-1]) + least) for part in np.split(starts, cut)]


def _frame(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns.values()], list(columns))


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """cls (content hash), data (bytes), copies: each text once, bucketed by cls in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("cls", content_class("data"))
    once = rows.groupBy("cls").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"))
    name = f"leadtide_{uuid.uuid4().hex}"
    scratch = current_scratch(spark)
    path = f"{shared_top(spark)}/{name}"
    scratch.own.append(path)
    scratch.tables[path] = name
    once.write.bucketBy(parallelism(docs), "cls").option("path", path).saveAsTable(name)
    return spark.table(name)


def content_class(col: str):
    return F.substring(F.unhex(F.sha2(F.col(col), 256)), 1, 16)


def removed_spans(docs: DataFrame, text_col: str = "text", least: int = 200) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and for each of their classes with repeats the spans (array of start, end)."""
    texts = distinct_texts(docs, text_col)
    bounds = class_bounds(least)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "data"):
            found = [anchors(np.frombuffer(x.as_buffer(), np.uint8), least) for x in batch.column("data")]
            row = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
            if len(row):
                h, pos, low, high = (np.concatenate([x[i] for x in found]) for i in range(4))
                yield pa.record_batch([pa.array(h), batch.column("cls").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (pos, low, high))], ["h", "cls", "pos", "low", "high"])

    long_enough = texts.filter(F.octet_length("data") >= least)
    found = materialise(long_enough.select("cls", "data").mapInArrow(find, "h long, cls binary, pos int, low int, high int"))
    # Small sides are written, by few tasks, as their rows are narrow and a fraction of those they come from: then both sides of a join are shuffled for it alone, and Spark can split
    # a gram that very many texts hold.
    again = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), found.count() // 8)
    own = found.join(again.hint("merge"), "h").groupBy("cls").agg(F.collect_list(F.struct("h", "pos", "low", "high")).alias("own"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "data"):
            out: dict[str, tuple[list, pa.DataType]] = {"h": ([], pa.int64()), "wh": ([], pa.binary()), "cls": ([], pa.binary()), "pos": ([], pa.int32()), "low": ([], pa.int32()), "high": ([], pa.int32())}
            out |= {f"core{j}": ([], pa.int64()) for j in range(CLASSES)}
            put = {k: v[0].append for k, v in out.items()}
            for cls, data, ranges in zip(batch.column("cls").to_pylist(), batch.column("data").to_pylist(), batch.column("own"), strict=True):
                flat = ranges.values
                for h, pos, low, high in zip(*(flat.field(k).to_pylist() for k in ("h", "pos", "low", "high")), strict=True):
                    put["h"](h)
                    put["cls"](cls)
                    put["pos"](pos)
                    put["low"](low)
                    put["high"](high)
                    put["wh"](hashlib.blake2b(data[low : high + least], digest_size=16, salt=(pos - low).to_bytes(4, "little")).digest())
                    shift = least - GRAM - pos
                    for j, (few, many) in enumerate(bounds):
                        # Bytes right of the gram: start + shift.
                        if low + shift <= many and high + shift >= few:
                            core = data[pos - (least - GRAM - many) : pos + GRAM + few]
                            put[f"core{j}"](int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True))
                        else:
                            put[f"core{j}"](None)
            yield _frame(out)

    cores = ", ".join(f"core{j} long" for j in range(CLASSES))
    seen = materialise(long_enough.select("cls", "data").join(own, "cls").select("cls", "data", "own").mapInArrow(describe, f"h long, wh binary, cls binary, pos int, low int, high int, {cores}"))
    ranges = materialise(
        seen.groupBy("h", "wh").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("cls", "pos", "low", "high")).alias("one"), *(F.first(f"core{j}").alias(f"core{j}") for j in range(CLASSES))
        )
    )
    classes = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"core{j}").alias("core")) for j in range(CLASSES)))).alias("c")
    parts = ranges.select("h", "wh", "one", classes).filter("c.core IS NOT NULL").select("h", "wh", "one", "c.j", F.xxhash64("h", "c.j", "c.core").alias("g"))
    shared = materialise(parts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", (F.col("n") > HOT).alias("hot")), ranges.count() // 4)
    wanted = parts.join(shared.hint("merge"), "g").groupBy("one.cls").agg(F.collect_list(F.struct("g", "hot", "h", "wh", "j", "one.pos", "one.low", "one.high")).alias("own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "data"):
            out: dict[str, tuple[list, pa.DataType]] = {"g": ([], pa.int64()), "hot": ([], pa.bool_()), "h": ([], pa.int64()), "wh": ([], pa.binary()), "at": ([], pa.int32()), "piece": ([], pa.binary())}
            put = {k: v[0].append for k, v in out.items()}
            for data, own in zip(batch.column("data").to_pylist(), batch.column("own").to_pylist(), strict=True):
                for x in own:
                    shift = least - GRAM - x["pos"]
                    first, last = max(x["low"], bounds[x["j"]][0] - shift), min(x["high"], bounds[x["j"]][1] - shift)
                    for k in ("g", "hot", "h", "wh"):
                        put[k](x[k])
                    put["at"](first - x["low"])
                    put["piece"](data[first : last + least])
            yield _frame(out)

    pieces = materialise(long_enough.select("cls", "data").join(wanted, "cls").select("data", "own").mapInArrow(cut, "g long, hot boolean, h long, wh binary, at int, piece binary"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def marks() -> pa.RecordBatch:
            out: dict[str, tuple[list, pa.DataType]] = {"h": ([], pa.int64()), "wh": ([], pa.binary()), "start": ([], pa.int32()), "end": ([], pa.int32())}
            for (_, h, wh, at, _), starts in zip(held, index_repeats([x[4] for x in held], least), strict=True):
                for start, end in merged(starts, least):
                    for k, v in zip(out, (h, wh, at + start, at + end), strict=True):
                        out[k][0].append(v)
            return _frame(out)

        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in ("g", "h", "wh", "at", "piece")), strict=True):
                if size > INDEX_BYTES and x[0] != held[-1][0]:
                    yield marks()
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield marks()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "piece", 1 << 18):
            out: dict[str, tuple[list, pa.DataType]] = {"string": ([], pa.binary()), "h": ([], pa.int64()), "wh": ([], pa.binary()), "start": ([], pa.int32())}
            for h, wh, at, piece in zip(*(batch.column(k).to_pylist() for k in ("h", "wh", "at", "piece")), strict=True):
                for start in range(len(piece) - least + 1):
                    out["string"][0].append(hashlib.blake2b(piece[start : start + least], digest_size=16).digest())
                    out["h"][0].append(h)
                    out["wh"][0].append(wh)
                    out["start"][0].append(at + start)
            yield _frame(out)

    # Cores, not ranges, are dealt: a core's ranges are HOT at most.
    dealt = pieces.filter("NOT hot").select("g", "h", "wh", "at", "piece").repartition(parallelism(docs), "g").sortWithinPartitions("g")
    marks = dealt.mapInArrow(index, "h long, wh binary, start int, end int")
    each = pieces.filter("hot").select("h", "wh", "at", "piece").mapInArrow(strings, "string binary, h long, wh binary, start int")
    twice = each.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    counted = each.join(twice.hint("merge"), "string").select("h", "wh", "start", (F.col("start") + least).alias("end"))
    whole = ranges.filter("n > 1").select("h", "wh", F.lit(0).alias("start"), (F.col("one.high") - F.col("one.low") + least).alias("end"))
    marks = materialise(marks.unionByName(counted).unionByName(whole).groupBy("h", "wh").agg(F.collect_list(F.struct("start", "end")).alias("marks")))
    placed = seen.select("h", "wh", "cls", "low").join(marks.hint("merge"), ["h", "wh"])
    spans = placed.select("cls", F.transform("marks", lambda m: F.struct((F.col("low") + m["start"]).alias("start"), (F.col("low") + m["end"]).alias("end"))).alias("spans"))
    return texts, spans.groupBy("cls").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def whole_signs(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the UTF-8 signs that it covers in part."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def cleaned(docs: DataFrame, text_col: str = "text", least: int = 200, with_text: bool = False) -> DataFrame:
    """cls, n_bytes, n_removed, n_spans, kept_sha256, copies and with with_text what is left: a row a class.

    The text left keeps signs that a span covers in part; null where nothing was removed.
    """
    texts, spans = removed_spans(docs, text_col, least)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "data"):
            out: dict[str, tuple[list, pa.DataType]] = {"cls": ([], pa.binary()), "n_bytes": ([], pa.int64()), "n_removed": ([], pa.int64()), "n_spans": ([], pa.int64()), "kept_sha256": ([], pa.string()), "copies": ([], pa.int64())}
            if with_text:
                out["left"] = ([], pa.string())
            for cls, data, copies, found in zip(*(batch.column(k).to_pylist() for k in ("cls", "data", "copies", "spans")), strict=True):
                runs: list[list[int]] = []
                if copies > 1 and len(data) >= least:
                    runs = [[0, len(data)]]
                elif found:
                    for start, end in sorted((x["start"], x["end"]) for x in found):
                        if runs and start <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], end)
                        else:
                            runs.append([start, end])
                kept, at = [], 0
                for start, end in runs:
                    kept.append(data[at:start])
                    at = end
                kept = b"".join([*kept, data[at:]])
                left = None
                if with_text and runs:
                    signs, at = [], 0
                    for start, end in (whole_signs(data, *x) for x in runs):
                        signs.append(data[at:start])
                        at = end
                    left = b"".join([*signs, data[at:]]).decode("utf-8", "replace")
                for k, v in zip(out, (cls, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), copies, left), strict=False):
                    out[k][0].append(v)
            yield _frame(out)

    schema = "cls binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, copies long" + ", left string" * with_text
    return texts.join(spans, "cls", "left").select("cls", "data", "copies", "spans").mapInArrow(apply, schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), content_class_of(text_col).alias("cls"))
    classes = materialise_alone(docs.sparkSession, lambda: cleaned(docs, text_col, least))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # A class may hold a third of all rows.
    rows, classes = with_salts(rows, classes, ["cls"], "copies", total)
    return rows.join(classes, ["cls", "__salt"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def content_class_of(text_col: str):
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)), 1, 16)


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", least: int = 200) -> DataFrame:
    """``docs`` with texts less their repeated passages; rows of which nothing is left go.

    length_col: a column with the text's length in signs, which follows the new text.
    """
    cls, new = free_names(docs, "cls", "left")
    left = materialise_alone(docs.sparkSession, lambda: cleaned(docs, text_col, least, with_text=True).filter("left IS NOT NULL").select(F.col("cls").alias(cls), F.col("left").alias(new)))
    joined = docs.join(left.hint("merge"), content_class_of(text_col) == F.col(cls), "left").filter(F.col(new).isNull() | (F.col(new) != ""))
    text = F.coalesce(new, text_col)
    length = {length_col: F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col(length_col))} if length_col in docs.columns else {}
    columns = [length.get(c, F.col(c)).cast(docs.schema[c].dataType).alias(c) if c != text_col else text.alias(c) for c in docs.columns]
    return joined.select(*columns)
