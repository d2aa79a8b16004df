"""Best-fit packing of token sequences: best-two-fit over a histogram of lengths.

Only a document longer than a sequence is cut. Packing decides by lengths alone, and there are at most
``capacity`` different lengths, so the driver packs the histogram (at most 4096 numbers, whatever the
corpus's size): a bin is filled greedily, each time with the longest document that fits; then its
smallest document is replaced by two unpacked ones if some pair fits the expanded gap more tightly;
the finished pattern is used as often as the counts allow. Every pattern uses up a length to within
its own multiplicity, so the number of patterns is bounded by the lengths, not by the documents.

Documents find their place by length and rank within the length. Ranks are distributed: counts by
(length, salt) give offsets and rows are numbered within (length, salt) only, so a length that a third
of all documents share is spread over tasks.

Defined cases: a null text is empty and gives one piece with the end mark alone; rows that repeat an id
are packed each; a null id is kept; an empty table gives an empty result; other columns are not looked
at.
"""

from __future__ import annotations

import re
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialise, parallelism

#: A length's pieces are numbered by so many tasks, more with more tasks; the table of lengths and salts stays small.
SALTS, MOST_SALTS = 64, 1024
REMEMBERED = 400_000

# What a tokenizer file says whose texts can be encoded word by word.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file whose pieces never hold white space.

    The library's own model encodes every distinct word once for a worker; a text's ids are those of
    its words. Texts with special strings or characters that Python and the library class differently
    are encoded by the library as a whole.
    """

    made: dict[str, WordTokenizer] = {}
    #: Special strings; signs that split() takes for white space though the library does not; letters
    #: whose lower case depends on what follows in Python.
    ODD = re.compile(r"<\||[\x1c-\x1fİΣ]")

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        #: Whether the file asks for just what encode() does by words; else the library encodes whole texts.
        self.by_words = own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER and all(t["content"].startswith("<|") for t in own["added_tokens"])
        self.pieces = regex.compile(PIECE)
        # The byte alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    class Known(dict):
        """Ids of words as little-endian bytes, made when first asked for."""

        def __init__(self, owner: WordTokenizer) -> None:
            super().__init__()
            self.owner = owner

        def __missing__(self, word: str) -> bytes:
            ids = self.owner.word(word)
            if len(word) <= 48:
                self[word] = ids
            return ids

    def word(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in (word,) if word.isalpha() else self.pieces.findall(word):
            # Printable ASCII stands for itself in the byte alphabet.
            shown = piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            ids += [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    known: Known | None = None

    def encode(self, text: str) -> bytes:
        if not self.by_words or self.ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.known is None or len(self.known) > REMEMBERED:
            self.known = self.Known(self)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordTokenizer.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in by_bytes(batches, "text"):
            row, start, length, crc = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = words.encode(text) + end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            starts = np.array(start, np.int64)
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(starts // capacity, pa.int32()), pa.array(starts), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, how many bins) that pack ``counts[length]`` documents of each length."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    #: Per length the longest one at or below it that is left; rebuilt when a length runs out.
    below = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    patterns = []
    while below[capacity]:
        own: list[int] = []
        gap = capacity
        while gap and (x := int(below[gap])):
            while x and left[x] - own.count(x) <= 0:
                x = int(below[x - 1])
            if not x:
                break
            own.append(x)
            gap -= x
        if gap and own:
            least = own[-1]
            room = gap + least
            free = left[: room + 1].copy()
            for x in own[:-1]:
                if x <= room:
                    free[x] -= 1
            have = np.flatnonzero(free > 0)
            if len(have):
                # For each length the longest partner that still fits beside it.
                longest = np.maximum.accumulate(np.where(free > 0, np.arange(room + 1), 0))
                partner = longest[room - have]
                total = np.where(partner > 0, have + partner, 0)
                twice = (partner == have) & (free[have] < 2)
                total[twice] = 0
                best = int(total.argmax())
                if total[best] > least:
                    own[-1:] = sorted((int(have[best]), int(partner[best])), reverse=True)
        sizes, needs = np.unique(own, return_counts=True)
        times = int((left[sizes] // needs).min())
        left[sizes] -= times * needs
        if (left[sizes] == 0).any():
            below = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
        patterns.append((own, times))
    return patterns


def placement(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks within a length that lie at one offset of consecutive sequences, sorted by (length, first rank)."""
    length, first, sequence, offset = [], [], [], []
    ranks: dict[int, int] = {}
    used = 0
    for own, times in patterns:
        at = 0
        for x in own:
            length.append(x)
            first.append(ranks.get(x, 0))
            sequence.append(used)
            offset.append(at)
            ranks[x] = ranks.get(x, 0) + times
            at += x
        used += times
    key = (np.array(length, np.int64) << 44) | np.array(first, np.int64)
    order = np.argsort(key)
    return {"key": key[order], "first": np.array(first, np.int64)[order], "sequence": np.array(sequence, np.int64)[order], "offset": np.array(offset, np.int64)[order]}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to ``capacity``."""
    spark = pieces.sparkSession
    salts = min(MOST_SALTS, max(SALTS, parallelism(pieces)))
    # Rows are written once: numbering must see the same rows each time.
    rows = materialise(pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))
    table = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most capacity x MOST_SALTS rows
    by_salt = np.zeros((capacity + 1, salts), np.int64)
    by_salt[table.column("length").to_numpy(), table.column("salt").to_numpy()] = table.column("n").to_numpy()
    before = np.cumsum(by_salt, axis=1) - by_salt
    sent = spark.sparkContext.broadcast((before, placement(best_two_fit(by_salt.sum(1), capacity))))

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    given = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, runs = sent.value
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + offsets[n, batch.column("salt").to_numpy()]
            at = np.searchsorted(runs["key"], (n << 44) | rank, side="right") - 1
            yield pa.record_batch([*(batch.column(c) for c in given), pa.array(runs["sequence"][at] + rank - runs["first"][at]), pa.array(runs["offset"][at])], [*given, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    return pack(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), capacity)
