"""Token counts of whole texts by the `tokenizers` library, lengths only.

A text is cut before spaces, where byte-level pre-tokenisation always starts a new piece: at a space
after a non-space, or at the last space of a run before a non-space. Both are safe: no piece crosses
them, so the counts of the parts add up. Texts with longer runs of white space are cut at the single
spaces between other signs only, so a run stays within a part. Special strings without white space
lie within a part as well. The distinct parts of a batch that were not counted yet are encoded together,
in calls of about as many bytes each. A file with a normaliser, another pre-tokeniser, or special
strings that take white space in is used by whole texts.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); every input row, repeated ones too, gives
one output row; an empty table gives an empty result; other columns are not looked at. A part, the text
between two safe spaces, is encoded in one call however long it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

UNSAFE = re.compile(r"\s (?:\s|$)")
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Counts that a worker remembers, and the longest part that it remembers.
REMEMBERED, LONGEST = 400_000, 48


class Counter:
    """Counts for one tokenizer; a Python worker makes one and uses it for all its batches."""

    made: dict[str, Counter] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        before = own["pre_tokenizer"] or {}
        plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in own["added_tokens"])
        #: Whether parts between safe spaces can be counted by themselves.
        self.parted = plain and own["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def lengths(self, texts: list[str], call_bytes: int = 1 << 18) -> list[int]:
        out: list[int] = []
        start, total = 0, 0
        for i, text in enumerate(texts):
            total += len(text) if text.isascii() else len(text.encode())
            if total >= call_bytes or i + 1 == len(texts):
                out += [len(e) for e in self.tokenizer.encode_batch_fast(texts[start : i + 1], add_special_tokens=False)]
                start, total = i + 1, 0
        return out

    def count(self, texts: list[str]) -> list[int]:
        whole, parts = [], []
        for i, text in enumerate(texts):
            if not self.parted:
                whole.append(i)
                parts.append(None)
            else:
                first, *rest = SAFE.split(text) if UNSAFE.search(text) else text.split(" ")
                parts.append((first, rest))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = {w for p in parts if p for w in p[1]}.difference(known)
        new = list(new)
        once = {}
        for w, n in zip(new, self.lengths([" " + w for w in new]), strict=True):
            (known if len(w) <= LONGEST else once)[w] = n
        firsts = self.lengths([p[0] for p in parts if p])
        get = known.__getitem__ if not once else {**once, **known}.__getitem__
        out, n = [0] * len(texts), 0
        for i, p in enumerate(parts):
            if p:
                out[i] = firsts[n] + sum(map(get, p[1]))
                n += 1
        for i, n in zip(whole, self.lengths([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. tokenizer: path of a `tokenizers` file with byte-level pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in by_bytes(batches, "text", batch_bytes):
            n = pa.array(counter.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.compute.binary_length(batch.column("text")).cast(pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
