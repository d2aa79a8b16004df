"""Byte-level BPE by a tree of joins.

A text is cut into halves until the parts are short; each is encoded alone. Two neighbours are joined
by encoding anew a window around their border. The window grows on both sides until it ends at a
position that starts a new pre-token whatever stands around it (a space between a non-space and a
letter). The pattern has no look-behind and no piece crosses such a position, so tokens outside the
window are those of the joined text: joining is associative and the tree's shape does not matter.
Decoding concatenates the parts' bytes up the tree.

Defined cases: a null text is empty (0 tokens); texts without any such position are encoded anew as
a whole when joined, which is slow but right; every input row, repeated ones too, gives one output row; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: A new piece starts at the space: before it no white space, after it an ASCII letter.
STARTS = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")


class TreeBpe:
    made: dict[tuple, TreeBpe] = {}

    def __init__(self, ranks: str, pattern: str, leaf: int) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {v: k for k, v in table.items()}
        self.leaf = max(2, leaf)

    @classmethod
    def of(cls, ranks: str, pattern: str, leaf: int) -> TreeBpe:
        key = (ranks, pattern, leaf)
        if key not in cls.made:
            cls.made[key] = cls(*key)
        return cls.made[key]

    def encode(self, text: str) -> list[int]:
        return self._part(text, 0, len(text))

    def _part(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.encoding.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._part(text, start, middle), self._part(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        low = self._before(text, start, middle)
        high = self._after(text, middle, end)
        drop = self._tokens(reversed(left), len(text[low:middle].encode("utf-8", "surrogatepass")))
        skip = self._tokens(iter(right), len(text[middle:high].encode("utf-8", "surrogatepass")))
        del left[len(left) - drop :]
        left += self.encoding.encode_ordinary(text[low:high])
        left += right[skip:]
        return left

    def _before(self, text: str, start: int, middle: int) -> int:
        width = 32
        while middle - width > start:
            # The letter after the last space must itself lie left of the border or be known: text[middle] is.
            found = [m.start() for m in STARTS.finditer(text, middle - width, min(len(text), middle + 1))]
            found = [x for x in found if x < middle]
            if found:
                return found[-1]
            width *= 2
        return start

    def _after(self, text: str, middle: int, end: int) -> int:
        width = 32
        while True:
            # From middle + 1 on: the character before the space then belongs to the right part too.
            m = STARTS.search(text, middle + 1, min(end, middle + width))
            if m:
                return m.start()
            if middle + width >= end:
                return end
            width *= 2

    def _tokens(self, ids: Iterator[int], n_bytes: int) -> int:
        """How many of the tokens make up so many bytes."""
        n = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[next(ids)])
            n += 1
        assert n_bytes == 0, "a token crosses a border of pieces"
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def little_endian(ids: list[int]) -> bytes:
    import sys

    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids (array of int).

    ranks: path of a tiktoken rank file; pattern: what cuts texts before the merges; leaf: characters
    of a part that is encoded at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeBpe.of(ranks, pattern, leaf)
        for batch in by_bytes(batches, "text"):
            n, digest, back, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = tree.encode(text)
                n.append(len(ids))
                digest.append(hashlib.sha256(little_endian(ids)).hexdigest())
                back.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
