"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language with a partial sum in every batch; what reaches the driver
is a matrix of at most ``buckets`` x languages counts. Its logarithms are broadcast. Scoring hashes all
n-grams of a batch of texts at once in numpy and adds up the log-probabilities of each text, so memory
is that of one batch; long texts are scored in pieces, whole.

Training may be bounded: about ``train_docs`` labelled rows are drawn in proportion to their labels, but
``LABEL_DOCS`` of each label at least, so rare languages are learned too. The sample is drawn by a hash of
the id, so it is the same on every run; all other steps read all rows.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; without any training
row every text does; a null id is never held out; labels that are null are not learned; every input
row gives one output row; other columns are not looked at. Ties go to the label that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Letters and what looks like them to the expression: signs such as ² and Ⅷ, which are numbers.
LETTER = re.compile(r"[^\W\d_]")
#: Characters that are hashed at once.
PIECE = 1 << 18
MAX_LANGUAGES = 1024
#: Rows of a label that are drawn at least, where it has them.
LABEL_DOCS = 500


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def grams(text: str, sizes: tuple[int, ...], buckets: int, seen: int = 0) -> np.ndarray:
    """Bucket of every n-gram of a piece of lower-case text; digits and other signs are blanks.

    N-grams within the first ``seen`` characters, those of the piece before, don't count again.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    codes = np.where((codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 192)), np.uint64(32), codes)
    out = []
    for n in sizes:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for i in range(n):
                h ^= codes[i : len(codes) - n + 1 + i]
                h *= np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            out.append((h[max(0, seen - n + 1) :] % np.uint64(buckets)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def pieces(text: str, sizes: tuple[int, ...]) -> Iterator[tuple[str, int]]:
    """The lower-case text in pieces that overlap by the longest n-gram less one character, so that
    n-grams over a cut count, and how many characters of each were in the piece before."""
    text = text.lower()
    over = max(sizes) - 1
    for start in range(0, max(1, len(text)), PIECE):
        seen = min(start, over)
        yield text[start - seen : start + PIECE], seen


def train(docs: DataFrame, label_col: str, id_col: str, text_col: str, sizes: tuple[int, ...], buckets: int, train_docs: int) -> tuple[list[str], np.ndarray]:
    """Labels in order, and log-probabilities (buckets + 1 x labels; the last row has the priors)."""
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes_of = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).cast("string")).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes_of) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    n = sum(sizes_of.values())
    if n > train_docs:
        # In millionths, by label.
        share = {x: min(1_000_000, int(1_000_000 * max(train_docs / n, LABEL_DOCS / m))) for x, m in sizes_of.items()}
        table = F.create_map(*(F.lit(v) for pair in share.items() for v in pair))
        rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.element_at(table, F.col(label_col).cast("string")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, "text"):
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = sums.setdefault(label, np.zeros(buckets + 1, np.int64))
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} labels")
                own[buckets] += 1
                for piece, seen in pieces(text, sizes):
                    own[:buckets] += np.bincount(grams(piece, sizes, buckets, seen), minlength=buckets)
        for label, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["label", "bucket", "n"])

    counted = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).mapInArrow(count, "label string, bucket int, n long")
    table = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = sorted(set(table.column("label").to_pylist()))
    counts = np.zeros((buckets + 1, len(labels)))
    if labels:
        at = {x: i for i, x in enumerate(labels)}
        counts[table.column("bucket").to_numpy(), [at[x] for x in table.column("label").to_pylist()]] = table.column("n").to_numpy()
    logs = np.log(counts[:buckets] + 0.5) - np.log(counts[:buckets].sum(0) + 0.5 * buckets)
    priors = np.log(np.maximum(counts[buckets:], 1)) - np.log(max(1.0, counts[buckets:].sum()))
    return labels, np.vstack([logs, priors]).astype(np.float32)


def scorer(model, sizes: tuple[int, ...], buckets: int):
    """A function from texts to (labels, scores), for use inside a task."""

    def score(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, by_label = model.value
        priors = by_label[:, buckets].astype(np.float64)
        sums = np.zeros((len(texts), len(names)))
        # Short texts go together: n-grams over the border of two texts are not made.
        hashed, owner = [], []
        for i, text in enumerate(texts):
            if text is None or not has_letter(text) or not names:
                continue
            for piece, seen in pieces(text, sizes):
                hashed.append(grams(piece, sizes, buckets, seen))
                owner.append(i)
        filled = [(h, i) for h, i in zip(hashed, owner, strict=True) if len(h)]
        if filled:
            flat = np.concatenate([h for h, _ in filled])
            starts = np.cumsum([0, *(len(h) for h, _ in filled[:-1])])
            where = np.array([i for _, i in filled])
            for c in range(len(names)):
                np.add.at(sums[:, c], where, np.add.reduceat(by_label[c].take(flat), starts, dtype=np.float64))
        und = np.ones(len(texts), bool)
        und[owner] = False
        sums += priors
        if names:
            best = sums.argmax(1)
            share = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
        pred = ["und" if u else names[best[i]] for i, u in enumerate(und)]
        return pred, np.where(und, 0.0, share if names else 0.0)

    return score


def broadcast_model(docs: DataFrame, labels: list[str], logs: np.ndarray):
    return docs.sparkSession.sparkContext.broadcast((labels, np.ascontiguousarray(logs.T)))


def predict(docs: DataFrame, labels: list[str], logs: np.ndarray, id_col: str, text_col: str, sizes: tuple[int, ...], buckets: int) -> DataFrame:
    """id, lang_pred, score: the most probable label and its share of the probability."""
    score = scorer(broadcast_model(docs, labels, logs), sizes, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            pred, share = score(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("id"), pa.array(pred, pa.string()), pa.array(share, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, train_docs: int = 20_000) -> DataFrame:
    """id, held_out, lang_pred, score for each row; learns from labelled rows that are not held out."""
    labels, logs = train(docs.filter(~held_out(id_col)), label_col, id_col, text_col, sizes, buckets, train_docs)
    return predict(docs, labels, logs, id_col, text_col, sizes, buckets).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, train_docs: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with at least ``least_score``.

    Rows pass through the scoring function whole, so no join is needed to apply the decision.
    """
    labels, logs = train(docs.filter(~held_out(id_col)), label_col, id_col, text_col, sizes, buckets, train_docs)
    score = scorer(broadcast_model(docs, labels, logs), sizes, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, 1 << 20):
            pred, share = score(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([p != "und" and s >= least_score for p, s in zip(pred, share, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
