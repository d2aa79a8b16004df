"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are stored by dimension (vertical layout). For each query the products are added up block of
dimensions by block; after a block, a candidate whose sum plus the largest possible rest (Cauchy-
Schwarz on the remaining mass of both vectors) is below the k-th best sure score is dropped, and the
survivors are compacted. Scores are integers, so results are exact.

Queries are dealt into blocks of bounded size by a hash of their id. Each block is broadcast and the
candidates are scanned once for it; a task carries the k-th best score of a query from one batch of
candidates to the next, as a floor for the bounds, and gives at most k rows a query at its end; a second
step ranks them. Where there are several blocks, each one's result is written and its broadcast released
before the next, so the driver holds one block at a time.

Defined cases: vectors that are null or empty or hold null or non-finite components take no part, neither do
rows without an id; the query's own row is known by its id, so rows that repeat the id are left out for
that query too, and of rows that repeat a query's id the least vector asks; vectors of different lengths are not compared; ties go to the smaller id; fewer
candidates than k give all of them; components are exact up to 2 ** 53 / scale in size; repeated rows are
candidates each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Queries of a block: with 1000 dimensions of 8 bytes, 16 MB at most are broadcast.
BLOCK_QUERIES = 2048
BLOCK_DIMS = 16


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK_DIMS, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and ids and scores of its best k rows of ``data`` (n x dims, int64).

    floors: for each query a score; rows below it may be left out.
    """
    dims = data.shape[1]
    columns = np.ascontiguousarray(data.T)
    edges = [*range(0, dims, block), dims] if dims else [0]
    # Remaining mass of every row and query after each block; rounded up, so the bound holds.
    rest = [np.sqrt((columns[e:].astype(np.float64) ** 2).sum(0)) for e in edges[1:]]
    if floors is None:
        floors = np.full(len(queries), np.iinfo(np.int64).min)
    for q, own, floor in zip(queries, query_ids, floors.astype(np.float64), strict=True):
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), np.int64)
        for b in range(len(edges) - 1):
            low, high = edges[b], edges[b + 1]
            part = columns[low:high] if len(alive) == data.shape[0] else columns[low:high, alive]
            score = score + q[low:high] @ part
            if high < dims and (len(alive) > k or floor > -1e18):
                bound = rest[b][alive] * math.sqrt(float((q[high:].astype(np.float64) ** 2).sum())) * (1 + 1e-9) + 1
                sure = max(floor, np.partition(score - bound, len(alive) - k)[len(alive) - k] if len(alive) > k else floor)
                keep = score + bound >= sure
                alive, score = alive[keep], score[keep]
        if len(alive) > k:
            # All rows of the k-th best score, then the smaller ids among them.
            least = np.partition(score, len(alive) - k)[len(alive) - k]
            keep = score >= least
            alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        yield int(own), ids[alive][best], score[best]


def _dense(vectors: pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, dims, v: the vectors that take part, each component x as floor(scale * x)."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(id_col).isNotNull()
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dims"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), the candidate's id, score: the k best candidates of every query."""
    rows = quantised(vectors, id_col, vector_col, scale)
    queries = quantised(vectors.filter(is_query), id_col, vector_col, scale)
    queries = queries.groupBy("id").agg(F.min(F.struct("dims", "v")).alias("q")).select("id", "q.dims", "q.v")
    blocks = max(1, math.ceil(queries.count() / block_queries))
    spark = vectors.sparkSession
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        table = mine.toArrow()
        for n in set(table.column("dims").to_pylist()):
            part = table.filter(pa.compute.equal(table.column("dims"), n))
            held[n] = (part.column("id").to_numpy(), _dense(part.column("v")))
        sent = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                dims = batch.column("dims").to_numpy()
                for n in np.unique(dims):
                    if int(n) not in sent.value:
                        continue
                    part = batch.filter(pa.array(dims == n))
                    q_ids, q = sent.value[int(n)]
                    into = best.setdefault(int(n), {})
                    floors = np.array([into[at][1][-1] if at in into and len(into[at][1]) == k else np.iinfo(np.int64).min for at in range(len(q_ids))], np.int64)
                    for at, (_, ids, scores) in enumerate(search(q, q_ids, _dense(part.column("v")), part.column("id").to_numpy(), k, floors=floors)):
                        if at in into:
                            ids, scores = np.concatenate([into[at][0], ids]), np.concatenate([into[at][1], scores])
                            keep = np.lexsort((ids, -scores))[:k]
                            ids, scores = ids[keep], scores[keep]
                        into[at] = (ids, scores)
            for n, into in best.items():
                q_ids = sent.value[n][0]
                sizes = [len(into[at][0]) for at in into]
                if sum(sizes):
                    yield pa.record_batch([pa.array(np.repeat(q_ids[list(into)], sizes), pa.int64()), pa.array(np.concatenate([x[0] for x in into.values()]), pa.int64()), pa.array(np.concatenate([x[1] for x in into.values()]), pa.int64())], ["query_id", "id", "score"])

        part = rows.mapInArrow(scan, "query_id long, id long, score long")
        part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
        if blocks > 1:
            part = materialise(part)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found
