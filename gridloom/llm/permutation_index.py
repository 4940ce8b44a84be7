"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors (those with the smallest hash of
their id). A vector is represented by the order of its ``prefix`` nearest
pivots, and posted, with its place in that order, to the inverted file of each
of these. A search reads the inverted files of the query's own ``prefix``
nearest pivots and no others: the footrule distance of two prefixes, with
places beyond the prefix counted as its length, falls by 2 * (prefix -
max(place, place')) for every pivot in both, so that adding up these amounts
over what was posted there ranks all that were met. The best of a block by
footrule, ``rerank`` of its rows and ``rerank_k`` times k more, are then ranked
by the exact inner product on the original vectors, in double precision. With
1,024 pivots and prefixes of 64 a query adds 4 numbers for each vector and
multiplies 12 % of them.

Every vector is indexed, in blocks of about ``block_rows``, whose orders are
worked out once. Queries, a stated share of the rows, come in parts of about
``query_rows``; every part meets every block in a row of its own.

Nearness is the largest inner product; ties go to the smaller id.

Defined cases: vectors that are null, zero, of another length than most (the
smallest of the most common lengths counts), or hold null or non-finite
components take no part, as query or candidate; so do null ids. Rows alike in
id and vector count once; of an id with several vectors each is a candidate,
the id is given once, with its largest product, and the first of the vectors in
their order asks. A query's own id never is a candidate, whatever its vector.
Fewer candidates than k give all; empty tables give empty results; results have
only the columns named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of vectors that take part, all of one length."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(finite & F.exists("v", lambda x: x != 0))
    )
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int, at_once: int = 1024) -> np.ndarray:
    """Indices of the ``prefix`` nearest pivots of each row, nearest first; ties to the earlier pivot."""
    out = np.empty((len(x), prefix), np.int16)
    for a in range(0, len(x), at_once):
        z = -(x[a : a + at_once] @ pivots.T)
        if prefix < len(pivots):
            some = np.sort(np.argpartition(z, prefix - 1, axis=1)[:, :prefix], axis=1)
            place = np.argsort(np.take_along_axis(z, some, axis=1), axis=1, kind="stable")
            out[a : a + at_once] = np.take_along_axis(some, place, axis=1)
        else:
            out[a : a + at_once] = np.argsort(z, axis=1, kind="stable")
    return out


class InvertedFiles:
    """For each pivot, the rows of a block posted to it and what each is posted with: prefix - place."""

    def __init__(self, order: np.ndarray, n_pivots: int) -> None:
        self.n, self.prefix = order.shape
        pivot = order.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.rows = (by_pivot // self.prefix).astype(np.int32)
        self.amount = (self.prefix - by_pivot % self.prefix).astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(pivot, minlength=n_pivots))])

    def closeness(self, query: np.ndarray) -> np.ndarray:
        """What the footrule distance to a query's order falls by, halved, for each row; 0 for rows that were not met."""
        at = [slice(self.ends[p], self.ends[p + 1]) for p in query.tolist()]
        mine = np.repeat(np.arange(self.prefix, self.prefix - len(query), -1), [s.stop - s.start for s in at])
        amount = np.minimum(np.concatenate([self.amount[s] for s in at]), mine)
        return np.bincount(np.concatenate([self.rows[s] for s in at]), amount, self.n)


def most(values: np.ndarray, n: int) -> np.ndarray:
    """Positions, ascending, of the n largest; of equal ones those that come first."""
    if n >= len(values):
        return np.arange(len(values))
    least = np.partition(values, len(values) - n)[len(values) - n]
    above, equal = np.flatnonzero(values > least), np.flatnonzero(values == least)
    return np.sort(np.concatenate([above, equal[: n - len(above)]]))


def search_block(ids: np.ndarray, x: np.ndarray, files: InvertedFiles, query_ids: np.ndarray, queries: np.ndarray, query_orders: np.ndarray, k: int, rerank: float, rerank_k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, ids and scores of each query's k best ids in one block of the index."""
    take = math.ceil(rerank * len(ids)) + rerank_k * k
    for q, v, order in zip(query_ids, queries, query_orders, strict=True):
        close = files.closeness(order)
        own = np.flatnonzero(ids == q)
        close[own] = -1  # behind all others, and then left out
        near = most(close, take)
        near = near[ids[near] != q]
        scores = (x[near] * v).sum(axis=1)
        best = np.lexsort((ids[near], -scores))
        first = np.sort(np.unique(ids[near[best]], return_index=True)[1])[:k]
        best = best[first]
        yield np.full(len(best), q), ids[near[best]], scores[best]


_PACKED = "ids array<long>, v array<double>, orders array<short>"


def _packed(rows: DataFrame, parts: int, name: str, pivots: np.ndarray, prefix: int) -> DataFrame:
    """(name, ids, v, orders): the rows of each part in one row, dealt by a hash of id and vector, with their orders."""

    def with_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                found = b.column("rows").slice(i, 1).flatten()
                v = found.field("v").flatten()
                order = orders(v.to_numpy(zero_copy_only=False).reshape(len(found), -1), pivots, prefix)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([b.column(name).slice(i, 1), one(found.field("vec_id")), one(v), one(pa.array(order.ravel()))], names=[name, "ids", "v", "orders"])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(parts)).cast("int"))
    return dealt.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows")).mapInArrow(with_orders, f"{name} int, {_PACKED}")


def search(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, n_pivots: int = 1024, prefix: int = 64,
    rerank: float = 0.12, rerank_k: int = 4, block_rows: int = 4096, query_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k nearest found for each query, over all vectors."""
    rows = cut(usable(vectors, vec_id, embedding).dropDuplicates(["vec_id", "v"]))
    total = rows.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).toPandas()
    pivots = np.array(sample["v"].tolist(), float)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    depth, width = min(prefix, len(pivots)), pivots.shape[1]
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id")).distinct()
    q = rows.join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-total // block_rows))
    groups = max(1, -(-q.count() // query_rows))
    # a row for each part and block, told apart by both
    index = cut(_packed(rows, blocks, "block", pivots, depth)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    parts = cut(_packed(q, groups, "part", pivots, depth)).select("part", *[F.col(c).alias(f"q_{c}") for c in ("ids", "v", "orders")]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = index.join(parts, ["part", "block"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                cell = lambda c: b.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                files = InvertedFiles(cell("orders").reshape(-1, depth), len(pivots))
                hits = list(search_block(cell("ids"), cell("v").reshape(-1, width), files, cell("q_ids"), cell("q_v").reshape(-1, width), cell("q_orders").reshape(-1, depth), k, rerank, rerank_k))
                columns = [np.concatenate(c) for c in zip(*hits, strict=True)] if hits else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    names = ["ids", "v", "orders", "q_ids", "q_v", "q_orders"]
    hits = tiles.select(*names).mapInArrow(found, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
