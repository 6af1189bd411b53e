"""Exact top-k by inner product, from an impact-ordered index read score at a time.

Vectors are dealt into blocks. A block's index has, for each dimension, postings cut
into segments by the size of the component, quantised to powers of two. For a query,
segments are processed by descending impact (query component times the segment's
upper bound), adding exact products to the scores of the vectors in them. What
is not yet processed bounds how far any score can still move; the block stops only when
at most as many vectors as are worth rescoring can be among the k best, and rescores
those exactly.

Scale: the queries are a stated set, dealt into blocks too; every pair of blocks is
a task's work, and a row is copied once for each block of the other side. Only k rows
for each query and block are exchanged after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_bucket, prepare, stored

#: Vectors and queries of one block; postings processed between two looks at the bound.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
STEPS = 10
#: Vectors that a query's first bound is taken from; integers below this are exact as doubles.
PIVOTS, EXACT = 1024, 2.0**53


def integer_components(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for vectors null or with null or non-finite components."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    return F.when(embedding.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; an error if one is beyond 64 bits."""
    if not vectors.size or float(np.abs(vectors.astype(np.float64)).max()) * float(np.abs(query.astype(np.float64)).max()) * vectors.shape[1] < EXACT:
        return vectors @ query
    out = vectors.astype(object) @ query.astype(object)
    if max(abs(int(x)) for x in out) >= 1 << 63:
        raise OverflowError("a score beyond 64 bits")
    return out.astype(np.int64)


class ImpactIndex:
    """Postings of a block: by dimension and sign, cut where the component's size passes a power of two."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.segments: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        size = np.abs(vectors)
        level = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, 0)
        for d in range(vectors.shape[1]):
            for l in np.unique(level[:, d]):
                if l:
                    rows = np.flatnonzero(level[:, d] == l)
                    self.segments.append((d, int(l), int(size[rows, d].max()), rows, vectors[rows, d].astype(np.float64)))
        self.dims = np.array([s[0] for s in self.segments], np.int64)
        self.bounds = np.array([s[2] for s in self.segments], np.int64)
        self.lengths = np.array([len(s[3]) for s in self.segments], np.int64)
        #: for each dimension, the place of its segments by descending bound, for what remains
        self.top = np.zeros(vectors.shape[1], np.int64)
        np.maximum.at(self.top, self.dims, self.bounds)
        self.large = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * vectors.shape[1]

    def search(self, query: np.ndarray, k: int, own: int | None, least: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k largest scores of vectors other than own, ties to smaller ids. Vectors that can't reach least, a bound on the k-th best of all blocks, may be left out."""
        n = len(self.ids)
        if not n:
            return self.ids, np.zeros(0, np.int64)
        allowed = self.ids != own if own is not None else np.ones(n, bool)
        if self.large * float(np.abs(query.astype(np.float64)).max(initial=0)) >= EXACT:  # no bound of doubles is a proof
            return self._best(np.flatnonzero(allowed), query, k)
        impact = np.abs(query[self.dims]) * self.bounds
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        work = np.cumsum(self.lengths[order])
        score = np.zeros(n)
        done = 0
        candidates = np.flatnonzero(allowed)
        np.maximum.at(left := np.zeros_like(self.top), self.dims[order], impact[order])
        if left.sum() < least:
            return self.ids[:0], np.zeros(0, np.int64)  # proof: no vector of this block reaches the bound
        while done < len(order):
            upto = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + work[-1] / STEPS, "right")))
            some = [self.segments[i] for i in order[done:upto]]
            rows = np.concatenate([s[3] for s in some])
            add = np.concatenate([s[4] * float(query[s[0]]) for s in some])
            score += np.bincount(rows, add, n)
            done = upto
            rest = order[done:]
            left[:] = 0  # of each dimension: the most that what isn't processed can add or take
            np.maximum.at(left, self.dims[rest], impact[rest])
            move = left.sum()
            if done < len(order):
                now = score[candidates]
                kth = max(least, np.partition(now, len(now) - k)[len(now) - k] - move) if len(now) > k else least
                candidates = candidates[now + move >= kth]
                if len(candidates) <= max(4 * k, n // 200):
                    break  # proof: all others are below the k-th best
        return self._best(candidates, query, k)

    def _best(self, candidates: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = products(self.vectors[candidates], query)
        o = np.lexsort((self.ids[candidates], -exact))[:k]
        return self.ids[candidates][o], exact[o]


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(m, vectors, strict=True):
        row[: len(v)] = v
    return m


def _bounded(sent, k: int):
    """Queries with least: the k-th best score among the pivots other than their own id; null with fewer pivots."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pivots = np.array([i for i, _ in sent.value], np.int64), [v for _, v in sent.value]
        for b in batches:
            asked = [v.values.fill_null(0).to_numpy(zero_copy_only=False) for v in b["v"]]
            width = max((len(v) for v in [*pivots, *asked]), default=0)
            m, least = _padded(pivots, width), []
            for i, query in zip(b["id"].to_pylist(), _padded(asked, width), strict=True):
                s = products(m, query)[ids != i]
                least.append(int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None)
            yield pa.record_batch([b["id"], b["v"], pa.array(least, pa.int64())], names=["id", "v", "least"])

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): each query's k highest inner products of integer vectors.

    vectors and queries have an id and an array of integers. A query's own id is no
    candidate for it. Ties go to the smaller id. With fewer candidates, all. Null
    ids or vectors take no part; a vector's missing or further components count
    as 0; repeated rows are candidates once for each row. Empty tables give an empty one.
    Other columns, whatever their names, are not read. Where products could leave the
    integers that a double holds exactly, whole integers of any size are summed
    instead; a score beyond 64 bits is an error.

    Before the blocks are searched, each query is scored against the PIVOTS longest
    vectors: the k-th best of these is a bound for all blocks, and no result can be below it.
    """
    spark = vectors.sparkSession
    prepare(spark)
    def checked(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null")

    x, q = stored(checked(vectors), "vectors"), checked(queries)
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(F.coalesce(c, F.lit(0)).cast("double"), F.lit(2.0)))
    pivots = x.orderBy(length.desc_nulls_last(), "id").limit(PIVOTS).collect()  # PIVOTS rows at most
    sent = spark.sparkContext.broadcast([(r.id, np.array([c or 0 for c in r.v], np.int64)) for r in pivots])
    q = stored(q.mapInArrow(_bounded(sent, k), "id long, v array<long>, least long"), "queries")
    x = x.withColumn("least", F.lit(None).cast("long"))
    nx, nq = max(1, math.ceil(x.count() / BLOCK_ROWS)), max(1, math.ceil(q.count() / BLOCK_QUERIES))
    n = nx * nq

    def dealt(df: DataFrame, mine: int, other: int, kind: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int")
        cell = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        x = df.select("id", "v", "least", block.alias("own"), cell.alias("other"))
        at = F.col("own") * nq + F.col("other") if kind == 0 else F.col("other") * nq + F.col("own")
        return x.select(at.cast("int").alias("cell"), F.lit(kind).alias("kind"), "id", "v", "least")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[list] = [[], []]
        for b in batches:
            for kind, i, v, least in zip(b["kind"].to_pylist(), b["id"].to_pylist(), b["v"], b["least"].to_pylist(), strict=True):
                sides[kind].append((i, v.values.fill_null(0).to_numpy(zero_copy_only=False), -math.inf if least is None else least))
        width = max((len(v) for s in sides for _, v, _ in s), default=0)
        found = []
        if sides[0] and sides[1] and width:
            index = ImpactIndex(np.array([i for i, *_ in sides[0]], np.int64), _padded([v for _, v, _ in sides[0]], width))
            for (i, _, least), query in zip(sides[1], _padded([v for _, v, _ in sides[1]], width), strict=True):
                a, s = index.search(query, k, i, least)
                found += [(i, int(x), int(y)) for x, y in zip(a, s, strict=True)]
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    cells = dealt(x, nx, nq, 0).unionByName(dealt(q, nq, nx, 1))
    best = by_bucket(cells, n, "cell").mapInArrow(of, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
