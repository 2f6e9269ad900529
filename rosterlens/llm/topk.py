"""Exact top-k by inner product: histograms find each query's k-th best score, a filter does the rest.

Queries are taken in blocks of a fixed size; a block is broadcast and every vector scored against it.
Each pass counts the scores of every query in equal bins over a range, then the range is narrowed to the
bin that holds the k-th best, until bins are single integers.  A last pass keeps what reaches that score;
ties at it are broken by the smaller vec_id.

Doubles add up such scores exactly as long as the product of two vectors' norms is under 2^53, which bounds every partial sum.
Vectors of a norm of 2^26 or more are rare; whatever they take part in, as queries or as candidates, is scored in whole
numbers of any size, in blocks as well, and merged.  A score beyond 64 bits is ranked by its value and returned as the
nearest number of 64 bits.

A part of the vectors that has k scores above some bin itself need not report lower ones: the k-th best
of all is no worse than that of any part.  So parts send a few bins for a query, and at last k rows.
"""

from __future__ import annotations

import heapq
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .storage import written

BINS = 256
COLUMNS = 512  # vectors scored at a time
LARGE = float(1 << 26)  # norms under which double arithmetic keeps scores exact
RARE_ROWS = 256  # large vectors that are with the tasks at a time
LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as doubles that hold integers.

    Vectors that are null, hold a null component or one that is not finite (once scaled), or have no id, take no part.
    """
    def whole(c):  # doubles from 2^52 on are whole; floor() would cut them off at 64 bits
        scaled = c.cast("double") * F.lit(float(scale))
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)

    x = F.transform("embedding", whole)
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & ((F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(float("inf")))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")
    )


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


class Block:
    """Queries of one length; for each the range of scores its k-th best is in (``high`` exclusive), the width
    of a bin, and how many of the scores in the range are needed."""

    def __init__(self, ids, vectors, bound, k):
        self.ids, self.vectors, self.low, self.high = ids, vectors, -bound, bound + 1
        self.width = np.ceil((self.high - self.low) / BINS)
        self.need = np.full(len(ids), k, dtype=np.int64)

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and which of them count: all but those of the query's own id."""
        return self.vectors @ vectors.T, self.ids[:, None] != ids[None, :]


def chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, COLUMNS):
            part = batch.slice(at, COLUMNS)
            yield part.column(0).to_numpy(), matrix(part.column(1))


def histogram(vectors: DataFrame, block: Block) -> DataFrame:
    """(q, bin, n): the highest bins of each query that can hold its k-th best score, all parts together."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        n = len(b.ids)
        total = np.zeros(n * BINS, dtype=np.int64)
        offset = (np.arange(n) * BINS)[:, None]
        for ids, rows in chunks(batches, b.vectors.shape[1]):
            score, counts = b.scores(ids, rows)
            place = np.floor((score - b.low[:, None]) / b.width[:, None])
            counts &= (score >= b.low[:, None]) & (score < b.high[:, None])
            total += np.bincount((place.astype(np.int64) + offset)[counts], minlength=n * BINS)
        total = total.reshape(n, BINS)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # scores in higher bins
        q, place = np.nonzero((total > 0) & (above < b.need[:, None]))
        yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "bin": place.astype(np.int32), "n": total[q, place]})

    counts = vectors.mapInArrow(run, "q int, bin int, n long")
    return counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))


def narrowed(vectors: DataFrame, block: Block) -> None:
    """Move each query's ``low`` to its k-th best score; it stays the lowest possible one if there are fewer."""
    spark = vectors.sparkSession
    while len(block.ids):
        need = spark.createDataFrame(list(enumerate(block.need.tolist())), "q int, need long")
        up = Window.partitionBy("q").orderBy(F.col("bin").desc())
        seen = histogram(vectors, block).withColumn("sofar", F.sum("n").over(up))
        reached = seen.join(F.broadcast(need), "q").where("sofar >= need")
        found = reached.groupBy("q").agg(F.max("bin").alias("bin"), F.max_by(F.col("sofar") - F.col("n"), "bin").alias("above")).collect()
        last = not any(block.width[r.q] > 1 for r in found)
        for r in found:  # one row a query of the block
            block.low[r.q] += r.bin * block.width[r.q]
            block.high[r.q] = min(block.high[r.q], block.low[r.q] + block.width[r.q])
            block.width[r.q] = np.ceil(block.width[r.q] / BINS)
            block.need[r.q] -= r.above
        if last:
            return


def reaching(vectors: DataFrame, block: Block, k: int) -> DataFrame:
    """(query_id, vec_id, score) of scores from ``low`` on; each part keeps its k best of a query."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def best(q, ids, score):
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        starts = np.searchsorted(q, q)  # where each query's rows begin
        stay = np.arange(len(q)) - starts < k
        return q[stay], ids[stay], score[stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for ids, rows in chunks(batches, b.vectors.shape[1]):
            score, counts = b.scores(ids, rows)
            q, c = np.nonzero(counts & (score >= b.low[:, None]))
            held = best(*(np.concatenate(x) for x in zip(held, (q, ids[c], score[q, c]))))
        yield pa.RecordBatch.from_pydict({"query_id": b.ids[held[0]], "vec_id": held[1], "score": held[2].astype(np.int64)})

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_scores(rows: DataFrame, block: pa.Table, k: int, are_queries: bool) -> DataFrame:
    """(query_id, vec_id, score in digits): the rows against a block of vectors, in whole numbers of any size.

    The block's vectors are the queries or the candidates.  Of each query every part keeps its k best.
    """
    ids = block.column("vec_id").to_pylist()
    whole = [list(map(int, v)) for v in block.column("v").to_pylist()]
    shared = rows.sparkSession.sparkContext.broadcast((ids, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, whole = shared.value
        best: dict[int, list[tuple[int, int]]] = {}

        def rows_of(q: int, found: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
            return [(q, v, str(-s)) for s, v in heapq.nsmallest(k, found)]

        def batch_of(made: list[tuple[int, int, str]]) -> pa.RecordBatch:
            q, v, s = zip(*made) if made else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.string())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            made = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                v = list(map(int, v))
                scores = [(-sum(map(operator.mul, v, w)), j) for j, w in zip(ids, whole) if j != i]
                if not are_queries:
                    made += rows_of(i, scores)
                    continue
                for s, j in scores:
                    found = best.setdefault(j, [])
                    found.append((s, i))
                    if len(found) >= 4 * k:
                        best[j] = heapq.nsmallest(k, found)
            yield batch_of(made)
        yield batch_of([r for j, found in best.items() for r in rows_of(j, found)])

    return rows.mapInArrow(run, "query_id long, vec_id long, score string")


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of (query_id, vec_id, score in digits): a few rows a query and part."""

    def best(rows: pa.Table) -> pa.Table:
        table = sorted((-int(s), v) for v, s in zip(rows.column("vec_id").to_pylist(), rows.column("score").to_pylist()))[:k]
        columns = {
            "query_id": rows.column("query_id").slice(0, len(table)),
            "rank": pa.array(range(1, len(table) + 1), pa.int32()),
            "vec_id": pa.array([v for _, v in table], pa.int64()),
            "score": pa.array([min(max(-s, LONG[0]), LONG[1]) for s, _ in table], pa.int64()),
        }
        return pa.table(columns)

    return found.groupBy("query_id").applyInArrow(best, "query_id long, rank int, vec_id long, score long")


def blocks_of(rows: DataFrame, n: int, block_rows: int) -> Iterator[pa.Table]:
    """All of ``n`` rows (vec_id, v), at most about ``block_rows`` at a time, by a hash of the id."""
    parts = -(-n // block_rows)
    for i in range(parts):
        block = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i).orderBy("vec_id").toArrow()
        if block.num_rows:
            yield block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query.

    Both frames: vec_id, v as ``quantized`` makes them.  Candidates are all vectors of the query's length
    but those of its own id; queries that share an id count once, with the smallest vector.  At most
    ``block_rows`` queries are with the driver and the tasks at a time.  Empty tables give no rows, vectors that
    repeat are candidates each, and columns but these two are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4 * COLUMNS)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors = written(vectors.select("vec_id", "v", F.size("v").alias("n"), norm.alias("norm")))
    queries = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("n"), norm.alias("norm")))
    usual = F.col("norm") < LARGE
    peak = {r.n: r for r in vectors.groupBy("n").agg(F.max(F.when(usual, F.col("norm"))).alias("norm"), F.count_if(~usual).alias("large")).collect()}
    found, exact = [], []
    for n, rows, large in queries.groupBy("n").agg(F.count_if(usual), F.count_if(~usual)).collect():  # a row for each length
        if n not in peak:
            continue
        own, here = (x.where(F.col("n") == n).select("vec_id", "v", usual.alias("usual")) for x in (queries, vectors))
        if rows and peak[n].norm is not None:
            for mine in blocks_of(own.where("usual").drop("usual"), rows, block_rows):
                q = matrix(mine.column("v").combine_chunks())
                block = Block(mine.column("vec_id").to_numpy(), q, np.ceil(np.sqrt((q * q).sum(axis=1)) * peak[n].norm) + 1, k)
                ordinary = here.where("usual").drop("usual")
                narrowed(ordinary, block)
                found.append(written(reaching(ordinary, block, k)))
        if rows and peak[n].large:
            for some in blocks_of(here.where("not usual").drop("usual"), peak[n].large, RARE_ROWS):
                exact.append(written(exact_scores(own.where("usual").drop("usual"), some, k, are_queries=False)))
        if large:
            for mine in blocks_of(own.where("not usual").drop("usual"), large, RARE_ROWS):
                exact.append(written(exact_scores(here.drop("usual"), mine, k, are_queries=True)))
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if found:
        out = reduce(DataFrame.unionByName, found)
    if exact:
        digits = reduce(DataFrame.unionByName, exact, out.withColumn("score", F.col("score").cast("string")))
        return merged(digits, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
