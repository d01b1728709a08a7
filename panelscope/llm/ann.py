"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and kept as its signs, packed to bits, with
one correction scalar. The signs estimate inner products without bias, within an
error bound that follows from the scalar. A vector is reranked with its original
components only if its bound reaches the best exact score found so far.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.5
BASE_BLOCK, QUERY_BLOCK = 4096, 512


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars: the inner product of each rotated unit
    vector with its own signs, scaled to length one."""
    y = unit(x) @ turn
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x codes) and their error bounds (codes)."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    y = (unit(queries) @ turn).astype(np.float32)
    est = (y @ signs.T) / np.sqrt(dim) / scalars[None, :].astype(np.float32)
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - scalars**2)) / scalars / np.sqrt(max(dim - 1, 1))
    return est, bound


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors give equal scores wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        got = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    bad = ~np.isfinite(got)
    if bad.any():
        got[bad] = (unit(a[bad]) * unit(b[bad])).sum(axis=1)
    return got


def search_block(base_ids, base, codes, scalars, query_ids, queries, turn, k: int):
    """Positions (query, base row, score) of each query's k best in this block; ties
    go to the smaller id. Identical vectors share code and score."""
    est, bound = estimate(codes, scalars, queries, turn)
    upper = est + bound[None, :]
    for i, qid in enumerate(query_ids):
        other = base_ids != qid
        if not other.any():
            continue
        e = np.where(other, est[i], -np.inf)
        first = np.argpartition(-e, min(k, len(e) - 1))[: k + 1]
        first = first[other[first]]
        exact = np.sort(cosines(base[first], np.broadcast_to(queries[i], (len(first), queries.shape[1]))))[::-1]
        floor = exact[k - 1] if len(exact) >= k else -np.inf
        cand = np.flatnonzero(other & (upper[i] >= floor - 1e-6))
        cand = np.union1d(cand, first)
        score = cosines(base[cand], np.broadcast_to(queries[i], (len(cand), queries.shape[1])))
        best = np.lexsort((base_ids[cand], -score))[:k]
        yield qid, cand[best], score[best]


def _valid(vec: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    return F.expr(f"{vec} IS NOT NULL AND size({vec}) > 0 AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vec}, x -> x <> 0)")


def _packed(size: int, seed: int, indexed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for whole in batches:
            lengths = pc.list_value_length(whole.column(1))
            for dim in pc.unique(lengths).to_pylist():
                batch = whole.filter(pc.equal(lengths, dim))
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    ids, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dim)
                    if indexed and dim not in turns:
                        turns[dim] = rotation(dim, seed)
                    block = (ids, x, *(encode(x, turns[dim]) if indexed else ()))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([pickle.dumps(block, 5)], pa.binary())], names=["dim", "first", "block"])

    return run


def _searched(seed: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, q in zip(batch.column(0), batch.column(1)):
                ids, x, codes, scalars = pickle.loads(b.as_buffer())
                if x.shape[1] not in turns:
                    turns[x.shape[1]] = rotation(x.shape[1], seed)
                turn = turns[x.shape[1]]
                rows = list(search_block(ids, x, codes, scalars, *pickle.loads(q.as_buffer()), turn, k))
                if rows:
                    n = [len(r[1]) for r in rows]
                    cols = [np.repeat([r[0] for r in rows], n), ids[np.concatenate([r[1] for r in rows])], np.concatenate([r[2] for r in rows])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine among all
    rows of `base` but those with its own id, ties to the smaller id.

    Every row is indexed and every query meets every block of the index, so
    recall falls short only where an error bound fails (a few in ten thousand
    candidates). Null, zero or non-finite vectors and rows with a null id take no
    part; vectors are compared with those of their own length. Repeated rows
    count each. With fewer than k candidates all are returned. An empty
    table gives an empty result.
    """
    spark = base.sparkSession
    some = base.filter(_valid(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    ask = queries.filter(_valid(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    groups = max(1, partitions(spark))
    left = some.mapInArrow(_packed(BASE_BLOCK, seed, True), "dim int, first long, block binary").select("dim", F.pmod(F.xxhash64("first"), F.lit(groups)).alias("g"), F.col("block").alias("b"))
    right = ask.mapInArrow(_packed(QUERY_BLOCK, seed, False), "dim int, first long, block binary").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.col("block").alias("q"))
    pairs = left.join(right.hint("shuffle_hash"), ["g", "dim"]).select("b", "q")
    found = pairs.mapInArrow(_searched(seed, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
