"""Approximate search for the largest inner product: anisotropic quantisation, four-bit scans, exact reranking.

A vector is quantised in subspaces of two components with sixteen centres each. What is penalised is not the
plain residual: its part parallel to the vector, which alone moves inner products with near queries, weighs `eta`
times the rest, in the codebooks' fit and in the choice of codes. Codes are packed two to a byte. Blocks of
queries are scanned against blocks of codes with look-up tables; the best of each block are scored again exactly, in
double precision, where their vectors are, and the blocks' best are merged.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, uniform63
from .hamming import runs

CENTRES = 16
FIT_ROWS = 10_000  # vectors on which the codebooks are fitted, about; every vector is indexed
BLOCK = 16_384  # vectors of a block
QUERIES = 256  # queries of a block
GROUP = 16_384  # queries that one task meets a block of vectors with, about
MOST_LENGTHS = 64  # of vectors in one table
MOST_TASKS = 20_000


def eta_of(threshold: float, dim: int) -> float:
    """Weight of the parallel residual if pairs with a cosine of at least `threshold` matter."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _padded(x: np.ndarray) -> np.ndarray:
    """(n, subspaces, 2), an even number of subspaces; missing components are 0."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x.reshape(len(x), -1), axis=1)[:, None, None]


def assign(x: np.ndarray, centres: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (n, subspaces): nearest centres, then one subspace after another the centre that lowers the loss most,
    given the parallel residual of the others."""
    u = _unit(x)
    plain = ((x[:, :, None, :] - centres[None]) ** 2).sum(3)
    along = np.einsum("nsd,nscd->nsc", u, x[:, :, None, :] - centres[None])
    codes = plain.argmin(2)
    took = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = took.sum(1)
    for _ in range(rounds):
        for s in range(x.shape[1]):
            others = total - took[:, s]
            codes[:, s] = (plain[:, s] + (eta - 1) * (others[:, None] + along[:, s]) ** 2).argmin(1)
            took[:, s] = along[np.arange(len(x)), s, codes[:, s]]
            total = others + took[:, s]
    return codes


def fit(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres (subspaces, 16, 2) for the padded vectors x: codes and least-squares centres by turns."""
    r = np.random.default_rng(seed)
    centres = np.stack([x[r.integers(0, len(x), CENTRES), s] for s in range(x.shape[1])])
    u, n = _unit(x), len(x)
    for _ in range(rounds):
        codes = assign(x, centres, eta, 1)
        residual = x - np.take_along_axis(centres[None], codes[:, :, None, None].repeat(2, 3), 2)[:, :, 0]
        along = (u * residual).sum(2)
        for s in range(x.shape[1]):
            others = along.sum(1) - along[:, s]
            pull = others + (u[:, s] * x[:, s]).sum(1)
            for c in range(CENTRES):
                of = codes[:, s] == c
                if not of.any():
                    centres[s, c] = x[r.integers(0, n), s]
                    continue
                us = u[of, s]
                left = of.sum() * np.eye(2) + (eta - 1) * us.T @ us
                centres[s, c] = np.linalg.solve(left, x[of, s].sum(0) + (eta - 1) * us.T @ pull[of])
            along[:, s] = (u[:, s] * (x[:, s] - centres[s, codes[:, s]])).sum(1)
    return centres


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each query and byte of a code (n, bytes, 256): the inner product of what the byte stands for."""
    one = np.einsum("nsd,scd->nsc", _padded(queries), centres).astype(np.float32)
    return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256)


def scan(look: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, vectors)."""
    out = np.zeros((len(look), len(packed)), np.float32)
    for b in range(packed.shape[1]):
        out += look[:, b][:, packed[:, b]]
    return out


def valid(embedding: Column) -> Column:
    """True for vectors without null or non-finite components and with one that isn't zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def _index(shared):
    """Blocks (shard, ids, codes, vectors) of rows (shard, vec_id, embedding) sorted by shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, eta = shared.value

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids = rows["vec_id"].to_numpy()
            x = rows["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
            codes = np.concatenate([pack(assign(_padded(x[k : k + 2048]), centres, eta)) for k in range(0, len(x), 2048)])
            return pa.record_batch([pa.array([rows["shard"][0].as_py()], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids, codes, x)]], names=["shard", "ids", "codes", "vectors"])

        for rows, starts, _, _ in runs(batches, lambda t: [t["shard"].to_numpy()], BLOCK):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                yield block(rows.slice(s, e - s))

    return work


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (part, query_ids, queries) of rows (part, vec_id, embedding) sorted by part."""
    for rows, starts, _, _ in runs(batches, lambda t: [t["part"].to_numpy()], QUERIES):
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            for k in range(s, e, QUERIES):
                some = rows.slice(k, min(QUERIES, e - k)).combine_chunks()
                x = some["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.record_batch([pa.array([some["part"][0].as_py()], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (some["vec_id"].to_numpy(), x)]], names=["part", "query_ids", "queries"])


def best_of_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, packed: np.ndarray, vectors: np.ndarray, centres: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best of a block for each query, among the `rerank` that scan() puts first."""
    rerank = min(rerank, len(ids))
    near = scan(tables(q.astype(np.float32), centres), packed)
    near = np.argpartition(-near, rerank - 1, axis=1)[:, :rerank] if rerank < len(ids) else np.broadcast_to(np.arange(len(ids)), near.shape)
    score = np.einsum("qrd,qd->qr", vectors[near], q)
    found = ids[near]
    score[found == query_ids[:, None]] = -np.inf
    order = np.lexsort((found, -score), axis=1)[:, :k]
    score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
    some = score > -np.inf
    return np.repeat(query_ids, order.shape[1])[some.ravel()], found[some], score[some]


def _search(shared, dim: int, k: int, rerank: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value[0]
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                qi, q, ids, codes, vectors = (x.as_py() for x in row)
                ids = np.frombuffer(ids, np.int64)
                found = best_of_block(np.frombuffer(qi, np.int64), np.frombuffer(q).reshape(-1, dim), ids, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(vectors).reshape(len(ids), dim), centres, k, rerank)
                yield pa.record_batch(list(found), names=["query_id", "vec_id", "score"])

    return work


def nearest(vectors: DataFrame, queries: Column, k: int = 20, rerank: int = 200, threshold: float = 0.2, block: int = BLOCK, fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each row of vectors (vec_id long, embedding) for which
    `queries` holds: largest inner product first, ties to the smaller vec_id, never the row's own vec_id.

    Null, zero or non-finite vectors and rows without vec_id take no part. Vectors of each length are searched among
    themselves; more than MOST_LENGTHS lengths in a table are an error. Of rows with one vec_id the least vector counts. Of
    equal vectors only the k + 1 smallest ids can be among a query's k nearest, so no more are kept: a vector that
    fills a third of the table costs no more than any other. With fewer candidates all are returned. An empty table
    gives none. Codebooks are fitted on the driver on about fit_rows vectors of each length, those with the smallest
    hashes; every vector is indexed. Blocks of about `block` vectors meet groups of about GROUP queries, each in a task.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asked")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("embedding", "asked")).alias("x")).select("vec_id", "x.embedding", "x.asked"))
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).orderBy("dim").limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors have more than {MOST_LENGTHS} lengths")
    found = [_nearest(rows.where(F.size("embedding") == r["dim"]), r["dim"], r["n"], r["asked"], k, rerank, threshold, block, fit_rows, seed) for r in lengths if r["asked"] and r["n"] > 1]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, dim: int, n: int, n_queries: int, k: int, rerank: int, threshold: float, block: int, fit_rows: int, seed: int) -> DataFrame:
    """nearest() for rows (vec_id, embedding, asked) of one length."""
    spark = rows.sparkSession
    sample = rows.where(uniform63(F.lit("fit"), F.col("vec_id").cast("string")) < int((1 << 60) * min(1, fit_rows / n))).select("vec_id", "embedding").orderBy("vec_id").collect()
    x = _padded(np.array([r["embedding"] for r in sample or rows.limit(100).collect()], np.float64))
    eta = eta_of(threshold, dim)
    shared = spark.sparkContext.broadcast((fit(x, eta, seed=seed), eta))

    shards, parts = max(16, -(-n // block)), -(-n_queries // GROUP)
    tasks = min(MOST_TASKS, shards * parts)
    numbered = lambda name, of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int").alias(name)
    spread = lambda df, name, of: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(of - 1))))
    copies = Window.partitionBy(F.xxhash64("embedding"), F.hash("embedding")).orderBy("vec_id")
    base = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    base = base.select(numbered("shard", shards), "vec_id", "embedding").repartition(min(MOST_TASKS, shards), "shard").sortWithinPartitions("shard")
    index = spread(base.mapInArrow(_index(shared), "shard int, ids binary, codes binary, vectors binary"), "part", parts)
    asked = rows.where("asked").select(numbered("part", parts), "vec_id", "embedding").repartition(min(MOST_TASKS, parts), "part").sortWithinPartitions("part")
    asked = spread(asked.mapInArrow(_query_blocks, "part int, query_ids binary, queries binary"), "shard", shards)
    met = asked.repartition(tasks, "shard", "part").join(index.repartition(tasks, "shard", "part"), ["shard", "part"]).select("query_ids", "queries", "ids", "codes", "vectors")
    found = met.mapInArrow(_search(shared, dim, k, rerank), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
