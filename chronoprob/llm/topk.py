"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors become integers, floor(1024 x) of each component. Candidates are packed in chunks that hold one
row of numbers for each dimension (vertical layout). A task searches a chunk for a block of queries: it
adds up products one block of dimensions after another and, between blocks, keeps only the candidates
whose sum so far plus the most that the remaining dimensions can add (product of the remaining lengths,
Cauchy and Schwarz) reaches the k-th best certain score. Sums are 64-bit integers, so scores are exact;
bounds are widened by more than their rounding error, so no candidate is lost.

Candidates are dealt once, by a salt; blocks of queries of bounded size, few rows beside them, travel to
every salt by an equi-join. A task returns at most k rows for each of its queries, and the k best of all
chunks are chosen at the end.

Defined cases: vectors that are null or empty, or hold null or non-finite components, and rows without an
id take no part; shorter vectors count as 0 in the dimensions that they lack; components beyond 64 bits
count as the largest such number, and scores beyond 64 bits as the largest or smallest, in ties where
several are; equal scores go to the
smaller id; a query's own row is every row with its id; of rows that share a query's id the vector that
sorts first is the query, while as candidates for other queries repeated rows each count; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a chunk, queries in a block, dimensions added up at a time.
CHUNK = 8_192
QUERIES = 512
STEP = 8
SCALE = 1024
#: Products of lengths up to here cannot leave 64 bits.
SAFE = 2.0**62


def integer_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    doubles = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = doubles.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(whole)
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def _matrix(vectors: list) -> np.ndarray:
    """Dimensions by rows, padded with 0."""
    out = np.zeros((max(map(len, vectors)), len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def _pack(ids: list, vectors: list, tag: int) -> dict:
    m = _matrix(vectors)
    return {"ids": np.asarray(ids, dtype="<i8").tobytes(), "dims": m.shape[0], "m": m.astype("<i8").tobytes(), "tag": tag}


def _unpack(ids: bytes, dims: int, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, dtype="<i8")
    return found, np.frombuffer(m, dtype="<i8").reshape(dims, len(found))


def _rest(m: np.ndarray) -> np.ndarray:
    """Length of what is left of each column from each block of dimensions on."""
    mass = np.add.reduceat(m.astype(np.float64) ** 2, np.arange(0, m.shape[0], STEP), axis=0)
    return np.sqrt(np.vstack([np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))


def _saturated(q: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Exact products of very large vectors, in numbers of any size, then held within 64 bits."""
    sums = q.astype(object) @ chunk.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in sums], dtype=np.int64)


def search_chunk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, chunk: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best candidates of a chunk for each query."""
    dims = max(queries.shape[0], chunk.shape[0])
    queries = np.pad(queries, ((0, dims - queries.shape[0]), (0, 0)))
    chunk = np.pad(chunk, ((0, dims - chunk.shape[0]), (0, 0)))
    rest_q, rest_c = _rest(queries), _rest(chunk)
    longest = rest_c[0].max()
    for j, own in enumerate(query_ids.tolist()):
        q = queries[:, j]
        alive = np.flatnonzero(ids != own)
        if not len(alive):
            continue
        if rest_q[0, j] * longest >= SAFE:
            sums = _saturated(q, chunk[:, alive])
            order = np.lexsort((ids[alive], ~sums))[:k]  # not the negative, which the least number lacks
            yield own, ids[alive[order]], sums[order]
            continue
        sums = np.zeros(len(alive), dtype=np.int64)
        floor = -np.inf
        for b, at in enumerate(range(0, dims, STEP)):
            block = chunk[at : at + STEP] if len(alive) == chunk.shape[1] else chunk[at : at + STEP, alive]
            sums += q[at : at + STEP] @ block
            slack = rest_q[b + 1, j] * rest_c[b + 1, alive] * (1 + 1e-9) + 1
            if len(alive) > k:
                certain = sums - slack
                floor = max(floor, np.partition(certain, len(certain) - k)[len(certain) - k])
                stay = sums + slack >= floor
                if not stay.all():
                    alive, sums = alive[stay], sums[stay]
        order = np.lexsort((ids[alive], -sums))[:k]
        yield own, ids[alive[order]], sums[order]


def top_k(table: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` where ``is_query`` (a Column of vec_id)."""
    vectors = integer_vectors(table, key, vector)
    salts = max(1, table.sparkSession.sparkContext.defaultParallelism * 2)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        held: list = []
        tag = 0
        for pdf in batches:
            ids += pdf["vec_id"].tolist()
            held += pdf["v"].tolist()
            while len(ids) >= CHUNK:
                yield pd.DataFrame([_pack(ids[:CHUNK], held[:CHUNK], tag)])
                ids, held, tag = ids[CHUNK:], held[CHUNK:], tag + 1
        if ids:
            yield pd.DataFrame([_pack(ids, held, tag)])

    packed = "ids binary, dims int, m binary, tag int"
    wanted = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = wanted.count()
    blocks = max(1, -(-n_queries // QUERIES))
    # whole blocks of queries: dealt by a hash to as many groups, so that groups stay near the block size
    groups = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("v").alias("query_vectors"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("block")
    candidates = vectors.mapInPandas(chunks, packed).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    tasks = candidates.join(spread, "salt")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, m = _unpack(row.ids, row.dims, row.m)
                found = list(search_chunk(np.asarray(row.query_ids, dtype=np.int64), _matrix(list(row.query_vectors)), ids, m, k))
                if found:
                    yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    best = tasks.select("ids", "dims", "m", "query_ids", "query_vectors").mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every_hundredth(table: DataFrame) -> DataFrame:
    return top_k(table, F.col("vec_id") % 100 == 0)
