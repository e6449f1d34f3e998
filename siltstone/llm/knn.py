"""Exact top-k search by inner product: a Voronoi join of queries with data.

Vectors are integers, floor(scale * x). Pivots, a hashed sample of the data that grows
with it, split all vectors into cells by the nearest pivot. A cell's summary is its
pivot p, its radius r and its number of rows. For a query q and any vector x of the cell:
q.x <= q.p + r|q|. So

1. each query meets one chunk of the cell whose pivot scores best with it; the k-th best
   score found there is the query's threshold;
2. a query is copied to just those cells whose bound reaches its threshold, and so meets
   only the data that may matter;
3. a block of queries meets a chunk of a cell's vectors (so that a dense cell is many
   tasks); what reaches a query's threshold is returned, k rows a chunk at most, and the
   best k of all chunks remain.

Vectors that are null or empty, hold null or non-finite components or components whose
integer does not fit a long take no part, nor do null ids; shorter vectors count as
padded with zeros, whatever their length. Rows with a query's id are its own, however
many; a query that repeats is answered once. Ties go to the smaller id. Extra columns
are ignored; no vectors give no rows. Scores are exact while they fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 64
K = 20
#: Pivots at least and at most (which bounds what is sent to tasks), and rows per pivot between.
LEAST_PIVOTS, MOST_PIVOTS = 4, 16_384
ROWS_PER_PIVOT = 4096
QUERY_BLOCK = 2048
DATA_CHUNK = 8192


def _valid(scale: int):
    def run(batches):
        for batch in batches:
            ids, vectors = [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is not None and x and None not in x:
                    v = np.array(x, np.float64)
                    if np.isfinite(v).all() and (np.abs(v) * scale < 2.0**62).all():
                        ids.append(i)
                        vectors.append(np.floor(scale * v).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "v"])

    return run


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors, strict=True):
        x = np.frombuffer(v, "<i8")
        row[: len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles if no sum can reach 2^53, else in longs."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, p = x.astype(np.float64), pivots.astype(np.float64)
    d = (f * f).sum(1)[:, None] - 2 * f @ p.T + (p * p).sum(1)
    cell = d.argmin(1)
    return cell, np.sqrt(((f - p[cell]) ** 2).sum(1))


def _cells(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            cell, far = _nearest(_matrix(batch.column("v").to_pylist(), pivots.shape[1]), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "v", "cell", "far"])

    return run


def _home(pivots: np.ndarray, chunks: np.ndarray):
    """Each query with the cell whose pivot scores best, and one chunk of it."""

    def run(batches):
        full = np.flatnonzero(chunks)
        for batch in batches:
            q = _matrix(batch.column("v").to_pylist(), pivots.shape[1]).astype(np.float64)
            cell = full[(q @ pivots[full].T.astype(np.float64)).argmax(1)]
            chunk = batch.column("vec_id").to_numpy().astype(np.uint64) % chunks[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.nulls(len(cell), pa.int64())], ["vec_id", "v", "cell", "chunk", "least"])

    return run


def _admitted(pivots: np.ndarray, radius: np.ndarray, chunks: np.ndarray):
    """Each query once for every chunk of every cell whose bound reaches its threshold."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                q = _matrix(part.column("v").to_pylist(), pivots.shape[1]).astype(np.float64)
                mid, slack = q @ pivots.T.astype(np.float64), np.sqrt((q * q).sum(1))[:, None] * radius
                # a little wider than rounding
                high = mid + slack * (1 + 1e-9) + 1e-9 * np.abs(mid) + 1e-6
                least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                row, cell = np.nonzero((np.isnan(least)[:, None] | (high >= least[:, None])) & (chunks > 0))
                times = chunks[cell]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(np.repeat(row, times))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(take), part.column("v").take(take), pa.array(np.repeat(cell, times).astype(np.int32)), pa.array(chunk.astype(np.int32)), part.column("least").take(take)], ["vec_id", "v", "cell", "chunk", "least"])

    return run


def _local(dim: int, k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            ids = data["vec_id"].to_numpy(np.int64)
            x, asked = _matrix(data["v"], dim), queries["vec_id"].to_numpy(np.int64)
            least = queries["least"].tolist()
            for i in range(0, len(asked), 256):
                scores = _products(_matrix(queries["v"].iloc[i : i + 256], dim), x)
                for q, bound, s in zip(asked[i : i + 256], least[i : i + 256], scores, strict=True):
                    able = ids != q
                    if bound is not None and bound == bound:
                        able &= s >= int(bound)
                    other = np.flatnonzero(able)
                    t = s[other]
                    if len(t) > k:
                        other = other[t >= np.partition(t, len(t) - k)[len(t) - k]]
                    best = other[np.lexsort((ids[other], -s[other]))[:k]]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return solve


def _meet(queries: DataFrame, placed: DataFrame, chunks: np.ndarray, dim: int, k: int) -> DataFrame:
    """queries(vec_id, v, cell, chunk, least) against the rows of their chunks -> query_id, vec_id, score."""
    # a chunk is copied once for each block of queries that it meets
    blocks = queries.groupBy("cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
    blocks = materialise(blocks)
    of = F.element_at(F.lit([max(1, int(c)) for c in chunks]), F.col("cell") + 1)
    right = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), of).cast("int")).join(blocks, ["cell", "chunk"])
    right = right.select("cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    left = queries.join(blocks, ["cell", "chunk"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    # the threshold as a decimal keeps its exact value beside nulls in pandas
    left = left.withColumn("least", F.col("least").cast("decimal(20,0)"))
    key = ["cell", "chunk", "block"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(_local(dim, k), "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, queries, k: int = K, scale: int = SCALE) -> DataFrame:
    """embeddings(vec_id, embedding); ``queries`` a condition on vec_id -> query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    data = materialise(raw.mapInArrow(_valid(scale), "vec_id long, v binary"))
    asked = materialise(data.where(queries).dropDuplicates(["vec_id"]))
    n, dim = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("v")), F.lit(0))).first()
    dim //= 8
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // ROWS_PER_PIVOT))
    first = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).toArrow()
    pivots = _matrix(first["v"].to_pylist(), dim)
    placed = materialise(data.mapInArrow(_cells(pivots), "vec_id long, v binary, cell int, far double"))
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["far"], r["n"]
    chunks = -(-size // DATA_CHUNK)
    rows = "vec_id long, v binary, cell int, chunk int, least long"

    near = _meet(asked.mapInArrow(_home(pivots, chunks), rows), placed.drop("far"), chunks, dim, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = near.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    known = materialise(asked.join(materialise(least), "vec_id", "left"))
    wide = known.mapInArrow(_admitted(pivots, radius, chunks), rows)
    found = _meet(wide, placed.drop("far"), chunks, dim, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
