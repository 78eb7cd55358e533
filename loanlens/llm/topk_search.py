"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors.  Queries and rows are dealt into blocks; for each pair of
blocks one task goes through the terms (components) of its queries, and each term's postings
scatter weight * weight into a dense array of scores, one line for each row and one column for
each query.  A partition selection keeps each query's best of the block, and the blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.shared import materialize

#: Rows in a block of the index, and queries in a block: a score array of 8,192 x 512 numbers.
ROWS, QUERIES = 8192, 512
#: Rows whose scores are worked out together.
TILE = 256


def weights(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(key, terms, weights): the non-zero ones of floor(scale * x), one row for each key.

    Null keys and vectors that are null or hold null or non-finite components are left out; of
    repeated keys the smallest vector stays.
    """
    typed = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = typed.where(F.col("key").isNotNull() & F.col("v").isNotNull() & finite).groupBy("key").agg(F.min("v").alias("v"))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = np.floor(np.asarray(v.flatten(), np.float64) * scale)
            x = np.clip(x, -(2.0 ** 62), 2.0 ** 62).astype(np.int64)
            size = np.diff(np.asarray(v.offsets, np.int64))
            term = np.arange(len(x)) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
            full = x != 0
            at = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
            terms, values = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(y, t)) for y, t in ((term[full].astype(np.int32), pa.int32()), (x[full], pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("key"), terms, values], ["key", "terms", "weights"])

    return one.mapInArrow(integers, "key long, terms array<int>, weights array<long>")


def accumulate(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows (ties to the smaller key), or k + 1 of them: query_id, vec_id, score."""
    rows = rows.sort_values("key", ignore_index=True)
    keys, n, m = rows["key"].to_numpy(), len(rows), len(queries)
    if not n or not m:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    def postings(frame: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size = frame["terms"].str.len().to_numpy(np.int64)
        term = np.concatenate([np.asarray(x, np.int64) for x in frame["terms"]])
        weight = np.concatenate([np.asarray(x, np.int64) for x in frame["weights"]])
        owner = np.repeat(np.arange(len(frame)), size)
        order = np.argsort(term, kind="stable")
        term, owner, weight = term[order], owner[order], weight[order]
        cut = np.flatnonzero(np.diff(term)) + 1
        return {int(t[0]): (o, w) for t, o, w in zip(np.split(term, cut), np.split(owner, cut), np.split(weight, cut)) if len(t)}

    def spread(at: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[at] = weight
        return out

    of_rows, of_queries = postings(rows), postings(queries)
    # a list with most of the places is added as a whole line, zeros included: no scattered writes
    of_queries = {t: (slice(None), spread(q, w, m)) if 2 * len(q) > m else (q, w) for t, (q, w) in of_queries.items()}
    # the narrowest numbers that hold every sum; beyond 64 bits Python's own, clipped at the end
    bound = sum(int(np.abs(of_rows[t][1]).max()) * int(np.abs(w).max()) for t, (_, w) in of_queries.items() if t in of_rows)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    score = np.zeros((n, m), kind)
    for low in range(0, n, TILE):  # a tile of scores stays in the processor's cache while all terms add to it
        tile = score[low: low + TILE]
        for t, (q, qw) in of_queries.items():
            if t not in of_rows:
                continue
            r, rw = of_rows[t]
            a, z = np.searchsorted(r, (low, low + TILE))
            rows_at, rows_w = r[a:z] - low, rw[a:z]
            if 2 * len(rows_at) > len(tile):
                rows_at, rows_w = slice(None), spread(rows_at, rows_w, len(tile))
            part = np.multiply.outer(rows_w.astype(kind), qw.astype(kind))
            if isinstance(q, slice):
                tile[rows_at] += part
            else:
                tile[rows_at if isinstance(rows_at, slice) else rows_at[:, None], q] += part
    if kind is object:
        score = np.clip(score, -(2**63) + 1, 2**63 - 1).astype(np.int64)
    score = np.ascontiguousarray(score.T)
    asked, found, value = [], [], []
    for i, query in enumerate(queries["key"].to_numpy()):
        s = score[i]
        own = np.searchsorted(keys, query)
        has_own = own < n and keys[own] == query
        take = min(n, k + has_own)  # the query's own row may be among the best
        if n > take:
            least = np.partition(s, n - take)[n - take]
            above = np.flatnonzero(s > least)
            best = np.concatenate([above, np.flatnonzero(s == least)[: take - len(above)]])
        else:
            best = np.arange(n)
        best = best[keys[best] != query]
        asked.append(np.full(len(best), query))
        found.append(keys[best])
        value.append(s[best].astype(np.int64))
    return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found), "score": np.concatenate(value)})


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Queries are the rows whose key is divisible by ``every``, candidates all rows but the
    query's own; ties go to the smaller key.  See ``weights`` for rows that take no part.
    Vectors may differ in length (absent terms are 0); a zero vector scores 0; sums beyond 64
    bits are clipped to them; no rows give none.  Other columns are not read.
    """
    sparse = materialize(weights(vectors, key, vector, scale))
    asked = sparse.where(F.col("key") % every == 0)
    n, m = sparse.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-m // queries))
    block = lambda blocks: F.pmod(F.xxhash64("key"), F.lit(blocks))
    every_block = lambda blocks: F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    # both sides are narrow; a row goes to each block of queries and a query to each block of rows
    left = sparse.select("*", block(row_blocks).alias("rb"), F.explode(every_block(query_blocks)).alias("qb"))
    right = asked.select("*", block(query_blocks).alias("qb"), F.explode(every_block(row_blocks)).alias("rb"))
    best = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(lambda a, b: accumulate(a, b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
