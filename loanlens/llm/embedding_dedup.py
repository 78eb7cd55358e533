"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A unit vector o is rotated at random and kept as the signs of its coordinates, a code c on the
unit sphere, with the factor <c, o>.  For another unit vector q, <c, q> / <c, o> is an unbiased
estimate of <o, q>, and its error is bounded with a known confidence; only pairs whose upper
bound reaches the threshold are computed exactly.  The pairs looked at share a short run of
sign bits in one of several tables; a label's bits and tables follow from its own number of
vectors and the wanted recall, and in a label that fits one bucket every pair is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.shared import components, materialize
from loanlens.llm.text import binaries

#: Cosine from which two vectors are linked; share of such pairs that the tables find at least.
THRESHOLD, RECALL = 0.93, 0.99
#: Vectors of a label that share a table's bits, about; larger buckets are split into blocks of so many.
BUCKET, BLOCK = 1024, 1024
#: Half width of the confidence bound in standard deviations.
DEVIATIONS = 4.0
#: Vectors are padded with zeros to so many coordinates, so that a code is long enough.
LEAST_BITS = 64


@lru_cache(maxsize=64)
def rotation(size: int, number: int) -> np.ndarray:
    """The ``number``-th random orthogonal matrix of a size."""
    q, r = np.linalg.qr(np.random.default_rng([size, number]).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def tables(largest: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits, tables): so many sign bits that a bucket holds about ``bucket`` of ``largest`` vectors, and so many tables that a pair at the threshold meets with probability ``recall``."""
    bits = max(0, math.ceil(math.log2(max(largest, 1) / bucket)))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if together == 1 else math.ceil(math.log(1 - recall) / math.log(1 - together))


def encode(vectors: DataFrame, threshold: float, recall: float, bucket: int) -> DataFrame:
    """(label, rep, n, size, vector, code, factor, bands) of distinct vectors (label, v, rep, n, of_label): the index that is stored.

    ``of_label`` is the number of the label's vectors; bands are 8 bytes for each of its tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, at = np.asarray(v.flatten(), np.float64), np.asarray(v.offsets, np.int64) - v.offsets[0].as_py()
            sizes = np.diff(at)
            among, of = np.unique(batch.column("of_label").to_numpy(), return_inverse=True)
            kinds = np.array([tables(m, threshold, recall, bucket) for m in among.tolist()], np.int64).reshape(-1, 2)[of]
            for size, bits, n_tables in np.unique(np.column_stack([sizes, kinds]), axis=0).tolist():
                own = np.flatnonzero((sizes == size) & (kinds[:, 0] == bits))
                raw = flat[at[own][:, None] + np.arange(size)]
                x = np.zeros((len(own), max(size, LEAST_BITS)))
                x[:, :size] = unit(raw)
                need = max(1, -(-bits * n_tables // x.shape[1]))
                signs = np.concatenate([x @ rotation(x.shape[1], k) >= 0 for k in range(need)], 1)
                turned = x @ rotation(x.shape[1], 0)
                factor = np.abs(turned).sum(1) / math.sqrt(x.shape[1])
                code = np.packbits(signs[:, : x.shape[1]], axis=1)
                weight = 1 << np.arange(bits, dtype=np.int64)
                bands = (signs[:, : bits * n_tables].reshape(len(own), n_tables, bits) * weight).sum(2) if bits else np.zeros((len(own), n_tables), np.int64)
                put = lambda a: binaries(np.ascontiguousarray(a).view(np.uint8).ravel(), np.arange(len(own) + 1) * (a.nbytes // len(own)))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(take), batch.column("rep").take(take), batch.column("n").take(take), pa.array(np.full(len(own), size), pa.int32()), put(raw), put(code), pa.array(factor), put(bands.astype(np.int64))],
                    ["label", "rep", "n", "size", "vector", "code", "factor", "bands"])

    return vectors.mapInArrow(run, f"label {dict(vectors.dtypes)['label']}, rep long, n long, size int, vector binary, code binary, factor double, bands binary")


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither very large nor very small numbers overflow."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def link(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one block, or between the two blocks of a pair: (rep, links, root) of each vector that has any.

    A pair that meets in several tables counts in the first one only.  ``root`` is the smallest
    vector that the links found here reach, so no pairs leave the task.
    """
    group = group.sort_values("rep", ignore_index=True)
    rep, copies, table = group["rep"].to_numpy(), group["n"].to_numpy(), int(group["t"].iloc[0])
    raw = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(len(group), -1)
    bands = np.frombuffer(b"".join(group["bands"]), np.int64).reshape(len(group), -1)
    x = unit(raw)
    size = max(raw.shape[1], LEAST_BITS)
    padded = np.zeros((len(x), size))
    padded[:, : raw.shape[1]] = x
    turned = (padded @ rotation(size, 0)).astype(np.float32)
    code = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)
    code = (np.unpackbits(code, axis=1)[:, :size].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
    factor = group["factor"].to_numpy()
    # at the threshold, the part of q across o has length sqrt(1 - threshold^2); the code's error is its product with a random direction
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(1 - threshold**2) * min(1.0, DEVIATIONS / math.sqrt(size - 1))
    least = (threshold - spread - 1e-5).astype(np.float32)
    side = group["block"].to_numpy()
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    links, root = np.zeros(len(group), np.int64), np.arange(len(group))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 256):
        a = left[at: at + 256]
        estimate = (code[a] @ turned[right].T) / factor[a, None].astype(np.float32)
        one, two = np.nonzero(estimate >= least[a, None])
        for k in range(0, len(one), 1 << 16):
            p, q = a[one[k: k + (1 << 16)]], right[two[k: k + (1 << 16)]]
            if i == j:
                p, q = p[p < q], q[p < q]
            close = np.einsum("nd,nd->n", x[p], x[q]) >= threshold
            p, q = p[close], q[close]
            first = ~np.any(bands[p, :table] == bands[q, :table], axis=1)
            p, q = p[first], q[first]
            links += np.bincount(p, copies[q], len(group)).astype(np.int64) + np.bincount(q, copies[p], len(group)).astype(np.int64)
            found.append((p, q))
    p, q = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    while len(p):
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, root[p], low)
        np.minimum.at(root, root[q], low)
        root = root[root]
        if (root == before).all():
            break
    has = links > 0
    return pd.DataFrame({"rep": rep[has], "links": links[has], "root": rep[root[has]]})


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Each row's key, n_links, component_id and kept (key = component_id).

    Rows are compared when labels are equal and not null, by cosine.  Equal vectors of a label
    are one vector with a count.  A vector that is null, empty or zero, or holds null or
    non-finite components, or has no key or label, links with nothing (as do vectors of
    different lengths with each other).  Repeated rows are vectors of their own that link with
    each other.  A bucket larger than ``block`` is dealt into blocks, and pairs of blocks are
    tasks of their own.  Other columns are not read.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite
    distinct = materialize(rows.where(good).groupBy("label", "v").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    # labels that fit a bucket need no bits, so few rows are joined
    many = materialize(distinct.groupBy("label").agg(F.count("*").alias("of_label")).where(F.col("of_label") > bucket))
    counted = distinct.join(many, "label", "left").withColumn("of_label", F.coalesce("of_label", F.lit(0)))
    index = materialize(encode(counted, threshold, recall, bucket))
    in_table = index.select("*", F.explode(F.sequence(F.lit(0), (F.length("bands") / 8 - 1).cast("int"))).alias("t")).withColumn("h", F.expr("substring(bands, 8 * t + 1, 8)"))
    place = ["label", "size", "t", "h"]
    large = materialize(in_table.groupBy(*place).count().where(F.col("count") > block))
    dealt = in_table.join(large, place, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "count", "blocks")
    found = materialize(pairs.groupBy(*place, "i", "j").applyInPandas(lambda g: link(g, threshold), "rep long, links long, root long"))
    own = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root").withColumnRenamed("node", "rep")
    reps = distinct.join(own, "rep", "left").join(parts, "rep", "left")
    known = materialize(reps.select("label", "v", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    out = rows.where(good).join(known, ["label", "v"]).select("key", "links", "component")
    rest = rows.where(~F.coalesce(good, F.lit(False))).select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    return out.unionByName(rest).select(F.col("key").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.w) = len(b.w) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.w, b.w) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(c.b, e.vec_id), e.vec_id) AS component_id,
  coalesce(coalesce(least(c.b, e.vec_id), e.vec_id) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
