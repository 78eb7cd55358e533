"""Helpers on Spark that several operators share: written intermediates, row keys, connected components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """Folder for intermediates: the cluster's ``spark.checkpoint.dir``; only where that is unset, on one machine, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/llm-scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives later plans a measured size, so
    that Spark decides on a broadcast by what the table really holds.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing that reads it is still to run."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once: a lambda's variable is not computed again wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Bytes of an Arrow batch on its way to a Python task; Spark's own 64 MB would lie in the JVM and in the worker at once.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application.

    Where the session doesn't set the size of Arrow batches, it gets BATCH_BYTES.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_loanlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    sc._loanlens_shipped = True


#: Edges that one task contracts at once.
_EDGES = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> one star for each component of every run of _EDGES edges that the task reads."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u):]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column("u"), np.int64), np.asarray(batch.column("v"), np.int64)))
        n += batch.num_rows
        if n >= _EDGES:
            yield stars(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(x) for x in zip(*held)))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges (longs): (node, component = smallest node reachable).

    Tasks first contract the edges they hold, _EDGES each, whatever the number of partitions that
    the edges come in.  Where one task holds them all they are stars then; else large-star /
    small-star rounds go on until the edge set is one star for each component.  Only minima are aggregated (combined before
    the shuffle), never neighbour lists, and the minima are written before they are joined, so
    that AQE can split the edges of a hot node.  Every node of ``edges`` has one row; no edges
    give no rows.
    """
    own = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    own = materialize(own)
    tasks = -(-own.count() // _EDGES)
    edges = materialize(own.coalesce(max(1, tasks)).mapInArrow(_contract, "u long, v long"))
    discard(own)
    last = None
    while tasks > 1:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().mapInArrow(_contract, "u long, v long"))
        discard(edges, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        edges = materialize(joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        discard(large, least)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Bits:
    """A set of 64-bit hashes as bits of a table: never misses a member, and rarely takes another for one.

    16 bits for each member, 2**30 at most (128 MB), so its size is bounded whatever it stands
    for; it is built on the executors in blocks of 4 KB and sent to tasks as a broadcast.
    """

    BLOCK = 15

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @classmethod
    def build(cls, hashes: DataFrame, column: str) -> Bits:
        """``column``: longs with well mixed bits."""
        n = hashes.count()
        bits = min(30, max(cls.BLOCK, (16 * max(1, n)).bit_length()))
        bit = F.shiftrightunsigned(F.col(column), 64 - bits)

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(1 << cls.BLOCK, np.uint8)
            out[group["bit"].to_numpy() & ((1 << cls.BLOCK) - 1)] = 1
            return pd.DataFrame({"block": group["block"].iloc[:1], "bytes": [np.packbits(out).tobytes()]})

        blocks = hashes.select(bit.alias("bit"), F.shiftright(bit, cls.BLOCK).alias("block")).groupBy("block").applyInPandas(pack, "block long, bytes binary")
        table = np.zeros(1 << (bits - 3), np.uint8)
        for row in blocks.collect():  # 128 MB at most, in one job: an iterator would run one for each partition
            at = row.block << (cls.BLOCK - 3)
            table[at: at + (1 << (cls.BLOCK - 3))] = np.frombuffer(row.bytes, np.uint8)
        return cls(bits, table)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes.astype(np.uint64) >> np.uint64(64 - self.bits)
        return (self.table[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
