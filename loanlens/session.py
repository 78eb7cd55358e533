"""Session settings the plans are designed for.

On a cluster the caller owns the ``SparkSession``; :func:`tune` only sets
what is unset.  :func:`local_session` builds the single-JVM session used by the
tests and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins (broadcast when a side is measured small),
# coalesces small shuffle partitions and splits skewed join partitions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


# On a cluster: let AQE size coalesced partitions by bytes (not by maximum
# parallelism), and split a skewed join partition once it is 5x the median.
CLUSTER = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
}


def shuffle_partitions_for(shuffle_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Initial shuffle partition count giving each reducer about ``target_bytes``
    (AQE then coalesces small ones), never fewer than the cluster's cores.

    Example: the roll-ups of a 100 TB input shuffle roughly one partial row per
    applicant and mapper; for ~2 TB of shuffle data on 4,000 cores this gives
    16,384 partitions of ~128 MB, which fit an executor's memory without spilling."""
    wanted = -(-int(shuffle_bytes) // int(target_bytes))
    return max(int(cores), wanted)


def tune(spark: SparkSession, overrides: dict[str, str] | None = None,
         shuffle_bytes: int | None = None) -> SparkSession:
    """Apply ``RECOMMENDED`` and ``CLUSTER`` (and ``overrides``) for keys the
    session leaves unset; settings the cluster already chose are kept.  With
    ``shuffle_bytes`` (the expected size of the largest shuffle), the initial
    shuffle partition count is sized by :func:`shuffle_partitions_for`."""
    sizing = {}
    if shuffle_bytes:
        n = shuffle_partitions_for(shuffle_bytes, spark.sparkContext.defaultParallelism)
        sizing = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n)}
    for k, v in {**RECOMMENDED, **CLUSTER, **sizing, **(overrides or {})}.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "loanlens",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**RECOMMENDED, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
