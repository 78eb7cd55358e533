from loanlens.session import CLUSTER, shuffle_partitions_for, tune


def test_tune_sets_only_unset_keys(spark):
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    kept = "spark.sql.shuffle.partitions"  # explicitly set by the test session
    before = spark.conf.get(kept)
    spark.conf.unset(key)
    try:
        tune(spark, {kept: "999"})
        assert spark.conf.get(key) == CLUSTER[key]
        assert spark.conf.get(kept) == before
    finally:
        spark.conf.unset(key)


def test_shuffle_partitions_sizing(spark):
    assert shuffle_partitions_for(2 << 40, cores=4000) == 16384
    assert shuffle_partitions_for(1 << 20, cores=8) == 8
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(key)
    try:
        tune(spark, shuffle_bytes=100 * (128 << 20))
        assert int(spark.conf.get(key)) == max(100, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.unset(key)
