"""The bit table and the session setting that operators share."""

from pyspark.sql import functions as F

from loanlens.llm import shared

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batch_bytes_only_where_unset(spark):
    before = spark.conf.get(BYTES, None)
    try:
        spark.conf.unset(BYTES)
        shared.ship(spark)
        assert spark.conf.get(BYTES) == str(shared.BATCH_BYTES)
        spark.conf.set(BYTES, "1048576")
        shared.ship(spark)
        assert spark.conf.get(BYTES) == "1048576"
    finally:
        spark.conf.unset(BYTES) if before is None else spark.conf.set(BYTES, before)


def test_bits_hold_every_member(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = shared.Bits.build(hashes, "h")
    assert bits.test(hashes.toPandas()["h"].to_numpy()).all()
    others = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    assert bits.test(others).mean() < 0.1
    assert not shared.Bits.build(hashes.limit(0), "h").test(others).any()
