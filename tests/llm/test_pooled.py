"""Splits read by one task together."""

from tessera.llm.shared import pooled


def test_splits_are_read_together_and_none_is_lost(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(4000).repartition(40).write.parquet(path)
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (key, cost)}
    try:
        for k in before:
            spark.conf.set(k, "4k")
        rows = spark.read.parquet(path)
        most = spark.sparkContext.defaultParallelism
        assert rows.rdd.getNumPartitions() >= most and pooled(rows).rdd.getNumPartitions() <= most
        assert sorted(r.id for r in pooled(rows).collect()) == list(range(4000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
