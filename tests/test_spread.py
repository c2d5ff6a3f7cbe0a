"""Tables of few row groups are spread over tasks."""

from pyspark.sql import functions as F

from labelloom.plans.scratch import widen


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "4096")
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        out = widen(df, "id")
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(counts) == 4000 and max(counts) < 2000
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_evenly_spread_table_stays(spark):
    df = spark.range(0, 4000, 1, 2 * spark.sparkContext.defaultParallelism)
    assert widen(df, "id") is df
