from pyspark.sql import functions as F

from sparkloom.operators import staging


def test_scans_are_spread_whatever_their_folder(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for name in ("Sorted", "Join_of_Limits", "plain"):
        spark.range(100).withColumn("Window", F.col("id")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}").filter("Window >= 0").select("id")
        assert staging.spread(df).rdd.getNumPartitions() == cores
        grouped = df.groupBy("id").count()
        assert staging.spread(grouped) is grouped
    local = spark.range(5)
    assert staging.spread(local) is local
