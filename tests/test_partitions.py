from pyspark.sql import functions as F

from vecframe.functions import text as X
from vecframe.partitions import spread


def test_small_scans_use_all_cores(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() == 1 and spread(df).rdd.getNumPartitions() == cores
    assert spread(df.filter("id > 3").select("id")).rdd.getNumPartitions() == cores
    for other in (df.repartition(2), df.groupBy("id").count(), df.join(F.broadcast(df), "id"), spark.range(100)):
        assert spread(other) is other


def test_texts_are_embedded_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string").coalesce(1).write.parquet(path)
    near = X.embed_column(spark.read.parquet(path), X.HashEmbedder(8)).filter("vector IS NOT NULL").withColumn("n", F.size("vector"))
    assert near._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.id, r.n) for r in near.collect()] == [(1, 8)]
