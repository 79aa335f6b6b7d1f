"""Use of all cores where a small input comes in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores, if it is a plain scan of fewer.

    A file of one row group is one task, however many cores wait. Larger inputs have more
    pieces than cores and stay as they are, and so does whatever has been shuffled already.
    Asking for the number of a scan's partitions runs no job.
    """
    run = df._jdf.queryExecution()
    plan = run.executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df
