"""Null streams come from many tasks, and their rows are never sent to the driver."""

from pyspark.sql import functions as F

from tideline.operators import simulate


def test_numbered_rows_are_spread_and_only_totals_are_broadcast(spark):
    params = spark.createDataFrame([("a", 50_000), ("b", 20_000)], "condition_id string, n long")
    rows = simulate.numbered(params, "n")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    told = simulate.running(rows.withColumn("v", F.lit(1).cast("long")), "v", "s")
    assert told.where("s <> i + 1").count() == 0 and told.count() == 70_000
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint" not in plan
