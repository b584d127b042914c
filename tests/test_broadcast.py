"""Tables that are small only as files don't go through the driver."""

from pyspark.sql import functions as F

from confluo.plans.scratch import Scratch


def test_a_table_that_repeats_itself_is_not_broadcast(spark):
    scratch = Scratch(spark)
    rows = scratch.table(spark.range(1_500_000).select("id", F.concat(F.lit("the same for all "), F.col("id") % 3).alias("text")))
    few = scratch.table(spark.range(100))
    plan = rows.join(rows.withColumnRenamed("text", "other"), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in rows.join(few, "id")._jdf.queryExecution().sparkPlan().toString()
