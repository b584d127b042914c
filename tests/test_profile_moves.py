"""Records move to their cluster whole, and not again when they are cut into fields."""

from pyspark.sql import functions as F

from confluo.operators import merge
from confluo.plans.scratch import Scratch


def _rows(spark):
    df = spark.createDataFrame([(s % 3, s, "CSV", f"t{s}", 80, f"Ann {s % 2}", f"a{s}@b.c", "+15", float(s)) for s in range(9)], "cluster_id long, seq long, source_type string, source_tag string, priority int, full_name string, email string, phone string, experience_yrs double")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("country", "date_of_birth")}).withColumn("skills", F.array(F.lit("SQL")))


def test_evidence_of_records_moves_once_for_each_use(spark):
    long = merge.evidence(_rows(spark))
    stats = merge.field_confidence(long, merge.survivors(long))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stats.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 2


def test_profiles_without_match_probability_are_the_same(spark):
    rows = _rows(spark).withColumns({"email_key": F.col("email"), "names": F.array("full_name")})
    full = merge.profiles(rows, Scratch(spark))
    less = merge.profiles(rows.drop("email_key", "names"), Scratch(spark), matched=False)
    assert full.columns == less.columns
    keep = [c for c in full.columns if c != "match_probability"]
    assert full.select(keep).orderBy("cluster_id").collect() == less.select(keep).orderBy("cluster_id").collect()
    assert {r.match_probability for r in less.collect()} == {None}
