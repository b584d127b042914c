"""How often the evidence of profiles moves, and that what is counted on the way is right."""

from pyspark.sql import functions as F

from confluo.functions.basic import pyround
from confluo.operators import merge


def _long(spark):
    names = ["Ann Lee", "ann lee ", "ANN LEE", "Bo Chan", "Cy Dee", "Di Eno"]
    rows = [(c, "full_name", names[(c * s) % 6], None, "CSV", f"t{s}", 80, s) for c in range(4) for s in range(5)]
    return spark.createDataFrame(rows, "cluster_id long, field string, value string, num double, source_type string, source_tag string, priority int, seq long"), rows


def test_evidence_moves_three_times(spark):
    long, rows = _long(spark)
    stats = merge.field_confidence(long, merge.survivors(long))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stats.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 3


def test_variants_and_penalties(spark):
    long, rows = _long(spark)
    for r in merge.survivors(long).collect():
        values = {v for c, _, v, *_ in rows if c == r.cluster_id}
        assert sorted(r.variants) == sorted(values)[:3]
        assert r.distinct_values == len({v.lower().strip() for v in values})


def test_rounding_beside_ties(spark):
    values = [s * (k + 0.5 + e) / 100 for k in (0, 1, 2, 83, 999_999, 12_345_678) for e in (0, 1e-3, 1e-6, -1e-6, 1e-9, -1e-9, 1e-14, -1e-14) for s in (1, -1)] + [-0.001, 999_999.995]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", pyround(F.col("v"), 2)).orderBy("i").collect()
    assert [r[1] for r in rows] == [round(v, 2) for v in values]
