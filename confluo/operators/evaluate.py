"""Run metrics, the review queue and calibration measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basic import pyround
from .merge import FIELDS, REVIEW_BELOW


def run_metrics(n_records: int, profiles: DataFrame, *, review_threshold: float = REVIEW_BELOW) -> DataFrame:
    """One row of counts and means over the profiles."""
    conflicts = sum((F.coalesce(F.col(f"meta_{f}.conflict"), F.lit(False)).cast("long") for f in FIELDS), F.lit(0).cast("long"))
    enough = F.col("overall_confidence") >= review_threshold
    sums = profiles.agg(F.count("*").alias("profiles_generated"), F.coalesce(F.sum(conflicts), F.lit(0)).alias("conflicts_found"), F.coalesce(F.avg("overall_confidence"), F.lit(0.0)).alias("mean"), F.count_if(enough).alias("high_confidence_profiles"), F.count_if(~enough).alias("manual_review_required"))
    records = F.lit(n_records).cast("long")
    merged = F.greatest(records - F.col("profiles_generated"), F.lit(0))
    rate = F.when(records > 0, pyround(F.try_divide(merged, records) * 100, 1)).otherwise(0.0)
    return sums.select(records.alias("records_processed"), "profiles_generated", merged.alias("records_merged"), rate.alias("duplicate_rate"), "conflicts_found", pyround(F.col("mean"), 2).alias("average_confidence"), "high_confidence_profiles", "manual_review_required")


def review_queue(profiles: DataFrame, *, review_threshold: float | None = None) -> DataFrame:
    """Profiles that need a look: those marked so, or those below another threshold."""
    return profiles.where("needs_review" if review_threshold is None else F.col("overall_confidence") < review_threshold)


def card_score(name_confidence: Column, email_confidence: Column) -> Column:
    """The mean of two confidences, each 0.70 where it is missing."""
    return (F.coalesce(name_confidence, F.lit(0.70)) + F.coalesce(email_confidence, F.lit(0.70))) / 2


def brier_score(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """The mean squared error; 1.0 without rows."""
    return df.agg(F.coalesce(F.avg(F.pow(F.col(predicted) - F.col(actual), 2)), F.lit(1.0)).alias("brier_score"))


def reliability_buckets(df: DataFrame, predicted: str, actual: str, n_buckets: int = 10) -> DataFrame:
    """Mean prediction and outcome per half-open bucket; empty buckets are zero and a prediction of 1 is in none."""
    spark: SparkSession = df.sparkSession
    p = F.col(predicted)
    bounds = F.array(*[F.lit(i / n_buckets) for i in range(n_buckets + 1)])
    bucket = F.size(F.filter(bounds, lambda b: b <= p)) - 1
    sums = df.where((p >= 0) & (p < 1)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(actual).cast("double")).alias("ma"))
    rows = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(sums, "bucket", "left")
    return rows.select("bucket", (F.col("bucket") / n_buckets).alias("lower"), ((F.col("bucket") + 1) / n_buckets).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(pyround(F.col("mp"), 3), F.lit(0.0)).alias("mean_predicted"), F.coalesce(pyround(F.col("ma"), 3), F.lit(0.0)).alias("mean_actual"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Four decimals each, 0 where undefined."""
    p = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return {"precision": pyround(p, 4), "recall": pyround(r, 4), "f1": pyround(f, 4)}
