"""Runs paired task by task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def task_means(rows: DataFrame) -> DataFrame:
    """task_id, m: mean success over the repeats that have a verdict; null if none has."""
    return rows.groupBy("task_id").agg(F.avg(F.col("success").cast("double")).alias("m"))


def paired(base: DataFrame, cand: DataFrame) -> DataFrame:
    """task_id, base, cand, d: all tasks of either side; d is null for tasks that cannot be compared."""
    b, c = task_means(base).withColumnRenamed("m", "base"), task_means(cand).withColumnRenamed("m", "cand")
    return b.join(c, "task_id", "full_outer").withColumn("d", F.col("cand") - F.col("base"))


def deltas(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("d").isNotNull()).select("task_id", "d")


def dropped(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("d").isNull()).select("task_id")


def tag_deltas(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, task_id, d: every comparable task under each of its tags (task_id, tags)."""
    return deltas(pairs).join(tags, "task_id").select(F.explode("tags").alias("tag"), "task_id", "d")


def worst(pairs: DataFrame, n: int = 5, failures: DataFrame | None = None) -> DataFrame:
    """The n smallest differences by (d, task_id), then those below zero; with the first trace that did not succeed, if failures (task_id, repeat, success, trace_id) are given."""
    low = pairs.filter(F.col("d").isNotNull()).orderBy("d", "task_id").limit(n).filter(F.col("d") < 0)
    if failures is None:
        return low
    bad = failures.filter(~F.col("success").eqNullSafe(F.lit(True)) & (F.col("trace_id") != ""))
    return low.join(bad.groupBy("task_id").agg(F.min_by("trace_id", "repeat").alias("trace_id")), "task_id", "left")


def judge_error_fraction(rows: DataFrame, error: str = "judge_error") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.col(error).cast("double")), F.lit(0.0)).alias("fraction"))


def running_cost(rows: DataFrame, by: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """rows with `spent` before each call of its run, and `refused` once that has reached the cap."""
    before = F.coalesce(F.sum(cost).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("spent", before).withColumn("refused", F.col("spent") >= cap)
