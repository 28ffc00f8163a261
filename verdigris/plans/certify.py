"""Certifying a judge: its verdicts against people, and whether length sways it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import judging
from verdigris.operators import statistics as st
from verdigris.plans import gate

Ask = Callable[[str], tuple[str, float]]


def judged_variants(examples: DataFrame, compressed: DataFrame, prompt: Callable[[DataFrame], DataFrame], ask: Ask) -> DataFrame:
    """example_id, x, judge_pass: the original (x = 0), two padded answers and, where given (example_id, compressed) and true to the facts, a shorter one."""
    short = judging.kept_compressions(examples.join(compressed, "example_id"))
    forms = examples.select("example_id", F.lit("original").alias("form"), F.col("answer").alias("text"), F.lit(0.0).alias("x"))
    forms = forms.unionByName(judging.perturbations(examples).select("example_id", F.col("fraction").cast("string").alias("form"), "text", "x"))
    forms = forms.unionByName(short.select("example_id", F.lit("short").alias("form"), F.col("compressed").alias("text"), text.length_x(F.col("compressed"), F.col("answer")).alias("x")))
    asked = prompt(forms.join(examples.drop("answer"), "example_id").withColumnRenamed("text", "answer").withColumn("form", F.concat_ws("/", "example_id", "form")))
    said = judging.ask_judge(asked.select("form", "prompt"), ["form"], "prompt", ask)
    return asked.select("form", "example_id", "x").join(said, "form").select("example_id", "x", F.when(~F.col("error"), F.col("correct") & F.col("faithful")).alias("judge_pass"))


def certify(examples: DataFrame, labels: DataFrame, judged: DataFrame, cert_inputs: dict, created_at: str, resamples: int = 10_000, seed: int = 20260930) -> dict:
    """A certificate from labelled examples and the judge's verdicts on them and their variants (example_id, x, judge_pass).

    Raises without any pair of label and verdict.
    """
    original = judged.filter("x = 0")
    pairs = labels.join(original.filter("judge_pass is not null"), "example_id").select("example_id", F.col("judge_pass").alias("pred"), (F.col("human_label") == "pass").alias("truth"))
    n = pairs.count()
    if not n:
        raise ValueError("no label has a verdict")
    report = {r["metric"]: {k: r[k] for k in ("point", "lo", "hi")} for r in st.agreement_report(pairs, resamples, seed, "example_id").collect()}
    used = judged.filter("judge_pass is not null").withColumn("y", F.col("judge_pass").cast("double"))
    slope = st.slope_ci(used.withColumnRenamed("example_id", "g"), resamples, seed).first().asDict()
    by_length = pairs.join(examples.select("example_id", F.length("answer").alias("length")), "example_id").withColumn("judge", F.col("pred").cast("double"))
    partial = st.partial_correlation_ci(by_length, "judge", "length", "truth", "example_id", resamples, seed).first().asDict()
    matrix = st.agreement(pairs).first()["confusion"]
    errors = original.filter("judge_pass is null").count()
    return gate.certificate(report, slope, partial, n, cert_inputs, created_at) | {"confusion": matrix, "judge_errors": errors}
