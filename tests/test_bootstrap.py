import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import bootstrap
from verdigris.operators import statistics as st


def test_counts_are_poisson_and_of_the_key_alone():
    c = bootstrap.counts(np.arange(2000) * 7919, 0, 500)
    assert c.mean() == pytest.approx(1, abs=0.01) and c.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(c[0], c[1])[0, 1]) < 0.15
    assert (bootstrap.counts(np.array([5 * 7919]), 100, 120) == c[5, 100:120]).all()
    assert [round((c == k).mean(), 2) for k in range(3)] == [0.37, 0.37, 0.18]


def data(spark, n=400, parts=6):
    r = np.random.default_rng(5)
    x = r.normal(size=n)
    rows = [(i, f"g{i % 40}", f"s{i % 3}", float(x[i]), float(0.5 * x[i] + r.normal()), bool(x[i] > 0), bool(x[i] + r.normal() > 0), float(r.normal(-0.05, 0.3))) for i in range(n)]
    return spark.createDataFrame(rows, "id int, g string, s string, x double, y double, pred boolean, truth boolean, d double").repartition(parts)


def close(a, b, share=0.15):
    """Bounds agree to a share of their distance."""
    width = b["hi"] - b["lo"]
    return abs(a["lo"] - b["lo"]) < share * width and abs(a["hi"] - b["hi"]) < share * width


def test_one_aggregator_agrees_with_drawn_rows(spark):
    rows = data(spark)
    means = bootstrap.mean_ci(rows, "d", "id", 1000, 3).first()
    assert means["n"] == 400 and close(means, st.paired_bootstrap(rows.withColumnRenamed("id", "task_id"), 1000, 3).first())
    drawn = {r["metric"]: r for r in st.agreement_report(rows, 500, 3, "id").collect()}
    got = {r["metric"]: r for r in bootstrap.agreement_ci(rows, "id", 500, 3).collect()}
    assert got.keys() == drawn.keys() and all(close(got[m], drawn[m], 0.2) for m in got)
    assert close(bootstrap.slope_ci(rows, 500, 3).first(), st.slope_ci(rows, 500, 3).first(), 0.25)
    assert close(bootstrap.partial_correlation_ci(rows, "x", "y", "s", "id", 500, 3).first(), st.partial_correlation_ci(rows, "x", "y", "s", "id", 500, 3).first(), 0.2)


def test_sums_do_not_depend_on_tasks_batches_or_slices(spark, monkeypatch):
    rows = data(spark, 90)
    sums = {"n": F.lit(1), "v": F.col("d")}
    key = lambda df: sorted((r["s"], r["b"], r["n"], round(r["v"], 9)) for r in df.collect())
    want = key(bootstrap.resampled_sums(rows, "id", sums, 50, 3, ["s"]))
    monkeypatch.setattr(bootstrap, "CELLS", 200)
    monkeypatch.setattr(bootstrap, "HELD", 100)
    assert key(bootstrap.resampled_sums(rows.coalesce(1), "id", sums, 50, 3, ["s"])) == want and len(want) == 150
    assert bootstrap.resampled_sums(rows.limit(0), "id", sums, 50, 3, ["s"]).count() == 0


def test_what_is_shuffled_does_not_depend_on_rows(spark):
    sums = {"n": F.lit(1), "v": F.col("d")}
    sent = [bootstrap.task_sums(data(spark, n, 3), "id", sums, 20, 3).count() for n in (60, 600, 6000)]
    assert sent == [60, 60, 60]
    assert bootstrap.task_sums(data(spark, 600, 3), "id", sums, 20, 3, ["s"]).count() == 3 * 3 * 20
