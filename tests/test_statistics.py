import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import pairing, sampling
from verdigris.operators import statistics as st


def table(spark, tp, tn, fp, fn):
    rows = [(True, True)] * tp + [(False, False)] * tn + [(True, False)] * fp + [(False, True)] * fn
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, pred boolean, truth boolean")


def test_agreement(spark):
    m = st.agreement(table(spark, 47, 41, 5, 7)).first()
    assert m["raw"] == pytest.approx(0.88) and m["kappa"] == pytest.approx(0.3784 / 0.4984) and m["pabak"] == pytest.approx(0.76)
    assert m["ac1"] == pytest.approx(0.3818 / 0.5018) and m["precision"] == pytest.approx(47 / 52) and m["recall"] == pytest.approx(47 / 54)
    assert m["confusion"] == [[41, 5], [7, 47]]
    same = st.agreement(table(spark, 10, 0, 0, 0)).first()
    assert math.isnan(same["kappa"]) and same["ac1"] == 1.0


def test_agreement_bounds_hold_the_point_and_degenerate_ones_are_nan(spark):
    r = {x["metric"]: x for x in st.agreement_report(table(spark, 47, 41, 5, 7), 300, 1, "id").collect()}
    assert set(r) == set(st.metrics()) and all(x["lo"] < x["point"] < x["hi"] for x in r.values())
    r = {x["metric"]: x for x in st.agreement_report(table(spark, 10, 0, 0, 0), 50, 1, "id").collect()}
    assert math.isnan(r["kappa"]["lo"]) and not st.certified(r["kappa"].asDict(), {"slope_pass": True, "partial_corr_pass": True})


def test_wilson_and_mde(spark):
    lo, hi = st.wilson(F.lit(6), F.lit(60))
    x = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), st.mde(F.lit(0.45), F.lit(300)).alias("m"), st.mde(F.lit(0.45), F.lit(0)).alias("none")).first()
    assert x["lo"] == pytest.approx(0.0466, abs=1e-4) and x["hi"] == pytest.approx(0.2015, abs=1e-4)
    assert x["m"] * 100 == pytest.approx(7.3, abs=0.05) and math.isnan(x["none"])


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.5)], "tag string, p double")
    assert {r["tag"]: r["reject"] for r in st.benjamini_hochberg(rows).collect()} == {"a": True, "b": True, "c": False, "d": False}


@pytest.mark.parametrize(("delta", "upper", "want"), [(-0.03, -0.01, "block"), (-0.02, -0.001, "block"), (-0.05, 0.0, "warn"), (-0.019, -0.01, "pass"), (0.0, 0.0, "pass")])
def test_gate_boundaries(spark, delta, upper, want):
    assert spark.range(1).select(st.gate(F.lit(delta), F.lit(upper)).alias("g")).first()["g"] == want


def test_engines_agree_and_numpy_is_the_seeded_stream(spark):
    x = np.random.default_rng(1).normal(-0.05, 0.3, 149)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "g string, task_id int, d double")
    fast = st.bootstrap_by_group(rows, "g", "d", "task_id", 2000, 3).first()
    index = np.random.default_rng(3).integers(0, 149, size=(2000, 149))
    assert (fast["lo"], fast["hi"]) == tuple(np.quantile(x[index].mean(1), [0.025, 0.975]))
    slow = st.paired_bootstrap(rows, 2000, 3).first()
    assert slow["n"] == 149 and abs(slow["lo"] - fast["lo"]) < 0.006 and abs(slow["hi"] - fast["hi"]) < 0.006 and slow["sd"] == pytest.approx(x.std(ddof=1))


def test_slices_of_resamples_are_one_stream(monkeypatch):
    x = np.arange(50.0)
    whole = st.numpy_means(x, 100, 5)
    monkeypatch.setattr(st, "SLICE_CELLS", 333)
    assert (st.numpy_means(x, 100, 5) == whole).all()


def test_only_the_worse_tag_is_flagged(spark):
    rows = [("pricing", i, -0.3 + 0.01 * (i % 3)) for i in range(40)] + [("hr", i, 0.3 + 0.01 * (i % 3)) for i in range(40)]
    got = {r["tag"]: r["flagged"] for r in st.per_tag(spark.createDataFrame(rows, "tag string, task_id int, d double"), 200, 1).collect()}
    assert got == {"pricing": True, "hr": False}


def test_slope_by_groups(spark):
    flat = [(g, x, 0.5) for g in range(100) for x in (0.0, 1.0, 1.71)]
    steep = [(g, x, 0.4 + 0.1 * x + 0.01 * ((g % 5) - 2)) for g in range(100) for x in (0.0, 1.0, 1.71)]
    kind = "g int, x double, y double"
    r = st.slope_ci(spark.createDataFrame(flat, kind), 200, 1).first()
    assert r["slope"] == pytest.approx(0) and st.verbosity(r.asDict(), {"lo": -0.1})["slope_pass"]
    r = st.slope_ci(spark.createDataFrame(steep, kind), 200, 1).first()
    assert r["lo"] * 100 > 2 and not st.verbosity(r.asDict(), {"lo": 0.1})["partial_corr_pass"]
    assert math.isnan(st.slope_ci(spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], kind), 20, 1).first()["slope"])


def test_partial_correlation(spark):
    rows = [(i, i % 2 == 0, float(i % 10), float(i % 2 == 0)) for i in range(400)]
    t = spark.createDataFrame(rows, "id int, human boolean, length double, judge double")
    assert st.partial_correlation(t, "judge", "length", "human").first()["partial_corr"] == 0.0
    rows = [(i, i % 2 == 0, float(i % 10), float(i % 10 > 5)) for i in range(400)]
    r = st.partial_correlation_ci(spark.createDataFrame(rows, "id int, human boolean, length double, judge double"), "judge", "length", "human", "id", 100, 1).first()
    assert r["lo"] > 0 and r["lo"] < r["point"] < r["hi"]


def test_power(spark):
    r = {x["true_delta"]: x for x in st.power_table(st.simulated(spark, [-8, 0], 0.28, 149, 300, 400)).collect()}
    assert r[-8.0]["block_rate"] > 0.85 and r[0.0]["block_rate"] < 0.06 and 0.9 < r[-8.0]["coverage"] < 0.99
    x = spark.range(1).select(st.analytic_block(F.lit(-8.0), F.lit(0.45), F.lit(300)).alias("a"), st.analytic_block(F.lit(0.0), F.lit(0.45), F.lit(300)).alias("b")).first()
    assert x["a"] == pytest.approx(0.87, abs=0.01) and x["b"] == pytest.approx(0.025, abs=0.003)


def test_pairing(spark):
    kind = "task_id string, success boolean"
    base = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", True), ("c", None)], kind)
    cand = spark.createDataFrame([("a", True), ("c", True), ("d", True)], kind)
    assert {r["task_id"]: r["m"] for r in pairing.task_means(base).collect()} == {"a": 0.5, "b": 1.0, "c": None}
    pairs = pairing.paired(base, cand)
    assert [(r["task_id"], r["d"]) for r in pairing.deltas(pairs).collect()] == [("a", 0.5)]
    assert sorted(r["task_id"] for r in pairing.dropped(pairs).collect()) == ["b", "c", "d"]


def test_worst_takes_first_and_then_keeps_losses(spark):
    pairs = spark.createDataFrame([("b", 1.0, 0.5, -0.5), ("a", 1.0, 0.5, -0.5), ("c", 0.0, 1.0, 1.0), ("d", 1.0, 1.0, 0.0)], "task_id string, base double, cand double, d double")
    fails = spark.createDataFrame([("a", 1, False, "t1"), ("a", 0, None, "t0"), ("b", 0, True, "x")], "task_id string, repeat int, success boolean, trace_id string")
    got = pairing.worst(pairs, 3, fails).orderBy("d", "task_id").collect()
    assert [(r["task_id"], r["trace_id"]) for r in got] == [("a", "t0"), ("b", None)]


def test_allocation_and_stratified_sample(spark):
    assert sampling.allocate({("a",): 170, ("b",): 8, ("c",): 3}, 100, 5) == {("a",): 92, ("b",): 5, ("c",): 3}
    with pytest.raises(ValueError):
        sampling.allocate({("a",): 10, ("b",): 10}, 5, 4)
    rows = spark.createDataFrame([(i, "abc"[0 if i < 170 else 1 if i < 178 else 2]) for i in range(181)], "id int, cell string")
    got = sampling.stratified_sample(rows, ["cell"], 100, 5, 1, "id")
    assert {r["cell"]: r["count"] for r in got.groupBy("cell").count().collect()} == {"a": 92, "b": 5, "c": 3}
    assert got.select("id").distinct().count() == 100 and sampling.sample(rows, 0.25, 1, "id").count() == 45


def test_selection_by_histograms_equals_sorting(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(sampling, "RANKED", 3)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    rows = [(i, None if i % 7 == 0 else "abc"[i % 3 % 2], i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, cell string, n int").repartition(7)
    order = lambda i: (hashlib.md5(f"5-{i}".encode()).hexdigest(), i)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    for share in (0.0, 0.001, 0.37, 1.0):
        assert ids(sampling.sample(df, share, 5, "id")) == sorted(sorted(range(900), key=order)[: round(share * 900)])
    take = spark.createDataFrame([("a", 0, 40), ("b", 1, 1), (None, 1, 10_000), ("none", 0, 3), ("a", 1, 0)], "cell string, n int, _take long")
    want = []
    for c, n, k in (("a", 0, 40), ("b", 1, 1), (None, 1, 10_000)):
        want += sorted((i for i, x, y in rows if (x, y) == (c, n)), key=order)[:k]
    got = sampling.first_by_hash(df, take, ["cell", "n"], 5, "id")
    assert ids(got) == sorted(want) and got.columns == df.columns
    assert sampling.sample(df.limit(0), 0.5, 5, "id").count() == 0


def test_spending_refuses_from_the_cap_on(spark):
    rows = spark.createDataFrame([("r", i, 1.5) for i in range(4)], "run string, seq int, cost double")
    got = pairing.running_cost(rows, "run", ["seq"], "cost", 3.0).orderBy("seq").collect()
    assert [r["refused"] for r in got] == [False, False, True, True]
