"""Statistics of evaluation runs: bootstrap, gate rule, multiple testing, agreement, bias tests, Monte Carlo power.

Two bootstrap engines: `resample_means` takes its draws from MD5, so that any SQL engine gives the same numbers (`operators/resampling.py`);
`bootstrap_by_group` runs the seeded generator of numpy inside an Arrow grouped map, in memory-bounded slices of resamples.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.operators.resampling import resampled_sums

Z975, Z80 = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)
NAN = float("nan")
#: Cells of an index matrix that one slice of numpy resamples holds.
SLICE_CELLS = 4_000_000


def resample_means(values: DataFrame, resamples: int, seed: int, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., b, m): mean of each of `resamples` resamples of each group; null where only nulls were drawn."""
    d = F.col(value).cast("double")
    drawn = resampled_sums(values, order, {"_known": d.isNotNull().cast("int"), "_sum": F.coalesce(d, F.lit(0.0))}, resamples, seed, by)
    return drawn.select(*(by or []), "b", F.when(F.col("_known") > 0, F.col("_sum") / F.col("_known")).alias("m"))


def quantiles(of: str, alpha: float = 0.05) -> list[Column]:
    q = lambda p: F.expr(f"percentile({of}, {p})")
    return [q(alpha / 2).alias("lo"), q(1 - alpha / 2).alias("hi")]


def mde(sd: Column, n: Column) -> Column:
    """Least effect found with 80 % power at 5 %, two-sided."""
    return F.when(n > 0, F.lit(Z975 + Z80) * sd / F.sqrt(n)).otherwise(F.lit(NAN))


def thresholded_mde(sd: Column, n: Column, eps_points: float = 2.0) -> Column:
    """Least drop that the gate blocks with 80 % power: its bar is the wider of the threshold and what is significant."""
    se = sd / F.sqrt(n)
    return F.when(n > 0, F.greatest(F.lit(eps_points / 100), F.lit(Z975) * se) + F.lit(Z80) * se).otherwise(F.lit(NAN))


def paired_bootstrap(deltas: DataFrame, resamples: int, seed: int, order: str = "task_id", value: str = "d") -> DataFrame:
    """One row: n, delta, sd, lo, hi, upper (97.5 %), p_neg, mde of paired differences."""
    base = deltas.agg(F.count(value).alias("n"), F.avg(value).alias("delta"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    boot = resample_means(deltas, resamples, seed, order, value).agg(*quantiles("m"), F.expr("percentile(m, 0.975)").alias("upper"), F.avg((F.col("m") < 0).cast("double")).alias("p_neg"))
    return base.crossJoin(boot).withColumn("mde", mde(F.col("sd"), F.col("n")))  # one row each


def gate(delta: Column, upper: Column, eps_points: float = 2.0) -> Column:
    """block: a drop of at least eps points, with the upper bound below zero; warn: without; else pass."""
    return F.when(delta * 100 <= -eps_points + 1e-9, F.when(upper < 0, "block").otherwise("warn")).otherwise("pass")


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: float = 0.05) -> DataFrame:
    """`tests` with reject boolean: step-up over all rows (a row a tag, so one task holds few)."""
    every = W.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(p))
    ranked = tests.withColumn("_r", rank).withColumn("_m", F.count("*").over(every))
    ranked = ranked.withColumn("_k", F.max(F.when(F.col(p) <= F.lit(q) * F.col("_r") / F.col("_m"), F.col("_r"))).over(every))
    return ranked.withColumn("reject", F.coalesce(F.col("_r") <= F.col("_k"), F.lit(False))).drop("_r", "_m", "_k")


def per_tag(deltas: DataFrame, resamples: int, seed: int, q: float = 0.05) -> DataFrame:
    """tag, n, delta, lo, hi, p, flagged of (tag, task_id, d): the same resampling for every tag; p is the share of means >= 0."""
    base = deltas.groupBy("tag").agg(F.count("*").alias("n"), F.avg("d").alias("delta"))
    boot = resample_means(deltas, resamples, seed, "task_id", "d", ["tag"]).groupBy("tag").agg(*quantiles("m"), F.avg((F.col("m") >= 0).cast("double")).alias("p"))
    tested = benjamini_hochberg(base.join(boot, "tag"), "p", q)
    return tested.withColumn("flagged", F.col("reject") & (F.col("delta") < 0)).drop("reject")


# --- numpy engine


def numpy_means(x: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of seeded resamples, the stream of one integers(0, n, (resamples, n)) call, in slices of rows."""
    random, n = np.random.default_rng(seed), len(x)
    step = max(1, SLICE_CELLS // max(n, 1))
    parts = [x[random.integers(0, n, size=(min(step, resamples - lo), n))].mean(axis=1) for lo in range(0, resamples, step)]
    return np.concatenate(parts) if n else np.full(resamples, NAN)


def bootstrap_by_group(values: DataFrame, by: str, value: str, order: str, resamples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """by, n, point, lo, hi of each group, by numpy in an Arrow grouped map."""
    kind = values.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        means = numpy_means(x, resamples, seed)
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(x)], "point": [x.mean() if len(x) else NAN], "lo": [lo], "hi": [hi]})

    return values.select(by, order, value).groupBy(by).applyInPandas(run, f"`{by}` {kind}, n long, point double, lo double, hi double")


# --- agreement


def cells(pred: Column, truth: Column) -> list[Column]:
    pick = lambda p, t: F.count_if((pred == p) & (truth == t))
    return [pick(False, False).alias("tn"), pick(True, False).alias("fp"), pick(False, True).alias("fn"), pick(True, True).alias("tp")]


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a / F.when(b != 0, b))


def metrics() -> dict[str, Column]:
    """Expressions over the columns tn, fp, fn, tp; NaN where a metric is undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    raw = _over(tp + tn, n)
    pred, truth = _over(tp + fp, n), _over(tp + fn, n)
    by_chance = pred * truth + (1 - pred) * (1 - truth)
    mean = (pred + truth) / 2
    by_gwet = 2 * mean * (1 - mean)
    return {"raw": raw, "kappa": _over(raw - by_chance, 1 - by_chance), "ac1": _over(raw - by_gwet, 1 - by_gwet), "pabak": 2 * raw - 1, "precision": _over(tp, tp + fp), "recall": _over(tp, tp + fn)}


def agreement(pairs: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row: the counts, the confusion matrix [[tn, fp], [fn, tp]] and the six metrics."""
    counted = pairs.agg(*cells(F.col(pred), F.col(truth)))
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion")
    return counted.select("tn", "fp", "fn", "tp", matrix, *(c.alias(n) for n, c in metrics().items()))


def agreement_report(pairs: DataFrame, resamples: int, seed: int, order: str, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """metric, point, lo, hi for the six metrics, all from the same resamples; resamples where a metric is NaN are left out of its bounds."""
    is_ = lambda p, t: ((F.col(pred) == p) & (F.col(truth) == t)).cast("int")
    known = pairs.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    drawn = resampled_sums(known, order, {"tn": is_(False, False), "fp": is_(True, False), "fn": is_(False, True), "tp": is_(True, True)}, resamples, seed)
    names = list(metrics())
    long = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*metrics().values()))).alias("metric", "x"))
    point = long(agreement(pairs, pred, truth).select("tn", "fp", "fn", "tp")).withColumnRenamed("x", "point")
    bounds = long(drawn).filter(~F.isnan("x")).groupBy("metric").agg(*quantiles("x"))
    fill = lambda c: F.coalesce(c, F.lit(NAN)).alias(c)
    return point.join(bounds, "metric", "left").select("metric", "point", fill("lo"), fill("hi"))


def wilson(k: Column, n: Column, z: float = Z975) -> tuple[Column, Column]:
    """Bounds of a share; NaN for n = 0."""
    kd, nd = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, zz = kd / nd, z * z
    mid, half = (p + zz / (2 * nd)) / (1 + zz / nd), z * F.sqrt(p * (1 - p) / nd + zz / (4 * nd * nd)) / (1 + zz / nd)
    fill = lambda c: F.coalesce(c, F.lit(NAN))
    return fill(mid - half), fill(mid + half)


# --- bias tests


def slope_ci(rows: DataFrame, resamples: int, seed: int, x: str = "x", y: str = "y", group: str = "g") -> DataFrame:
    """slope, lo, hi of y on x; bounds by resampling whole groups, through their sums. NaN where x does not vary."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    sums = rows.filter(xd.isNotNull() & yd.isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").cast("double").alias("n"), F.sum(xd).alias("sx"), F.sum(yd).alias("sy"), F.sum(xd * yd).alias("sxy"), F.sum(xd * xd).alias("sxx"))
    names = ("n", "sx", "sy", "sxy", "sxx")
    total = [F.sum(c).alias(c) for c in names]
    of = lambda: _over(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    drawn = resampled_sums(sums, "g", {f"_{c}": F.col(c) for c in names}, resamples, seed).select(*(F.col(f"_{c}").alias(c) for c in names)).select(of().alias("s")).filter(~F.isnan("s"))
    fill = lambda c: F.coalesce(c, F.lit(NAN)).alias(c)
    return sums.agg(*total).select(of().alias("slope")).crossJoin(drawn.agg(*quantiles("s"))).select("slope", fill("lo"), fill("hi"))  # one row each


def partial_correlation(rows: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """One row: correlation of a and b after each is centred within `given`; 0 where either does not vary.

    Centred sums come from sums by stratum, so no window holds a stratum.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    use = rows.filter(x.isNotNull() & y.isNotNull() & F.col(given).isNotNull())
    s = use.groupBy(given).agg(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.count("*").cast("double").alias("n"))
    t = s.agg(*(F.sum(F.col(c) * F.col("n")).alias(c) for c in ("xy", "xx", "yy")))
    return t.select(F.when((F.col("xx") > 1e-18) & (F.col("yy") > 1e-18), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0)).alias("partial_corr"))


def partial_correlation_ci(rows: DataFrame, a: str, b: str, given: str, order: str, resamples: int, seed: int) -> DataFrame:
    """point, lo, hi: rows resampled, sums kept by resample and stratum."""
    use = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(given).isNotNull())
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    # less a value of the stratum, so that sums lose no digits and a column that does not vary gives zeros
    least = use.groupBy(given).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    own = use.join(least, given).select(F.col(order).alias("_order"), (x - F.col("_x0")).alias("x"), (y - F.col("_y0")).alias("y"), F.col(given).alias("g"))
    x, y = F.col("x"), F.col("y")
    s = resampled_sums(own, "_order", {"sx": x, "sy": y, "sxy": x * y, "sxx": x * x, "syy": y * y}, resamples, seed, within="g")
    centred = lambda p, q, both: F.sum(F.col(both) - F.col(p) * F.col(q) / F.col("n"))
    s = s.groupBy("b").agg(centred("sx", "sy", "sxy").alias("xy"), centred("sx", "sx", "sxx").alias("xx"), centred("sy", "sy", "syy").alias("yy"), F.sum("sxx").alias("most_x"), F.sum("syy").alias("most_y"))
    varies = lambda c: (F.col(f"{c}{c}") > 1e-18) & (F.col(f"{c}{c}") > 1e-14 * F.col(f"most_{c}"))
    r = s.select(F.when(varies("x") & varies("y"), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0)).alias("r"))
    return partial_correlation(rows, a, b, given).withColumnRenamed("partial_corr", "point").crossJoin(r.agg(*quantiles("r")))  # one row each


def verbosity(slope: dict, partial: dict, most_slope_points: float = 2.0) -> dict:
    """Pass flags of the two tests; a bound that is NaN fails."""
    return {"slope_pass": bool(slope["hi"] * 100 <= most_slope_points), "partial_corr_pass": bool(partial["lo"] <= 0)}


def certified(kappa: dict, flags: dict, least_lo: float = 0.4, least: float = 0.6) -> bool:
    """Agreement and both bias tests; NaN anywhere fails, since comparisons with NaN are false in Python."""
    return bool(kappa["lo"] >= least_lo and kappa["point"] >= least and flags["slope_pass"] and flags["partial_corr_pass"])


# --- power


def simulated(spark: SparkSession, deltas: list[float], sd: float, n: int, trials: int, resamples: int = 500, eps_points: float = 2.0, seed: int = 0) -> DataFrame:
    """true_delta, blocked, covered: a row for each trial of normal paired differences, trials spread over tasks."""

    def run(batches):
        for pdf in batches:
            out = []
            for delta, trial in zip(pdf["true_delta"], pdf["trial"]):
                random = np.random.default_rng([seed, int(trial), int(round(abs(delta) * 1000))])
                x = random.normal(delta / 100, sd, n)
                m = x[random.integers(0, n, size=(resamples, n))].mean(1)
                lo, hi = np.quantile(m, [0.025, 0.975])
                out.append((delta, bool(x.mean() * 100 <= -eps_points + 1e-9 and hi < 0), bool(lo <= delta / 100 <= hi)))
            yield pd.DataFrame(out, columns=["true_delta", "blocked", "covered"])

    grid = spark.range(trials).select(F.col("id").alias("trial")).withColumn("true_delta", F.explode(F.array(*map(F.lit, map(float, deltas)))))
    return grid.mapInPandas(run, "true_delta double, blocked boolean, covered boolean")


def power_table(trials: DataFrame) -> DataFrame:
    """true_delta, block_rate, coverage, trials."""
    return trials.groupBy("true_delta").agg(F.avg(F.col("blocked").cast("double")).alias("block_rate"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.count("*").alias("trials"))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for erf, to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.when(z < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-x * x))
    return 0.5 * (1 + erf)


def analytic_block(true_delta: Column, sd: Column, n: Column, eps_points: float = 2.0) -> Column:
    """Probability of a block for normal means: both the drop of eps and the upper bound below zero."""
    se = sd / F.sqrt(n)
    return normal_cdf((-F.greatest(F.lit(eps_points / 100), F.lit(Z975) * se) - true_delta / 100) / se)


def false_block_rate(verdicts: DataFrame, most: float = 0.05) -> DataFrame:
    """Share of blocks among runs of equal sides, and whether it is small enough."""
    rate = F.avg((F.col("verdict") == "block").cast("double"))
    return verdicts.agg(F.count("*").alias("runs"), rate.alias("rate"), F.coalesce(rate <= most, F.lit(False)).alias("passed"))


def analytic_verdict(delta: Column, sd: Column, n: Column, eps_points: float = 2.0) -> Column:
    """The gate rule with the normal upper bound in place of the bootstrap's."""
    return gate(delta, delta + F.lit(Z975) * sd / F.sqrt(n), eps_points)
