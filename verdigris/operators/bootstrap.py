"""A bootstrap whose shuffle does not depend on the number of rows.

Each row counts in each resample as often as a Poisson variable of mean 1 says, which a hash of the row's key and the resample's number gives; so resamples need no draws
that meet rows, and rows of one key (a cluster) count alike wherever they lie. A task adds up, for all resamples at once, counts times sufficient statistics, in one
array; Spark adds the arrays of the tasks. What a statistic needs (a mean, an agreement, a slope, a correlation within strata) follows from its sums.

Against draws of exactly n rows the size of a resample varies by about sqrt(n); bounds agree to within a few hundredths of their distance for n in the hundreds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.statistics import NAN, _over, benjamini_hochberg, metrics, quantiles

# Step and multipliers of the hash of a resample's number.
STEP, MULTIPLIERS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Below the j-th of these 53-bit numbers a hash means at most j.
BOUNDS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) * (1 << 53)) for j in range(17)]
#: Cells of rows times resamples that are counted at once, and cells of groups times resamples times sums that a task holds.
CELLS, HELD = 1 << 19, 1 << 22


def counts(hashes: np.ndarray, first: int, last: int) -> np.ndarray:
    """How often each row counts in each resample from `first` to before `last`."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64)[:, None] + np.arange(first + 1, last + 1, dtype=np.uint64)[None, :] * np.uint64(STEP)
        for shift, by in zip((30, 27), MULTIPLIERS):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(np.array(BOUNDS, np.uint64), (z ^ (z >> np.uint64(31))) >> np.uint64(11), "right")


def counts_sql(rows: str, key: str, resamples: int, seed: int, name: str = "w") -> str:
    """DuckDB: `name` is `rows` with b and c, a row for each resample; the same counts."""
    times = lambda x, by: f"(({x})::uhugeint * {by}::uhugeint % {1 << 64}::uhugeint)::ubigint"
    start = f"((('0x'||substr(md5('{seed}-'||{key}),1,15))::ubigint::uhugeint + (b+1)::uhugeint * {STEP}::uhugeint) % {1 << 64}::uhugeint)::ubigint"
    found = " + ".join(f"(v >= {t}::ubigint)::int" for t in BOUNDS)
    return f"""{name}1 as (select r.*, b, {start} z from {rows} r cross join (select unnest(range({resamples})) b)),
 {name}2 as (select * replace ({times("xor(z, z >> 30)", MULTIPLIERS[0])} as z) from {name}1), {name}3 as (select * replace ({times("xor(z, z >> 27)", MULTIPLIERS[1])} as z) from {name}2),
 {name} as (select * exclude (z, v), {found} c from (select *, xor(z, z >> 31) >> 11 v from {name}3))"""


def task_sums(rows: DataFrame, key: str, sums: dict[str, Column], resamples: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """What each task adds to resampled_sums(): a row for each of its groups and each resample, however many rows it reads (a group comes again where more groups
    alternate than HELD allows)."""
    by, names = by or [], list(sums)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long").alias("_h")
    given = rows.select(*by, h, *(c.cast("double").alias(n) for n, c in sums.items()))
    step, width = max(1, CELLS // resamples), len(names)
    most = max(1, HELD // (resamples * width))

    def add_up(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            for group, total in held.items():
                columns = [pa.array([x] * resamples, batch.schema.field(c).type) for c, x in zip(by, group)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(resamples)), *(pa.array(total[:, i]) for i in range(width))], names=[*by, "b", *names])
            held.clear()

        batch = None
        for batch in batches:
            hashes, x = batch.column("_h").to_numpy(), np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            place = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            of = np.array([place[g] for g in groups], int)
            for group, i in place.items():
                mine = np.flatnonzero(of == i) if by else np.arange(len(hashes))
                total = held.setdefault(group, np.zeros((resamples, width)))
                for lo in range(0, len(mine), step):
                    part = mine[lo : lo + step]
                    total += counts(hashes[part], 0, resamples).T @ x[part]
                if len(held) >= most:
                    yield from out()
        if held:
            yield from out()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in by)
    schema = ", ".join([*([kinds] if by else []), "b long", *(f"`{n}` double" for n in names)])
    return given.mapInArrow(add_up, schema)


def resampled_sums(rows: DataFrame, key: str, sums: dict[str, Column], resamples: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by..., b, sums...): for each resample the sums over all rows of their count times each of `sums`, which may hold no nulls. Groups of `by` without a count
    in a resample have sums of 0. An empty table gives no rows."""
    return task_sums(rows, key, sums, resamples, seed, by).groupBy(*(by or []), "b").agg(*(F.sum(n).alias(n) for n in sums))


def bounds(drawn: DataFrame, of: str, by: list[str] | None = None, *more: Column) -> DataFrame:
    """lo, hi of a column over the resamples in which it is not NaN."""
    return drawn.filter(F.col(of).isNotNull() & ~F.isnan(of)).groupBy(*(by or [])).agg(*quantiles(of), *more)


def mean_ci(rows: DataFrame, value: str, key: str, resamples: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """by..., n, mean, lo, hi, p_neg (share of resamples with a mean below 0) of the values that are not null."""
    by = by or []
    use = rows.filter(F.col(value).isNotNull())
    drawn = resampled_sums(use, key, {"_n": F.lit(1), "_s": F.col(value)}, resamples, seed, by).select(*by, _over(F.col("_s"), F.col("_n")).alias("_m"))
    base = use.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    found = bounds(drawn, "_m", by, F.avg((F.col("_m") < 0).cast("double")).alias("p_neg"))
    return base.join(found, by) if by else base.crossJoin(found)  # one row each


def per_tag(deltas: DataFrame, resamples: int, seed: int, q: float = 0.05) -> DataFrame:
    """tag, n, delta, lo, hi, p, flagged of (tag, task_id, d): p is the share of means >= 0."""
    found = mean_ci(deltas, "d", "task_id", resamples, seed, ["tag"]).withColumn("p", 1 - F.col("p_neg"))
    tested = benjamini_hochberg(found.select("tag", "n", F.col("mean").alias("delta"), "lo", "hi", "p"), "p", q)
    return tested.withColumn("flagged", F.col("reject") & (F.col("delta") < 0)).drop("reject")


def agreement_ci(pairs: DataFrame, key: str, resamples: int, seed: int, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """metric, lo, hi of the six metrics of agreement over pairs without nulls."""
    use = pairs.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    is_ = lambda p, t: ((F.col(pred) == p) & (F.col(truth) == t)).cast("int")
    drawn = resampled_sums(use, key, {"tn": is_(False, False), "fp": is_(True, False), "fn": is_(False, True), "tp": is_(True, True)}, resamples, seed)
    named = F.map_from_arrays(F.array(*map(F.lit, metrics())), F.array(*metrics().values()))
    return bounds(drawn.select(F.explode(named).alias("metric", "x")), "x", ["metric"])


def slope_ci(rows: DataFrame, resamples: int, seed: int, x: str = "x", y: str = "y", group: str = "g") -> DataFrame:
    """slope, lo, hi of y on x; whole groups are resampled, through the hash of their name."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    use = rows.filter(xd.isNotNull() & yd.isNotNull() & F.col(group).isNotNull())
    drawn = resampled_sums(use, group, {"n": F.lit(1), "sx": xd, "sy": yd, "sxy": xd * yd, "sxx": xd * xd}, resamples, seed)
    slope = _over(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    point = use.agg(F.coalesce(F.regr_slope(yd, xd), F.lit(NAN)).alias("slope"))
    return point.crossJoin(bounds(drawn.select(slope.alias("s")), "s"))  # one row each


def partial_correlation_ci(rows: DataFrame, a: str, b: str, given: str, key: str, resamples: int, seed: int) -> DataFrame:
    """lo, hi of the correlation of a and b after each is centred within `given`; 0 where either does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    use = rows.filter(x.isNotNull() & y.isNotNull() & F.col(given).isNotNull())
    sums = {"n": F.lit(1), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x, "syy": y * y}
    drawn = resampled_sums(use, key, sums, resamples, seed, [given]).filter("n > 0")
    centred = lambda p, q, both: F.sum(F.col(both) - F.col(p) * F.col(q) / F.col("n"))
    drawn = drawn.groupBy("b").agg(centred("sx", "sy", "sxy").alias("xy"), centred("sx", "sx", "sxx").alias("xx"), centred("sy", "sy", "syy").alias("yy"))
    r = F.when((F.col("xx") > 1e-9) & (F.col("yy") > 1e-9), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0))
    return bounds(drawn.select(r.alias("r")), "r")
