import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import resampling as rs
from verdigris.operators import statistics as st


def index(seed, b, i, n):
    return int(hashlib.md5(f"{seed}-{b}-{i}".encode()).hexdigest()[:8], 16) % n


def by_hand(rows, resamples, seed):
    """{(group, b, s): (count, sum)} of (group, key, s, x), one draw after the other."""
    out = {}
    for g in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(r for r in rows if r[0] == g)
        for b in range(resamples):
            for i in range(len(mine)):
                r = mine[index(seed, b, i, len(mine))]
                n, x = out.get((g, b, r[2]), (0, 0.0))
                out[g, b, r[2]] = n + 1, x + r[3]
    return out


def test_hashes_are_md5():
    got = rs.hashes(-3, 8, 103, 0, 1011)
    assert all(got[b - 8, i] == index(-3, b, i, 1 << 32) for b in range(8, 103) for i in (0, 7, 9, 10, 99, 100, 999, 1010))
    assert rs.hashes(7, 0, 1, 99_990, 100_020)[0].tolist() == [index(7, 0, i, 1 << 32) for i in range(99_990, 100_020)]


@pytest.mark.parametrize(("chunk", "unit"), [(1 << 14, 1 << 21), (16, 64), (64, 16)])
def test_sums_equal_single_draws(spark, monkeypatch, chunk, unit):
    monkeypatch.setattr(rs, "CHUNK", chunk)
    monkeypatch.setattr(rs, "UNIT", unit)
    r = random.Random(1)
    rows = [(g, i * 3, r.choice("xyz"), round(r.gauss(0, 1), 3)) for g, n in (("a", 200), ("b", 1), ("c", 70), ("d", 129)) for i in range(n)] + [(None, 1, "x", 5.0)]
    df = spark.createDataFrame(rows, "g string, key long, s string, x double").repartition(7)
    got = {(q["g"], q["b"], q["s"]): (q["n"], q["x"]) for q in rs.resampled_sums(df, "key", {"x": F.col("x")}, 30, 5, ["g"], "s").collect()}
    want = by_hand(rows, 30, 5)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_a_row_drawn_often_and_values_that_are_no_numbers(spark):
    assert rs.told(np.zeros(20, np.uint32), 3) == (False, b"\0" * 40) and rs.often(*rs.told(np.zeros(15, np.uint32), 3), 3).tolist() == [15, 0, 0]
    rows = [(i, [1.0, None, math.nan, 2.0, math.inf][i % 5]) for i in range(6)]
    got = {q["b"]: q["m"] for q in st.resample_means(spark.createDataFrame(rows, "k int, d double"), 40, 2, "k", "d").collect()}
    for b in range(40):
        drawn = [rows[index(2, b, i, 6)][1] for i in range(6)]
        known = [x for x in drawn if x is not None]
        want = sum(known) / len(known)
        assert got[b] == pytest.approx(want, nan_ok=True)
    assert rs.resampled_sums(spark.createDataFrame([], "k int, d double"), "k", {"d": F.col("d")}, 5, 1).count() == 0


def test_draws_are_not_broadcast_and_packed(spark):
    rows = spark.range(50_000).select("id", F.rand(1).alias("d"))
    plan = st.resample_means(rows, 50, 1, "id", "d")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("CoGroup")[0] and "BroadcastExchange" not in plan.split("MapInArrow")[0].split("CoGroup")[0]
    groups = spark.createDataFrame([(0, 50_000)], "start long, n long")
    size = rs.draws(groups, 50, 1).agg(F.sum(F.length("data"))).head()[0]
    assert size < 0.51 * 50 * 50_000  # about half a byte a draw
