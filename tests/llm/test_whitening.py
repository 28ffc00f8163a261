import math

import numpy as np
import pytest

from verdigris.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)
    return n, deviation, centred, e[order], v[:, order]


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


def check(spark, ids, vectors, got):
    n, deviation, centred, e, v = brute(vectors)
    whitened = centred @ v[:, :8] / np.sqrt(e[:8])
    signs = np.sign(np.sum(whitened * np.array([[r["whitened"] for r in got[i]] for i in ids]), 0))
    for i, d, w in zip(ids, deviation, whitened):
        rows = got[i]
        assert [r["component"] for r in rows] == list(range(1, len(w) + 1))
        assert all(r["n"] == n and r["deviation"] == d for r in rows)
        assert np.allclose([r["whitened"] for r in rows], w * signs, rtol=1e-7, atol=1e-7)
        assert np.allclose([r["explained"] for r in rows], e[:8] / e.sum(), rtol=1e-10)
        assert rows[0]["identity_error"] < 1e-9


def test_the_query_equals_eigenvectors_of_the_covariance(spark):
    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    got = collected(queries.QUERIES["op11_whitening"](spark, data))
    check(spark, [r["vec_id"] for r in rows], [r["embedding"] for r in rows], got)


def test_many_tasks_and_blocks_merge_to_the_same(spark, monkeypatch):
    random = np.random.default_rng(3)
    vectors = (random.normal(size=(700, 11)) * np.logspace(0, -2, 11) @ random.normal(size=(11, 11)) + 5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(37)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    check(spark, range(700), vectors, collected(whitening.report(df)))


def test_rotations_find_small_deviations_to_all_digits():
    random = np.random.default_rng(1)
    u, _ = np.linalg.qr(random.normal(size=(40, 9)))
    v, _ = np.linalg.qr(random.normal(size=(9, 9)))
    lengths = np.logspace(3, -3, 9)
    got, turned = whitening.rotate(whitening.triangle(u * lengths @ v.T))
    assert np.allclose(got, lengths, rtol=1e-9)
    assert np.allclose(np.abs(np.sum(turned * v, 0)), 1, atol=1e-9) and np.allclose(turned.T @ turned, np.eye(9), atol=1e-13)


def test_defined_results_of_odd_tables(spark):
    rows = [(1, [0.5, 1.0]), (None, [0.25, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as component", "1 as whitened", "2 as x", "3 as _x", "4 as deviation")
    got = collected(whitening.report(df))
    assert {k: len(v) for k, v in got.items()} == {1: 4, None: 2}
    assert all(r["whitened"] is None and r["explained"] == 0 for v in got.values() for r in v if r["component"] == 2)  # nothing varies there
    assert got[None][0]["deviation"] == 2 * 2 * 256**2 and abs(abs(got[None][0]["whitened"]) - math.sqrt(2)) < 1e-12
    one = whitening.report(df.filter("vec_id is null")).collect()
    assert len(one) == 2 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    empty = whitening.report(df.limit(0))
    assert empty.count() == 0 and empty.columns == whitening.report(df).columns
    assert whitening.report(df.filter("vec_id in (2, 3, 6)")).count() == 0
    with pytest.raises(Exception, match="share one length"):
        whitening.report(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)).collect()


def test_large_numbers_stay_exact(spark):
    df = spark.createDataFrame([(i, [float((i % 3) << 24), 1.0]) for i in range(6)], SCHEMA)
    got = collected(whitening.report(df))
    n, deviation, *_ = brute([[float((i % 3) << 24), 1.0] for i in range(6)])
    assert [got[i][0]["deviation"] for i in range(6)] == [d if d < 1 << 63 else None for d in deviation]
    assert any(d >= 1 << 63 for d in deviation) and deviation[1] == 0
