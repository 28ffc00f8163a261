import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import ann


def test_recall_order_and_ties(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(10, 32))
    x = centers[r.integers(0, 10, 3000)] + r.normal(size=(3000, 32)) * 0.7
    x[500:1500] = x[500]  # a third are equal
    rows = [(i, [float(v) for v in x[i].astype(np.float32)]) for i in range(3000)]
    rows += [(10000, None), (10020, [0.0] * 32), (10040, [float("nan")] + [1.0] * 31), (10060, [None] + [1.0] * 31), (None, [1.0] * 32)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    ids, v = np.arange(3000), x.astype(np.float32).astype(np.float64)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        score = np.einsum("nd,d->n", v, v[q])
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hits += len(set(best) & set(part["vec_id"]))
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part["vec_id"])
        assert np.allclose(part["score"], score[part["vec_id"]], rtol=0, atol=0)
        order = list(zip(-part["score"], part["vec_id"]))
        assert order == sorted(order)
    assert set(got["query_id"]) == set(range(0, 3000, 20)) and hits >= 0.9 * 150 * 20


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0]), (20, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(few, F.col("vec_id") % 20 == 0)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got.filter("query_id = 0").orderBy("rank").collect()] == [(1, 2, 2.0), (2, 1, 0.5), (3, 20, -1.0)]
    assert got.count() == 6 and ann.nearest(few.limit(0), F.lit(True)).count() == 0


def brute(rows, top):
    """Each query row's neighbours, by the same measure."""
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = []
    for q, x in zip(ids, v):
        if q % 20 == 0:
            score = np.einsum("nd,d->n", v, x)
            best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:top]
            out += [(int(q), rank + 1, int(ids[i]), float(score[i])) for rank, i in enumerate(best)]
    return sorted(out)


def test_blocks_copies_and_repeated_rows_change_nothing(spark, monkeypatch):
    """With everything visited the result is exact: small blocks, copies of blocks, a key on a third of all rows, equal vectors."""
    for name, value in (("BLOCK", 40), ("QUERY_BLOCK", 7), ("AT_ONCE", 5), ("LEAF", 16), ("TARGET_RECALL", 1.0)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 6)) * r.lognormal(size=(600, 1))
    x[100:200] = x[100]
    rows = [(20 if 300 <= i < 500 else i, [float(c) for c in x[i]]) for i in range(600)]
    rows += rows[:40]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 20)


def test_length_of_vectors_matters(spark):
    """Nearness is inner product: of two candidates in one direction the longer one comes first, and far ones are found."""
    r = np.random.default_rng(6)
    x = r.normal(size=(2000, 8)) * np.exp(r.normal(size=(2000, 1)))
    rows = [(i, [float(c) for c in x[i]]) for i in range(2000)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, top=10).collect()
    want = {(q, v) for q, _, v, _ in brute(rows, 10)}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
