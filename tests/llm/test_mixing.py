import random

import pytest
from pyspark.sql import functions as F

from verdigris.llm import mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_taken_words(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 60))), r.choice(["a", "a", "a", "a", "b", "c", None, "é", "Z"])) for i in range(3000)]
    rows += [(5000, "x " * 30, "tiny"), (5001, None, "a"), (5002, "", "b"), (None, "one two", "a"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    source = {d: s for d, _, s in rows}
    want = targets(sizes)
    assert len(got) == len(rows)
    total = dict.fromkeys(sizes, 0)
    for g in got:
        s = source[g["doc_id"]]
        assert g["target"] == pytest.approx(want[s]) and g["source_size"] == sizes[s] and g["taken"] <= 3 * g["size"]
        total[s] += g["taken"]
    for s in sizes:
        assert abs(total[s] - want[s]) <= 60, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(7)).collect()))


def test_repeated_and_null_ids_each_have_a_place_of_their_own(spark, monkeypatch):
    """Three sources alike in size: all rows of x repeat one id, all ids of z are null; every source must come near its target, in the report, in the mix and in SQL."""
    import duckdb

    from verdigris.llm import queries

    monkeypatch.setattr(mixing, "COPIES", 64)
    text = "a b c d e"
    rows = [(1, text, "x")] * 1000 + [(10 + i, text, "y") for i in range(1000)] + [(None, text, "z")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_report(docs)
    sums = {r["target"]: (r["taken"], r["least"], r["most"], r["n"]) for r in got.groupBy("target").agg({"taken": "sum"}).join(got.groupBy("target").agg(F.min("taken").alias("least"), F.max("taken").alias("most"), F.count("*").alias("n")), "target").withColumnRenamed("sum(taken)", "taken").collect()}
    assert sorted(sums) == [2500.0, 5000.0, 7500.0]
    for target, (taken, least, most, n) in sums.items():
        assert abs(taken - target) <= 5 and most - least <= 5 and n == 1000
    mixed = {r["source"]: r["n"] for r in mixing.mix_documents(docs.selectExpr("*", "3 as copies", "'s' as slope", "1 as i")).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(mixed[s] * 5 - t) <= 5 for s, t in zip("xyz", (2500, 5000, 7500)))
    sql = duckdb.connect()
    sql.register("documents", docs.toArrow())
    want = sql.sql(queries.ORACLES["op5_mixing"])
    key = lambda rows: sorted(tuple(-1.0 if x is None else round(float(x), 6) for x in r) for r in rows)
    assert key(map(tuple, got.select(*want.columns).collect())) == key(want.fetchall())


def test_rows_come_in_training_order_as_often_as_taken(spark):
    rows = [(i, "word " * (i % 9), "abc"[i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as passes", "'k' as size")
    report = {g["doc_id"]: g["taken"] // g["size"] if g["size"] else 0 for g in mixing.mix_report(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    for x in mixed.collect():
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + 1
    # the order of documents on a source's axis depends on the key, so only totals agree with the report
    assert abs(sum(got[d] * (d % 9) for d in got) - sum(n * (d % 9) for d, n in report.items())) <= 24
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mix_report(docs.limit(0)).count() == 0


def test_the_query_equals_its_sql(spark):
    import duckdb

    from verdigris.llm import queries

    for data in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        sql = duckdb.connect()
        sql.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
        got = queries.op5_mixing(spark, data)
        want = sql.sql(queries.ORACLES["op5_mixing"])
        key = lambda rows: sorted(tuple(None if x is None else round(float(x), 6) for x in r) for r in rows)
        assert key(map(tuple, got.select(*want.columns).collect())) == key(want.fetchall())


def test_the_report_covers_copies_nulls_and_clashes_in_training_order(spark):
    text = "a b c d"
    rows = [(1, text, "x", 1), (1, text, "x", 2), (1, text, "x", 3), (2, None, "x", 1), (3, "", None, 1), (None, "q r", None, 1), (4, "one two three " * 2000, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(rows) and sum(r["doc_id"] == 1 for r in out) == 3
    assert all(r["taken"] <= 3 * r["size"] for r in out) and all((r["position"] is None) == (r["taken"] == 0) for r in out)
    at = [-1.0 if r["position"] is None else r["position"] for r in out]
    assert at == sorted(at) and mixing.mix_report(docs.limit(0)).count() == 0
    mixed = mixing.mix_documents(docs.selectExpr("*", "'m' as _mine", "'t' as _theirs", "'p' as _position"))
    assert {(r["_mine"], r["_theirs"], r["_position"]) for r in mixed.collect()} == {("m", "t", "p")}
