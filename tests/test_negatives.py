import pytest
from pyspark.sql import functions as F

from verdigris.operators import judging, negatives

KIND = "example_id string, reference string, answer string, citations array<string>, synthetic string"


def by_hand(rows, key, partners, name, serves, seed):
    """Every row's sequence, walked one partner after the other."""
    import hashlib

    order = sorted(partners, key=lambda p: p[name])
    m, out = 1 << max(len(order) - 1, 0).bit_length(), {}
    for row in rows:
        digest = hashlib.md5(f"{seed}-{row[key]}".encode()).hexdigest()
        start, step = int(digest[:7], 16), 2 * int(digest[7:14], 16) + 1
        for r in range(m):
            k = (start + r * step) % m
            if k < len(order) and serves(row, order[k]):
                out[row[key]] = order[k][name]
                break
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 37, 300])
def test_first_that_serves_is_drawn(spark, n):
    rows, partners = [{"e": f"e{i}", "x": i} for i in range(60)], [{"p": f"p{i:04d}", "y": i % 50} for i in range(n)]
    left, right = spark.createDataFrame([(r["e"], r["x"]) for r in rows] + [(None, 1)], "e string, x int"), spark.createDataFrame([(p["p"], p["y"]) for p in partners] + [(None, 49)], "p string, y int")
    got = {r["e"]: r["p"] for r in negatives.drawn(left, "e", right, "p", F.col("y") > F.col("x"), 3).collect()}
    # high x are served by few partners, x from 49 on by none, so all rounds are needed
    assert got == by_hand(rows, "e", partners, "p", lambda r, p: p["y"] > r["x"], 3)


def test_hopeless_rows_and_nulls(spark):
    docs = spark.createDataFrame([(f"HR-{i:03d}", f"it is 5 or {i + 10}", f"it is 5 or {i + 10}") for i in range(40)], "id string, text string, body string")
    rows = spark.createDataFrame([("a", "", "5 days", [], None), ("b", "", "12 days", ["HR-001"], None), ("c", "", None, [], None), ("d", "", "no number", None, None), ("e", "", "no number", [], None)], KIND)
    got = {r["example_id"]: r["citations"][0] for r in judging.corrupted(rows, docs, "wrong_citation", "", 1).collect()}
    # all documents hold a 5; without an answer or a list of citations nothing is known to be wrong
    assert set(got) == {"b~wrong_citation", "e~wrong_citation"} and got["b~wrong_citation"] not in ("HR-001", "HR-002")
    some = docs.union(spark.createDataFrame([("HR-900", "none", "none")], docs.schema))
    again = {r["example_id"]: r["citations"][0] for r in judging.corrupted(rows, some, "wrong_citation", "", 1).collect()}
    assert again["a~wrong_citation"] == "HR-900"


def test_no_broadcast_of_partners(spark):
    docs = spark.createDataFrame([(f"HR-{i:03d}", f"line {i}", f"line {i}\nline two {i}") for i in range(40)], "id string, text string, body string")
    rows = spark.createDataFrame([(f"a{i}", "", "5 days", ["HR-001"], None) for i in range(20)], KIND)
    made = judging.corrupted(rows, docs, "unsupported_claim", "Acme", 1)
    plan = made._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert made.count() == 20 and made.filter(F.col("answer").contains("line 1 ")).count() == 0


def test_texts_that_many_rows_cite_are_not_repeated_or_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "SENT_ROWS", 10)
    long = "much cited text " * 4000
    docs = spark.createDataFrame([(f"HR-{i:03d}", f"{long}{i}", f"line {i}\nline two {i}") for i in range(3)], "id string, text string, body string")
    rows = spark.range(2000).selectExpr("concat('a', id) as example_id", "'' as reference", "'5 days' as answer", "array('HR-001') as citations", "cast(null as string) as synthetic")
    seen, table = [], negatives.Scratch.table

    def kept(self, df):
        seen.append(df)
        return table(self, df)

    monkeypatch.setattr(negatives.Scratch, "table", kept)
    made = judging.corrupted(rows, docs, "unsupported_claim", "Acme", 1)
    assert made.count() == 2000 and made.filter(F.col("answer").contains("line 1")).count() == 0
    # tables by example hold no text of 64 KB a row, and no plan sends rows to all tasks, but for counts of partitions
    assert not [df for df in seen if "example_id" in df.columns and "_cited" in df.columns]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*seen, made]]
    assert all("BroadcastHashJoin [example_id" not in p and "BroadcastHashJoin [citations" not in p and "BroadcastHashJoin [_number" not in p for p in plans)
