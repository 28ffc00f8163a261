import random

from pyspark.sql import functions as F

from verdigris.llm import mil


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(8)
    words = ["thing", "reason", "other", "house", "And", "the", "of"]
    good = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    bad = lambda n: " ".join(r.choice(words).upper() + r.choice(["!!", "###", "$$"]) for _ in range(n))
    rows = [(i, (good if i % 3 else bad)(r.randrange(5, 400)), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").selectExpr("doc_id", "text", "'z' as score", "y")
    labels = docs.select("doc_id", F.col("y").alias("quality"))
    training = mil.training_rows(docs, labels)
    assert training.filter(mil.held_out(F.col("doc_id"))).count() == 0 and mil.training_rows(docs, labels, most=50).count() == 50
    model = mil.fit_quality(training)
    out = mil.score_quality(docs, model).filter(mil.held_out(F.col("doc_id"))).collect()
    assert len(out) > 100 and sum((x["score"] >= mil.PREDICT_FROM) == bool(x["y"]) for x in out) >= 0.97 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "x" * 200000), (5, "word " * 50000), (None, "a b"), (None, "a b")], "doc_id long, text string")
    got = [x["score"] for x in mil.score_quality(odd, model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for s in got) and mil.score_quality(odd.limit(0), model).count() == 0
    again = mil.fit_quality(training.repartition(5))
    assert [x["score"] for x in mil.score_quality(odd, again).collect()] == got


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = mil.fit_quality(empty)
    assert mil.score_quality(empty.select("doc_id", "text"), model).count() == 0
