import pytest
from pyspark.sql import functions as F

from verdigris.functions import parsing, scoring


def parse(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


GOOD = '{"answer": "16", "citations": ["HR-009"], "abstain": false}'


@pytest.mark.parametrize(("said", "ok"), [
    (f"thinking\nFINAL: {GOOD}", True),
    (f"FINAL: {{}}\nFINAL: {GOOD}\nbye", True),
    (f"FINAL: {GOOD}\nFINAL: oops", False),
    ('FINAL: {"answer": 16, "citations": [], "abstain": false}', False),
    ('FINAL: {"answer": "16", "citations": [1], "abstain": false}', False),
    ('FINAL: {"answer": "16", "citations": [null], "abstain": false}', False),
    ('FINAL: {"answer": "16", "citations": [], "abstain": false, "more": 1}', False),
    ('FINAL: {"answer": "16", "abstain": false}', False),
    ('FINAL: {"answer": "", "citations": [], "abstain": true}', True),
    ("no line", False),
])
def test_final(spark, said, ok):
    assert (parse(spark, parsing.parse_final, said) is not None) is ok


def test_verdicts_drafts_and_markers(spark):
    assert parse(spark, parsing.parse_verdict, 'so {"correct": true, "faithful": false, "reason": "r"} ok')["faithful"] is False
    assert parse(spark, parsing.parse_verdict, '{"correct": "yes", "faithful": false, "reason": "r"}') is None
    assert [d["input"] for d in parse(spark, parsing.parse_drafts, 'x [{"input": "a", "gold_doc_ids": ["D"]}] y')] == ["a"]
    assert parse(spark, parsing.parse_drafts, "none") == []
    m = spark.range(1).select(parsing.marker(head_sha=F.lit("abc"), verdict=F.lit("block"), run_id=F.lit("r")).alias("m")).first()["m"]
    assert parse(spark, parsing.parse_marker, f"text {m} more")["verdict"] == "block" and parse(spark, parsing.parse_marker, "none") is None


@pytest.mark.parametrize(("cited", "gold", "precision", "recall"), [
    (["A"], ["A"], 1.0, 1.0),
    (["A", "X"], ["A"], 0.5, 1.0),
    (["A", "A"], ["A", "B"], 1.0, 0.5),
    ([], ["A"], None, 0.0),
    (["A"], [], 0.0, None),
    (["B"], ["A"], 0.0, 0.0),
])
def test_citations(spark, cited, gold, precision, recall):
    row = spark.createDataFrame([(cited, gold, ["A", "B"])], "c array<string>, g array<string>, k array<string>")
    got = row.select(parsing.citation_scores(F.col("c"), F.col("g"), F.col("k")).alias("x")).first()["x"]
    assert (got["precision"], got["recall"]) == (precision, recall)


# status, type, answer kind, match, recall, abstained, judge error, judge (correct, faithful), success
TRUTH = [
    ("ok", "lookup", "exact", True, 1.0, False, False, None, True),
    ("ok", "lookup", "exact", True, 0.5, False, False, None, True),
    ("ok", "lookup", "exact", True, 0.0, False, False, None, False),
    ("ok", "lookup", "exact", True, None, False, False, None, False),
    ("ok", "lookup", "exact", False, 1.0, False, False, None, False),
    ("ok", "lookup", "exact", True, 1.0, True, False, None, False),
    ("ok", "arithmetic", "numeric", True, 1.0, False, False, None, True),
    ("ok", "unanswerable", "abstain", False, None, True, False, None, True),
    ("ok", "unanswerable", "abstain", False, None, False, False, None, False),
    ("ok", "multi_hop", "free_text", False, 1.0, False, False, (True, True), True),
    ("ok", "multi_hop", "free_text", False, 1.0, False, False, (True, False), False),
    ("ok", "multi_hop", "free_text", False, 1.0, False, False, (False, True), False),
    ("ok", "multi_hop", "free_text", False, 0.0, False, False, (True, True), False),
    ("ok", "multi_hop", "free_text", False, 1.0, False, True, None, None),
    ("ok", "multi_hop", "free_text", False, 1.0, False, False, None, None),
    ("ok", "multi_hop", "free_text", False, 1.0, True, True, None, False),
    ("timeout", "multi_hop", "free_text", False, 1.0, False, True, None, False),
]


def test_success_truth_table(spark):
    kind = "status string, type string, answer_kind string, hit boolean, recall double, abstained boolean, judge_error boolean, judge struct<correct:boolean,faithful:boolean>, want boolean"
    rows = spark.createDataFrame(TRUTH, kind)
    got = rows.select("want", scoring.task_success(*(F.col(c) for c in ("status", "type", "answer_kind", "hit", "recall", "abstained", "judge_error", "judge"))).alias("x"))
    assert all(r["want"] is r["x"] for r in got.collect())


def test_cost_pays_default_for_unlisted_models(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 0), ("other", 0, 1_000_000)], "model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("default", 3.0, 4.0)], "model string, input double, output double")
    assert {r["model"]: r["cost_usd"] for r in scoring.priced(usage, prices).collect()} == {"m": 1.0, "other": 4.0}
    m = spark.range(1).select(scoring.cost_of_map(F.expr("map('m', named_struct('in', 1000000L, 'out', 0L), 'x', named_struct('in', 0L, 'out', 1000000L))"), {"m": (1.0, 2.0), "default": (3.0, 4.0)}).alias("c"))
    assert m.first()["c"] == 5.0
