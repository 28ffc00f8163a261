import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from verdigris.functions import calculator, text


def one(spark, column, **values):
    kinds = {k: "array<string>" if isinstance(v, list) else "string" for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("answer", "reference", "kind", "want"), [
    ("$1,340 per month", "1340", "numeric", True),
    ("about 16.05", "16", "numeric", True),
    ("16.2", "16", "numeric", False),
    ("none", "16", "numeric", False),
    ("0.005", "0", "numeric", True),
    ("0.02", "0", "numeric", False),
    ("€2,000.50", "2000.5 EUR", "numeric", True),
    ("HR-009", "-9", "numeric", True),
    ("Priya  Natarajan.", "priya natarajan", "exact", True),
    ("STRASSE", "straße", "exact", True),
    ("other", "one", "exact", False),
    ("x", "x", "free_text", False),
])
def test_match_answer(spark, answer, reference, kind, want):
    assert one(spark, text.match_answer(F.col("a"), F.col("r"), F.col("k")), a=answer, r=reference, k=kind) is want


def test_facts_signature_and_length(spark):
    assert one(spark, text.facts_signature(F.col("t")), t="HR-009 gives 16 weeks and 1,340 USD") == ["1340", "16", "HR-009"]
    assert one(spark, text.length_x(F.col("a"), F.col("b")), a="x" * 15, b="x" * 10) == pytest.approx(1.0)
    assert one(spark, text.kind_of(F.col("d")), d="PRC-001") == "pricing"
    assert one(spark, text.model_family(F.col("m")), m="vendor/Claude-sonnet-4") == "claude"
    assert one(spark, text.fact_sentences(F.col("b"), ["#", "Acme"]), b="# Title\n\nAcme policy.\n  A fact. \nOther") == ["A fact.", "Other"]
    assert one(spark, text.bar(F.col("v").cast("double")), v="0.999") == "█" * 19 + "░"


def test_normalize_agrees_with_python(spark):
    r = random.Random(1)
    alphabet = "aAbB zZ09_.,!-\t\nÉéñß世界  ‘"
    rows = [("".join(r.choice(alphabet) for _ in range(r.randrange(0, 30))),) for _ in range(500)]
    got = spark.createDataFrame(rows, "t string").select("t", text.normalize(F.col("t")).alias("n"), text.shingles(F.col("t")).alias("s")).collect()
    for g in got:
        assert g["n"] == " ".join(re.sub(r"[^\w\s]", "", g["t"].lower()).split())
        t = g["t"]
        assert set(g["s"]) == ({t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t}) and len(g["s"]) == len(set(g["s"]))
    assert unicodedata.category("é") == "Ll"


@pytest.mark.parametrize(("expr", "want"), [("1 + 2 * 3", "7"), ("-(2 ** 3) / 4", "-2"), ("7 // 2 + 7 % 4", "6"), ("1/3", "0.3333333333"), ("2.50", "2.5"), ("1e3", "1000"), (" ( 1 ) ", "1")])
def test_calculator_answers(expr, want):
    assert calculator.answer(expr) == want


@pytest.mark.parametrize("expr", ["1/0", "2**101", "10**16", "abs(1)", "x", "1 if 1 else 2", "True", "'a'", "[1]", "1 +", "", "1j", "(-8)**0.5", "1" * 501, "+1", "9e999"])
def test_calculator_refuses(expr):
    assert calculator.answer(expr).startswith("error: ")


def test_calculator_column(spark):
    rows = spark.createDataFrame([("1+1",), ("a",), (None,)], "e string").select(calculator.calculate(F.col("e")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["2", "error: unsupported element: Name", None]
