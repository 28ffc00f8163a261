"""Scores of a sample: status, three-valued success, cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import parsing, text


def sample_status(error: Column, limit: Column, tool_calls: Column, final: Column, most_calls: int) -> Column:
    """First that applies: error, timeout, limit, format_error, ok."""
    return (
        F.when(error.isNotNull(), "error")
        .when(limit.isin("time", "working"), "timeout")
        .when(limit.isNotNull() | (tool_calls > most_calls), "limit")
        .when(final.isNull(), "format_error")
        .otherwise("ok")
    )


def task_success(status: Column, kind: Column, answer_kind: Column, answer_match: Column, recall: Column, abstained: Column, judge_error: Column, judge: Column) -> Column:
    """True, false, or null where only the judge could tell and it failed."""
    judged = judge["correct"] & judge["faithful"]
    right = F.when(answer_kind == "free_text", judged).otherwise(answer_match)
    return (
        F.when(status != "ok", F.lit(False))
        .when(kind == "unanswerable", abstained)
        .when(abstained, F.lit(False))
        .when((answer_kind == "free_text") & (F.coalesce(judge_error, F.lit(False)) | judge.isNull()), F.lit(None).cast("boolean"))
        .otherwise(right & (F.coalesce(recall, F.lit(0.0)) > 0))
    )


def priced(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """usage (model, tokens_in, tokens_out) with cost_usd; unlisted models pay the `default` row, or nothing."""
    fallback = prices.filter(F.col("model") == "default").agg(F.max("input").alias("d_in"), F.max("output").alias("d_out"))
    listed = prices.select(F.col("model").alias("_m"), "input", "output")
    rows = usage.join(listed, usage[model] == F.col("_m"), "left").crossJoin(F.broadcast(fallback))  # one row
    pay = lambda a, b: F.coalesce(F.col(a), F.col(b), F.lit(0.0))
    cost = (F.col("tokens_in") * pay("input", "d_in") + F.col("tokens_out") * pay("output", "d_out")) / 1_000_000
    return rows.withColumn("cost_usd", cost).drop("_m", "input", "output", "d_in", "d_out")


def cost_of_map(usage: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost of a map model -> struct(in, out), with a small price list."""
    default = prices.get("default", (0.0, 0.0))
    table = F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, list(p))]) if prices else F.create_map(F.lit("default"), F.lit([0.0, 0.0]))
    price = lambda m: F.coalesce(F.try_element_at(table, m), F.lit(list(default)))
    each = F.transform(F.map_entries(usage), lambda e: (e["value"]["in"] * price(e["key"])[0] + e["value"]["out"] * price(e["key"])[1]) / 1_000_000)
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


#: name -> expression over a row of samples; add to it to score more.
Scorer = Callable[[], Column]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str):
    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


def score(samples: DataFrame, *names: str) -> DataFrame:
    """samples with a column for each registered scorer (all, unless named)."""
    return samples.withColumns({n: SCORERS[n]() for n in names or SCORERS})


@scorer("answer_match")
def answer_match() -> Column:
    """Whether the final answer matches the reference; abstaining never does."""
    return F.coalesce(text.match_answer(F.col("final.answer"), F.col("reference"), F.col("answer_kind")), F.lit(False)) & ~F.coalesce(F.col("final.abstain"), F.lit(False))


@scorer("gold_retrieval")
def gold_retrieval() -> Column:
    """Whether a gold document was fetched."""
    return F.arrays_overlap(parsing.fetched_documents(F.col("messages")), F.col("gold_doc_ids"))


@scorer("citations_scored")
def citations_scored() -> Column:
    """Precision and recall of the citations; `corpus` holds the known ids."""
    return parsing.citation_scores(F.coalesce(F.col("final.citations"), F.array().cast("array<string>")), F.col("gold_doc_ids"), F.col("corpus"))


@scorer("abstention")
def abstention() -> Column:
    return F.coalesce(F.col("final.abstain"), F.lit(False))


@scorer("to_judge")
def to_judge() -> Column:
    """Whether only a judge can tell: free text, parsed, not abstaining."""
    return (F.col("answer_kind") == "free_text") & F.col("final").isNotNull() & ~F.coalesce(F.col("final.abstain"), F.lit(False))
