"""Explicit schemas of all tables, and the rules of authored tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations, shares and sizes of task sets.
TYPES = ("lookup", "multi_hop", "arithmetic", "conflicting", "unanswerable")
ANSWER_KINDS = ("exact", "numeric", "free_text", "abstain")
SPLITS = ("gate", "calibration", "dev")
SHARES = {"lookup": 0.30, "multi_hop": 0.25, "arithmetic": 0.15, "conflicting": 0.15, "unanswerable": 0.15}
SIZES = {"gate": 300, "calibration": 120, "dev": 100}

TASK = "id string, input string, reference string, gold_doc_ids array<string>, type string, answer_kind string, tags array<string>, split string"
SPOT_CHECK = "split string, task_id string, verdict string, note string"
DOC = "id string, title string, kind string, effective_date string, supersedes string, text string, body string"
FACT = "doc_id string, ord int, key string, value string, text string"
MESSAGE = "sample_id string, epoch int, ord int, role string, text string, tool_calls array<struct<function:string,arguments:map<string,string>>>"
OUTCOME = "sample_id string, epoch int, error string, limit_type string, completion string, usage map<string,struct<in:bigint,out:bigint>>, total_time double"
RESULT = (
    "run_id string, variant string, task_id string, repeat int, status string, answer string, citations array<string>, abstain boolean, "
    "scores struct<answer_match:boolean,gold_retrieval:boolean,citation_precision:double,citation_recall:double,abstention:boolean,"
    "judge:struct<correct:boolean,faithful:boolean,reason:string>,judge_error:boolean>, success boolean, latency_s double, "
    "tokens_in bigint, tokens_out bigint, cost_usd double, trace_id string"
)
EXAMPLE = "example_id string, task_id string, variant string, repeat int, type string, input string, reference string, answer string, citations array<string>, synthetic string"
KEY = "example_id string, judge_pass boolean, correct boolean, faithful boolean, reason string"
LABEL = "example_id string, task_id string, variant string, human_label string, labeler string, note string"
PERTURBED = "example_id string, x double, judge_pass boolean"
PRICE = "model string, input double, output double"


def task_violations() -> Column:
    """Messages of the rules that a task row breaks."""
    t, kind, gold, ref = F.col("type"), F.col("answer_kind"), F.col("gold_doc_ids"), F.col("reference")
    n_gold = F.coalesce(F.size(gold), F.lit(0))
    open_ended = t == "unanswerable"
    rules = {
        "unknown type": ~t.isin(*TYPES),
        "unknown answer kind": ~kind.isin(*ANSWER_KINDS),
        "unknown split": ~F.col("split").isin(*SPLITS),
        "unanswerable and abstain go together": open_ended != (kind == "abstain"),
        "unanswerable tasks have no reference and no gold documents": open_ended & (ref.isNotNull() | (n_gold > 0)),
        "answerable tasks need a reference and a gold document": ~open_ended & ((F.coalesce(ref, F.lit("")) == "") | (n_gold == 0)),
        "arithmetic tasks are numeric": (t == "arithmetic") & (kind != "numeric"),
        "conflicting tasks have one gold document": (t == "conflicting") & (n_gold != 1),
        "missing field": F.col("id").isNull() | F.col("input").isNull() | t.isNull() | kind.isNull() | F.col("split").isNull() | gold.isNull() | F.col("tags").isNull(),
    }
    return F.filter(F.array(*(F.when(broken, F.lit(m)) for m, broken in rules.items())), lambda x: x.isNotNull())


SIZES_SPEC = re.compile(r"\s*(?:(\w+)\s*=\s*0*([1-9][0-9]*)\s*)?(?:,|$)")


def parse_split_sizes(spec: str) -> dict[str, int]:
    """`gate=150,dev=50` over the default sizes; empty parts are skipped."""
    given, at = {}, 0
    while at < len(spec):
        part = SIZES_SPEC.match(spec, at)
        if not part or part[1] not in (None, *SIZES):
            raise ValueError(f"not a split size: {spec[at:]!r}")
        given |= {part[1]: int(part[2])} if part[1] else {}
        at = part.end()
    return SIZES | given
