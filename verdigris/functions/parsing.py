"""Transcript parsing: strict JSON, citations, tool calls, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINAL_SHAPE = r"^OBJECT<abstain: BOOLEAN, answer: STRING, citations: ARRAY<(STRING|VOID)>>$"
VERDICT_SHAPE = r"^OBJECT<correct: BOOLEAN, faithful: BOOLEAN, reason: STRING>$"
FINAL_TYPE = "answer string, citations array<string>, abstain boolean"
VERDICT_TYPE = "correct boolean, faithful boolean, reason string"
DRAFT_TYPE = "array<struct<input:string,reference:string,gold_doc_ids:array<string>,answer_kind:string>>"
MARKER = r"<!-- eval-gate:v1 (\{.*?\}) -->"


def strict(json: Column, shape: str, schema: str) -> Column:
    """The parsed object, or null unless keys and types are exactly those of `shape`."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(kind.rlike(shape), F.from_json(json, schema))


def final_line(text: Column) -> Column:
    """What follows the marker on the last line that begins with FINAL:, trimmed; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("FINAL:")))
    return F.trim(F.substr(F.get(F.reverse(lines), F.lit(0)), F.lit(7)))


def parse_final(text: Column) -> Column:
    """answer, citations, abstain of the last FINAL line; null if that line is invalid, whatever stands before it."""
    out = strict(final_line(text), FINAL_SHAPE, FINAL_TYPE)
    return F.when(F.forall(out["citations"], lambda c: c.isNotNull()), out)


def parse_verdict(text: Column) -> Column:
    """correct, faithful, reason of the outermost braces."""
    return strict(F.regexp_extract(text, r"(?s)\{.*\}", 0), VERDICT_SHAPE, VERDICT_TYPE)


def parse_drafts(text: Column) -> Column:
    """Objects of the outermost brackets; an empty array if they hold none."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), DRAFT_TYPE)
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast(DRAFT_TYPE))


def marker(**fields: Column) -> Column:
    return F.concat(F.lit("<!-- eval-gate:v1 "), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))), F.lit(" -->"))


def parse_marker(body: Column, schema: str = "head_sha string, verdict string, run_id string") -> Column:
    found = F.regexp_extract(body, MARKER, 1)
    return F.when(found != "", F.from_json(found, schema))


def citation_scores(cited: Column, gold: Column, corpus: Column) -> Column:
    """precision and recall of cited documents; null for an empty denominator. Unknown ids count as cited but never as hits."""
    cited, gold = F.array_distinct(cited), F.array_distinct(gold)
    hits = F.size(F.array_intersect(F.array_intersect(cited, gold), corpus))
    over = lambda n: F.when(n > 0, hits / n)
    return F.struct(over(F.size(cited)).alias("precision"), over(F.size(gold)).alias("recall"))


def fetched_documents(messages: Column) -> Column:
    """Ids that get_doc calls asked for, each once."""
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<function:string,arguments:map<string,string>>>"))))
    ids = F.transform(F.filter(calls, lambda c: c["function"] == "get_doc"), lambda c: c["arguments"]["doc_id"])
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))


def tool_messages(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == "tool"))


def judge_prompt(rubric: Column, question: Column, reference: Column, answer: Column, cited: Column) -> Column:
    """Blocks that a judge reads; `cited` holds the texts of valid cited documents, in citation order."""
    docs = F.when(F.size(cited) > 0, F.array_join(cited, "\n\n")).otherwise(F.lit("(no valid cited documents)"))
    block = lambda tag, x: F.concat(F.lit(f"<{tag}>\n"), F.coalesce(x, F.lit("")), F.lit(f"\n</{tag}>"))
    return F.concat_ws("\n\n", rubric, block("question", question), block("reference", reference), block("answer", answer), block("documents", docs))
