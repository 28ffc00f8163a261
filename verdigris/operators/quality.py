"""Checks of task sets: one long table of violations (rule, key, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.functions.text import normalize
from verdigris.operators.numbering import placed
from verdigris.operators.similarity import near_duplicates
from verdigris.operators.statistics import wilson
from verdigris.sources import schemas


def quota(share, size: int):
    """Round half to even."""
    return F.bround(share * size).cast("long")


def mix_report(rows: DataFrame, by: str, shares: dict[str, float], size: int, tolerance: int = 0) -> DataFrame:
    """by, have, want, off for every expected value, those without rows too."""
    spine = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"`{by}` string, share double")
    have = rows.groupBy(by).agg(F.count("*").alias("have"))
    out = spine.join(have, by, "left").select(by, F.coalesce("have", F.lit(0)).alias("have"), quota(F.col("share"), size).alias("want"))
    return out.withColumn("off", F.abs(F.col("have") - F.col("want")) > tolerance)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; null keys are orphans."""
    return rows.join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def check_tasks(tasks: DataFrame, docs: DataFrame, sizes: dict[str, int] | None = None, tolerance: int = 0) -> DataFrame:
    """All violations of a task table: rules, gold documents, ids across splits, mix, near-duplicates of gate tasks in other splits."""
    say = lambda df, rule, key, message: df.select(F.lit(rule).alias("rule"), key.alias("key"), message.alias("message"))
    rules = say(tasks.select("id", F.explode(schemas.task_violations()).alias("m")), "schema", F.col("id"), F.col("m"))
    gold = tasks.select("id", F.explode("gold_doc_ids").alias("gold"))
    missing = say(orphans(gold, "gold", docs, "id"), "gold", F.col("id"), F.concat(F.lit("no document "), "gold"))
    twice = say(duplicates(tasks, "id"), "id", F.col("id"), F.concat(F.col("n").cast("string"), F.lit(" rows")))
    out = rules.unionByName(missing).unionByName(twice)
    for split, size in (sizes or schemas.SIZES).items():
        mix = mix_report(tasks.filter(F.col("split") == split), "type", schemas.SHARES, size, tolerance).filter("off")
        out = out.unionByName(say(mix, "mix", F.concat(F.lit(f"{split}/"), "type"), F.concat(F.col("have").cast("string"), F.lit(" of "), F.col("want").cast("string"))))
    near = near_duplicates(tasks.filter("split = 'gate'"), tasks.filter("split in ('dev', 'calibration')"), "id", "input")
    return out.unionByName(say(near, "near-duplicate", F.concat_ws("/", "a", "b"), F.round("jaccard", 3).cast("string")))


def noise_floor(verdicts: DataFrame) -> DataFrame:
    """split, n, rate, lo, hi: share of spot-checked rows that were not fine, with its Wilson interval."""
    s = verdicts.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != "ok").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return s.select("split", "n", (F.col("k") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def numbered(rows: DataFrame, order: str, prefix: str, start: int) -> DataFrame:
    """rows with id `prefix-0001` and so on in ascending order of a unique column, after the first `start` numbers."""
    number = F.col("_k") + 1 + start
    return placed(rows, order).withColumn("id", F.format_string("%s-%04d", F.lit(prefix), number)).drop("_k", "_total")


def accept_drafts(drafts: DataFrame, docs: DataFrame, in_force: DataFrame, taken: DataFrame, split: str, prefix: str, want: dict[str, int]) -> DataFrame:
    """Drafts (ord, type, input, reference, gold_doc_ids, answer_kind) that become tasks: known gold, conflicting ones with a single document in force,
    a new normalised input, valid, and the first `want` of each type; numbered after those of `taken`."""
    rows = drafts.withColumn("split", F.lit(split)).withColumn("gold_doc_ids", F.coalesce("gold_doc_ids", F.array().cast("array<string>"))).withColumn("norm", normalize(F.coalesce("input", F.lit(""))))
    gold = rows.select("ord", F.explode("gold_doc_ids").alias("g"))
    kinds = gold.join(docs.select(F.col("id").alias("g"), "kind"), "g", "left").groupBy("ord").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_if(F.col("kind").isNull()).alias("unknown"))
    live = gold.join(in_force.select(F.col("id").alias("g")).distinct(), "g", "left_semi").groupBy("ord").agg(F.count("*").alias("live"))
    rows = rows.join(kinds, "ord", "left").join(live, "ord", "left").filter((F.coalesce("unknown", F.lit(0)) == 0) & (F.col("norm") != ""))
    rows = rows.filter((F.col("type") != "conflicting") | ((F.size("gold_doc_ids") == 1) & (F.col("live") == 1)))
    rows = rows.join(taken.select(normalize(F.col("input")).alias("norm")).distinct(), "norm", "left_anti")
    rows = rows.withColumn("tags", F.concat(F.array("type"), F.coalesce("kinds", F.array().cast("array<string>")))).withColumn("id", F.lit(""))
    rows = rows.filter(F.size(schemas.task_violations()) == 0)
    first = F.row_number().over(W.partitionBy("norm").orderBy("ord"))
    rows = rows.withColumn("_f", first).filter("_f = 1")
    limit = F.create_map(*[F.lit(x) for kv in want.items() for x in kv])
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("type").orderBy("ord"))).filter(F.col("_n") <= F.coalesce(F.element_at(limit, F.col("type")), F.lit(0)))
    return numbered(rows, "ord", prefix, taken.count()).select("id", "input", "reference", "gold_doc_ids", "type", "answer_kind", "tags", "split")


def spot_check(tasks: DataFrame, verdicts: DataFrame, fixes: DataFrame, split: str, want: dict[str, int]) -> DataFrame:
    """Tasks after a human check: dropped ones go, fixed ones (same id, TASK columns) replace theirs, the first `want` of each type stay."""
    bad = verdicts.filter((F.col("split") == split) & (F.col("verdict") == "dropped")).select(F.col("task_id").alias("id"))
    left = tasks.join(bad, "id", "left_anti").join(fixes.select("id"), "id", "left_anti").unionByName(fixes.join(tasks.select("id"), "id", "left_semi"))
    limit = F.create_map(*[F.lit(x) for kv in want.items() for x in kv])
    return left.withColumn("_n", F.row_number().over(W.partitionBy("type").orderBy("id"))).filter(F.col("_n") <= F.coalesce(F.element_at(limit, F.col("type")), F.lit(0))).drop("_n")
