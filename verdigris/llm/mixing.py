"""Mixing sources to target weights along a training curriculum.

Each source has a weight that changes linearly with training time t in [0, 1]: weight * (1 + slope * (2t - 1)). Its
integral, the cumulative token demand D(t) = target * (t + slope * (t*t - t)), says how much of the source has been used
by t. A source's documents, in an order set by a hash, lie one after another on its token axis, pass after pass; a document
that starts at token x of the axis is trained at the t with D(t) = x, found by inverting D. Sorting all documents by t mixes
the sources to their schedules.

Prefix sums along a source's axis are taken in three levels (documents in fine buckets, buckets in blocks, blocks),
so that no task holds more than a bounded part of a source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm.common import Scratch, free_names

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating; slopes of the schedules, likewise; most passes over a source.
WEIGHTS, SLOPES, MOST_PASSES = (1.0, 2.0, 3.0), (0.6, 0.0, -0.6), 3
#: Rounds that move each source nearer to its target by one pass over one document.
CORRECTIONS = 2
#: Columns of the plan from which the positions of a copy follow; copies that are told at once.
PLACE, COPIES = ["size", "source_size", "target", "slope", "start", "takes"], 4096
#: Rows in a fine bucket, and fine buckets in a block, on average.
BUCKET_ROWS, BLOCK_BUCKETS = 512, 512


def by_rank(rank: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """One row for each source of `sizes` (source, size): source_size, n_rows, weight, slope, target.

    Sources are ranked by code point, null last. The total of all sizes is shared by weight; a source's share stops at
    most_passes times its size and the excess goes to the others by weight, until no share is above. In closed form: with
    sources by ascending cap/weight, those capped are the first ones, up to the last whose cap is below its share of what the
    earlier caps leave. The table has one row a source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("rank", rank).withColumn("weight", by_rank(F.col("rank"), weights)).withColumn("slope", by_rank(F.col("rank"), SLOPES))
    s = s.withColumn("cap", F.lit(float(most_passes)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("weights_left")).withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    # the level that holds is that of the first source not capped
    s = s.withColumn("final", F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return s.select("source", "source_size", "n_rows", "weight", "slope", target.alias("target"))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, scratch: Scratch, key: Column, seed: int = 7, text: str = "text", source: str = "source") -> DataFrame:
    """For each distinct (key, source, size) of `docs`, a unit of so many `copies`: how often its copies are taken in all, and from where on.

    Columns key, source, size, copies, source_size, target, slope, start, takes. Each copy has a place of its own on the source's axis: copy i starts at start + i * size.
    A pass takes a copy if the middle of its span lies before the target, so each source's total differs from its target by half a document at most; then CORRECTIONS
    single documents that fit the rest are added or left out. Passes over the copies of a unit differ by one at most; no document is taken more than MOST_PASSES times.
    """
    sized = docs.select(key.alias("key"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    sized = sized.groupBy("key", "source", "size").agg(F.count("*").alias("copies"))
    # 52 bits of an MD5, as any SQL engine can take them
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("key").cast("string"), F.col("size").cast("string")).cast("binary"))
    sized = scratch.table(sized.withColumn("u", F.conv(F.substring(order, 1, 13), 16, 10).cast("long")))
    weighed = sized.withColumn("span", F.col("size") * F.col("copies"))
    targets = scratch.table(source_targets(weighed.select("source", F.col("span").alias("size"))))
    t = targets.alias("t")
    spread = F.col("u") / F.lit(float(1 << 52))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET_ROWS))
    rows = weighed.join(t, weighed["source"].eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    rows = rows.withColumn("bucket", F.floor(spread * buckets).cast("long")).withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS).cast("long"))
    fine = rows.groupBy("source", "block", "bucket").agg(F.sum("span").alias("total"))
    blocks = fine.groupBy("source", "block").agg(F.sum("total").alias("total"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("total").over(earlier(W.partitionBy("source").orderBy("block"))), F.lit(0)).alias("block_start"))
    fine = fine.select("source", "block", "bucket", F.coalesce(F.sum("total").over(earlier(W.partitionBy("source", "block").orderBy("bucket"))), F.lit(0)).alias("bucket_start"))
    starts = fine.alias("f").join(blocks.alias("b"), (F.col("f.block") == F.col("b.block")) & F.col("f.source").eqNullSafe(F.col("b.source")))
    starts = starts.select(F.col("f.source").alias("s_source"), F.col("f.bucket").alias("s_bucket"), (F.col("bucket_start") + F.col("block_start")).alias("start"))
    inside = F.coalesce(F.sum("span").over(earlier(W.partitionBy("source", "bucket").orderBy("u", "key", "size"))), F.lit(0))
    rows = rows.withColumn("inside", inside)
    rows = rows.join(starts, rows["source"].eqNullSafe(F.col("s_source")) & (rows["bucket"] == F.col("s_bucket")))
    rows = rows.withColumn("start", F.col("start") + F.col("inside"))
    # the k-th pass over copy i begins at start + i * size + k * source_size: the copies whose middle lies before the target are the first ones
    before = lambda k: F.floor((F.col("target") - F.col("start") - F.col("size") / 2.0 - k * F.col("source_size")) / F.col("size")).cast("long") + 1
    passes = [F.greatest(F.lit(0), F.least("copies", before(k))) for k in range(MOST_PASSES)]
    takes = F.when(F.col("size") > 0, sum(passes[1:], passes[0])).otherwise(F.lit(0))
    rows = rows.select("key", "source", "size", "copies", "u", "source_size", "target", "slope", "start", takes.alias("takes"))
    for _ in range(CORRECTIONS):
        last = scratch.table(rows)
        rows = corrected(last)
    scratch.keep(last)
    return rows.drop("u")


def positions(copy: Column) -> Column:
    """The training times, in [0, 1), of the passes over a copy (from 0) of a unit of `plan_mix`."""
    passes = F.expr("takes div copies") + (copy < F.col("takes") % F.col("copies")).cast("long")
    at = lambda k: F.col("start") + copy * F.col("size") + k * F.col("source_size")
    y = lambda k: F.least(at(k) / F.col("target"), F.lit(1.0))
    b = 1 - F.col("slope")
    # slope * t^2 + (1 - slope) * t = y, solved without cancellation
    invert = lambda k: 2 * y(k) / (b + F.sqrt(b * b + 4 * F.col("slope") * y(k)))
    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1)), F.lit(1), passes.cast("int")), invert)


def corrected(rows: DataFrame) -> DataFrame:
    """One pass more or less for the document of each source whose size is nearest to what the source lacks or has too much."""
    gap = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("takes"))).alias("gap"))
    gap = gap.select(F.col("source").alias("g_source"), "gap")
    each = rows.join(gap, rows["source"].eqNullSafe(gap["g_source"]))
    after = F.abs(F.abs("gap") - F.col("size"))
    able = (F.col("size") > 0) & (after < F.abs("gap")) & F.when(F.col("gap") > 0, F.col("takes") < MOST_PASSES * F.col("copies")).otherwise(F.col("takes") > 0)
    best = each.filter(able).groupBy("source").agg(F.min(F.struct(after.alias("after"), "u", "key", "size", F.signum("gap").cast("int").alias("change"))).alias("best"))
    best = best.select(F.col("source").alias("b_source"), F.col("best.key").alias("b_key"), F.col("best.size").alias("b_size"), "best.change")
    found = rows["source"].eqNullSafe(best["b_source"]) & rows["key"].eqNullSafe(best["b_key"]) & (rows["size"] == best["b_size"])
    return rows.join(best, found, "left").withColumn("takes", F.col("takes") + F.coalesce("change", F.lit(0))).select(*rows.columns)


def mix_documents(docs: DataFrame, key: str = "doc_id", seed: int = 7, text: str = "text", source: str = "source") -> DataFrame:
    """The columns of `docs`, a row for each pass that takes the document, sorted by training position across partitions.

    Rows that agree in key, source and text are copies: each has a place of its own, so their passes differ by one at most (which of them has one more is
    settled by their order in the input). Documents without words (null and empty texts too) are never taken. A null source is a source of its own; null keys
    are allowed. An empty table gives an empty result. Texts are counted whole and shuffled once to meet their positions and once for the order.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = F.concat_ws("/", F.xxhash64(F.col(key), F.col(source), F.col(text)), F.xxhash64(F.col(text), F.lit(1), F.col(source), F.col(key)))
    mine, theirs, unit, position, part, at, copy, same = free_names(docs, "mine", "theirs", "unit", "position", "part", "at", "copy", "same")
    plan = scratch.table(plan_mix(docs, scratch, own, seed, text, source).filter("takes > 0").select(F.col("key").alias(theirs), "copies", *PLACE))
    scratch.keep(plan)
    once = plan.filter("copies = 1").select(theirs, positions(F.lit(0)).alias(unit))
    rows = docs.withColumn(mine, own).join(once, F.col(mine) == F.col(theirs))
    again = plan.filter("copies > 1").select(theirs)
    if not again.isEmpty():
        # copies are numbered within each part of the input, then from part to part: no task meets more copies than its part has
        tagged = docs.withColumns({mine: own, part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
        tagged = scratch.table(tagged.join(again, F.col(mine) == F.col(theirs), "left_semi"))
        counts = tagged.groupBy(mine, part).agg(F.count("*").alias(copy))
        before = F.sum(copy).over(W.partitionBy(mine).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
        counts = counts.select(F.col(mine).alias(theirs), F.col(part).alias(same), F.coalesce(before, F.lit(0)).alias(copy))
        local = F.row_number().over(W.partitionBy(mine, part).orderBy(at)) - 1
        numbered = tagged.withColumn(at, local).join(counts, (F.col(mine) == F.col(theirs)) & (F.col(part) == F.col(same)))
        numbered = numbered.select(*docs.columns, mine, (F.col(copy) + F.col(at)).alias(copy))
        # the plan's columns come in one struct, as they may clash with those of the documents
        named = plan.filter("copies > 1").select(F.col(theirs), F.struct("copies", *PLACE).alias(unit))
        met = numbered.join(named, F.col(mine) == F.col(theirs)).select(F.struct(*docs.columns).alias("d"), F.col(copy).alias("i"), f"{unit}.*")
        rows = rows.select(*docs.columns, unit).unionByName(met.withColumn("p", positions(F.col("i"))).select("d.*", F.col("p").alias(unit)))
    rows = rows.select(*docs.columns, F.explode(unit).alias(position))
    return in_order(rows.withColumn(mine, own), position, mine).select(*docs.columns)


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Rows sorted across and within partitions, whose number stays."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by)


def mix_report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Each document's doc_id, size, source_size, target, taken and position (the training time of its first pass, to 9 digits; null if it is not taken), in the order of training.

    Rows alike in doc_id, source and size are copies, each with a place of its own: their passes differ by one at most. Null and empty texts have size 0 and are
    never taken; a null source is one of its own, ranked last; null ids are allowed, and alike only with each other; ties in the hash go by id and size; other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    plan = scratch.table(plan_mix(docs, scratch, F.col("doc_id"), seed).select("key", "copies", *PLACE))
    scratch.keep(plan)
    # copies are told one by one, by blocks, so that a unit of very many is no single task's
    blocks = plan.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    one, many = blocks.filter("copies = 1"), blocks.filter("copies > 1").repartition("key", "size", "block")
    told = one.unionByName(many).withColumn("i", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)))
    told = told.withColumn("p", positions(F.col("i")))
    made = told.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("p")).alias("taken"), F.round(F.get("p", F.lit(0)), 9).alias("position"))
    return in_order(made, "position", "doc_id")
