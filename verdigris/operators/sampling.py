"""Seeded sampling with exact counts, by hash order instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.sources.scratch import Scratch

#: Hexadecimal digits of the hash that one histogram resolves; rows that may share what is known of the last hash taken before they are ranked one by one; cells whose
#: state is sent to all tasks.
DIGITS, RANKED, SENT_CELLS = 3, 65_536, 10_000


def hash_order(seed: int, *keys: str) -> Column:
    """A portable pseudo-random order: MD5 of the seed and the keys."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def first_by_hash(rows: DataFrame, take: DataFrame, cells: list[str], seed: int, key: str) -> DataFrame:
    """Of each cell the rows that come first by hash_order and key, as many as `take` (cells..., _take) says; no row of a cell that it does not name.

    The hash of the last row to take is found by histograms: each pass counts the rows of a cell that agree with what is known of that hash by their next
    digits, over all tasks, until so few agree that they are ranked one by one. Everything before is taken by a filter, so no task sorts a cell.
    """
    scratch = Scratch(rows.sparkSession, "select")
    names = [f"_c{i}" for i in range(len(cells))]
    hashed = rows.withColumn("_h", hash_order(seed, key))
    same = F.lit(True)
    for c, n in zip(cells, names):
        same = same & hashed[c].eqNullSafe(F.col(n))

    def met(state: DataFrame) -> DataFrame:
        return hashed.join(F.broadcast(state) if state.count() <= SENT_CELLS else state, same)

    state = scratch.table(take.filter("_take > 0").select(*(F.col(c).alias(n) for c, n in zip(cells, names)), F.lit("").alias("_known"), F.col("_take").cast("long").alias("_left"), F.lit(1 << 62).alias("_size")))
    digits = 0
    while digits < 32 and (state.agg(F.max("_size")).head()[0] or 0) > RANKED:
        here, digits = digits, min(digits + DIGITS, 32)
        alike = met(state).filter(F.substring("_h", 1, here) == F.col("_known")) if here else met(state)
        bins = alike.groupBy(*names, "_left", F.substring("_h", 1, digits).alias("_known")).agg(F.count("*").alias("_size"))
        upto = F.sum("_size").over(W.partitionBy(*names).orderBy("_known") if names else W.orderBy("_known"))
        # the bin in which the last row lies; where there are fewer rows than asked for, the last bin, of which all are taken
        last = F.row_number().over((W.partitionBy(*names) if names else W.partitionBy(F.lit(0))).orderBy(F.col("_known").desc())) == 1
        bins = bins.withColumn("_upto", upto).withColumn("_last", last).filter((F.col("_upto") - F.col("_size") < F.col("_left")) & ((F.col("_upto") >= F.col("_left")) | F.col("_last")))
        state = scratch.table(bins.select(*names, "_known", (F.col("_left") - F.col("_upto") + F.col("_size")).alias("_left"), "_size"))
    chosen = met(state)
    known = F.substring("_h", 1, digits)
    before = chosen.filter(known < F.col("_known"))
    rank = F.row_number().over(W.partitionBy(*names, "_known").orderBy("_h", key))
    at = chosen.filter(known == F.col("_known")).withColumn("_rank", rank).filter("_rank <= _left")
    return before.select(*rows.columns).unionByName(at.select(*rows.columns))


def sample(rows: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """Exactly round-half-even(share * count) rows, those first by hash."""
    n = round(share * rows.count())
    return first_by_hash(rows, rows.sparkSession.createDataFrame([(n,)], "_take long"), [], seed, key)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(hash_order(seed, *keys), *keys)


def first_per(rows: DataFrame, by: str, order: list, n) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def allocate(sizes: dict[tuple, int], n: int, least: int) -> dict[tuple, int]:
    """Rows to take from each cell: in proportion (half-even), at least `least` where there are as many, then moved by ones from the largest allocations or to the
    cells with most left until the total is n."""
    total = sum(sizes.values())
    n = min(n, total)
    floor = {c: min(least, s) for c, s in sizes.items()}
    if sum(floor.values()) > n:
        raise ValueError("the least sizes of the cells add up to more than the sample")
    out = {c: min(s, max(least, round(n * s / total))) for c, s in sizes.items()}
    step = sum(out.values()) - n
    while step:
        if step > 0:
            pick = max((c for c in out if out[c] > floor[c]), key=out.__getitem__)
            out[pick] -= 1
            step -= 1
        else:
            pick = max((c for c in out if out[c] < sizes[c]), key=lambda c: sizes[c] - out[c])
            out[pick] += 1
            step += 1
    return out


def stratified_sample(rows: DataFrame, cells: list[str], n: int, least: int, seed: int, key: str) -> DataFrame:
    """n rows over the cells: sizes are counted in Spark, allocated on the driver (a number for each cell), and drawn by hash order without sorting a cell."""
    sizes = {tuple(r[c] for c in cells): r["n"] for r in rows.groupBy(*cells).agg(F.count("*").alias("n")).orderBy(*cells).collect()}
    plan = [(*c, k) for c, k in allocate(sizes, n, least).items()] if sizes else []
    spark = rows.sparkSession
    schema = ", ".join(f"`_c{i}` {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(cells)) + ", _take long"
    take = spark.createDataFrame(plan, schema)
    return first_by_hash(rows, take.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(cells)), "_take"), cells, seed, key)
