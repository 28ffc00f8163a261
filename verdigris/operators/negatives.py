"""A wrong partner for each row, drawn from a whole table without making pairs of all rows and all partners.

Partners are numbered from 0 to n-1. With m the least power of two that is not below n, row e tries the numbers (start + r * step) mod m for r = 0, 1, 2, ...; start and the odd
step come from a hash of e, so the tries go through every number once, and numbers from n on are passed over. A round joins each row that has found nothing yet with its next few
partners by number, keeps the first that serves, and carries the others on, each time with twice as many tries. Rows that nothing serves are known when all m are tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.numbering import placed
from verdigris.sources.scratch import Scratch

#: Tries of the first round; tries of a round that are sent to all tasks.
TRIES, SENT_ROWS = 4, 50_000


def _part(seed: int, key: Column, first: int) -> Column:
    """Seven hexadecimal digits of a hash as a number."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, first, 7), 16, 10).cast("long")


def tried(seed: int, key: Column, r: Column, m: int) -> Column:
    """The number that row `key` tries at turn r."""
    step = 2 * _part(seed, key, 8) + 1
    return F.pmod(_part(seed, key, 1) + r * F.pmod(step, F.lit(m)), F.lit(m))


def drawn(
    rows: DataFrame, key: str, partners: DataFrame, name: str, serves: Column, seed: int = 0, choose: Callable[[DataFrame], DataFrame] = lambda rows: rows, needs: list[str] | None = None, about: DataFrame | None = None
) -> DataFrame:
    """rows with the columns of the first partner in their sequence that serves; rows that no partner serves are left out.

    `key` is unique in rows and `name` in partners, which are numbered in its order; their other column names differ. `serves` is a condition over both; `needs` names the columns of
    rows that it reads, if not all. What is long and shared by many rows it reads from `about`, a table with one row for each value of `needs`. `choose` may leave
    out, before anything is tried, rows of which it is known that nothing serves them. Null keys and names, and empty tables, give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "drawn")
    numbered = placed(partners.filter(F.col(name).isNotNull()), name).withColumnRenamed("_k", "_number").drop("_total")
    n = numbered.count()
    given = scratch.table(choose(rows.filter(F.col(key).isNotNull())))
    needs = [c for c in given.columns if c != key] if needs is None else needs
    left, many = given.select(key, *needs), given.count()
    m, done, width, found = 1 << max(n - 1, 0).bit_length(), 0, TRIES, []
    # joins sort both sides unless rows are counted few: files of much repeated text are far smaller than the rows in them, so Spark would broadcast what does not fit the driver
    while n and done < m and many:
        turns = F.sequence(F.lit(done).cast("long"), F.lit(min(done + width, m) - 1).cast("long"))
        # what the condition reads is repeated for the tries, and so are partners; a number from n on has no partner
        asks = left.withColumn("_turn", F.explode(turns)).withColumn("_number", tried(seed, F.col(key), F.col("_turn"), m)).filter(F.col("_number") < n)
        pairs = numbered.join(F.broadcast(asks) if many * width <= SENT_ROWS else asks.hint("merge"), "_number")
        pairs = pairs.join(about.hint("merge"), needs) if about is not None else pairs
        first = scratch.table(pairs.filter(F.coalesce(serves, F.lit(False))).groupBy(key).agg(F.min_by("_number", "_turn").alias("_number")))
        found.append(first)
        left = scratch.table(left.join(first.hint("merge"), key, "left_anti"))
        done, width, many = done + width, width * 2, left.count()
    if not found:
        return given.join(numbered.drop("_number"), F.lit(False))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    scratch.keep(given, *found)
    return given.join(every.hint("merge"), key).join(numbered.hint("merge"), "_number").drop("_number")


def drawn_sql(rows: str, key: str, partners: str, name: str, serves: str, seed: int = 0) -> str:
    """CTEs ending in `drawn`: the same choice in DuckDB SQL, over all pairs. `rows` and `partners` name earlier CTEs."""
    h = lambda first: f"('0x'||substr(md5('{seed}-'||{key}::varchar),{first},7))::BIGINT"
    return f"""numbered as (select *, row_number() over (order by {name}) - 1 number from {partners} where {name} is not null),
 size as (select min(x) m from (select unnest([(1::BIGINT << k) for k in range(40)]) x) where x >= (select count(*) from numbered)),
 tries as (select r.*, t.turn, ({h(1)} + t.turn * ((2 * {h(8)} + 1) % m)) % m number from {rows} r, size, (select unnest(range((select m from size))) turn) t),
 drawn as (select * from tries join numbered using (number) where {serves} qualify row_number() over (partition by {key} order by turn) = 1)"""
