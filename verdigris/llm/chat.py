"""Chat formatting: roles of raw transcript lines by a hidden Markov model, then canonical turns.

States are (role, first line of a turn or a later one). A line is observed as its speaker marker and its shape. Viterbi
runs in max-plus matrices over blocks of turns, so a conversation of any length is spread over tasks: each block gives a
matrix of best scores from state to state, matrices are multiplied within super-blocks, the best states at borders are chosen from the top down, and
each block then traces its own lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm.common import Scratch

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: first line of a turn; 2 * role + 1: a later line
SHAPES, MARKERS = 6, 4
SYMBOLS = SHAPES * MARKERS
#: Turns in a block, most lines of one, blocks in a super-block.
BLOCK, LONG, SUPER = 64, 4096, 1024
#: A speaker marker at the start of a line; the words of each role.
WORDS = {"system": "system|context|instructions", "user": "user|human|question|q|me", "assistant": "assistant|ai|bot|model|answer|a"}
MARKER = r"(?i)^\s*(?:[#>*\[(<|]+\s*)?(" + "|".join(WORDS.values()) + r")\s*(?:[*|)>\]]+\s*:?|:)\s*"


def symbol(text: Column) -> Column:
    """Marker and shape of a line as one number."""
    said = F.lower(F.regexp_extract(text, MARKER, 1))
    marker = F.coalesce(*(F.when(said.rlike(f"^(?:{w})$"), F.lit(i + 1)) for i, w in enumerate(WORDS.values())), F.lit(0))
    n = F.length(text)
    shape = F.when(F.trim(text) == "", 0).when(F.rtrim(text).endswith("?"), 1).when(n < 40, 2).when(n < 120, 3).when(n < 300, 4).otherwise(5)
    return F.coalesce(marker * SHAPES + shape, F.lit(0)).cast("int")


def content(text: Column, role: Column, begins: Column) -> Column:
    """A line without its marker: only where a turn begins, and only a marker of the turn's role."""
    said = F.lower(F.regexp_extract(text, MARKER, 1))
    mine = F.coalesce(*(F.when(role == i, said.rlike(f"^(?:{w})$")) for i, w in enumerate(WORDS.values())), F.lit(False))
    return F.when(begins & mine, F.regexp_replace(text, MARKER, "")).otherwise(text)


def in_blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (conv_id, turn, line, ...) with `block`, ascending along each conversation, and `opens`: whether it is the conversation's first.

    A block holds BLOCK turns, or, where those have more than LONG lines, LONG lines of one turn; so neither long conversations nor long turns end up in one task.
    """
    rows = rows.withColumn("turns", F.floor(F.col("turn") / BLOCK).cast("long"))
    long = rows.groupBy(F.col("conv_id").alias("c"), F.col("turns").alias("t")).agg(F.count("*").alias("n")).filter(F.col("n") > LONG)
    long = scratch.table(long)
    block = F.shiftleft("turns", 40)
    if not long.isEmpty():
        rows = rows.join(long, rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("turns") == F.col("t")), "left")
        inside = F.shiftleft(F.pmod(F.col("turn"), F.lit(BLOCK)), 32) + F.floor(F.col("line") / LONG).cast("long")
        block = block + F.when(F.col("n").isNotNull(), inside).otherwise(F.lit(0))
    rows = scratch.table(rows.withColumn("block", block).drop("turns", "c", "t", "n"))
    first = scratch.table(rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("first")))
    return rows.join(first, rows["conv_id"].eqNullSafe(F.col("c"))).withColumn("opens", F.col("block") == F.col("first")).drop("c", "first")


def lines_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line, text, ...) of turns: one row for each line of `text`; null texts are one empty line."""
    return turns.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "_text")).withColumn("text", F.col("_text")).drop("_text")


@dataclass
class Hmm:
    """Log probabilities: start (states), move (states x states), emit (states x symbols)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def fit_hmm(lines: DataFrame, role: str = "role") -> Hmm:
    """Smoothed relative frequencies of labelled lines (conv_id, turn, line, text, role), counted by Spark; turns are numbered without gaps.

    Lines of other roles, null ones too, are left out; null texts count as empty; repeated lines count each; without any line all states are alike.
    """
    known = lines.withColumn("r", F.coalesce(*(F.when(F.col(role) == r, F.lit(i)) for i, r in enumerate(ROLES)))).filter("r is not null")
    known = known.withColumn("state", F.col("r") * 2 + (F.col("line") > 0).cast("int")).withColumn("symbol", symbol(F.col("text")))
    emit, move, start = np.full((STATES, SYMBOLS), 0.5), np.full((STATES, STATES), 0.01), np.full(STATES, 0.01)
    for x in known.groupBy("state", "symbol").count().collect():  # states x symbols rows at most
        emit[x["state"], x["symbol"]] += x["count"]
    turns = known.groupBy("conv_id", "turn", "r").agg(F.max("line").alias("more"))
    after = turns.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("r").alias("next"))
    pairs = turns.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    for x in pairs.groupBy("r", "next", (F.col("more") > 0).alias("long")).agg(F.count("*").alias("n"), F.sum("more").alias("lines")).collect():
        first, last = 2 * x["r"], 2 * x["r"] + (1 if x["long"] else 0)
        if x["long"]:
            move[first, first + 1] += x["n"]
            move[first + 1, first + 1] += x["lines"] - x["n"]
        if x["next"] is not None:
            move[last, 2 * x["next"]] += x["n"]
    for x in turns.filter("turn = 0").groupBy("r").count().collect():
        start[2 * x["r"]] += x["count"]
    for r in range(len(ROLES)):  # a later line follows only its own role
        for s in range(STATES):
            if s // 2 != r:
                move[s, 2 * r + 1] = 0
        start[2 * r + 1] = 0
    with np.errstate(divide="ignore"):
        return Hmm(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True)))


def runs(batches, n_keys: int):
    """(key, rows) of contiguous rows that agree in the first n_keys columns."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield key, rows


def grouped(df: DataFrame, keys: list[str], order: list[str], run, schema: str) -> DataFrame:
    """Rows of df, whose first columns are `keys`, handed to run(key, rows) -> output rows, group by group in one pass over sorted partitions."""
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    types = [arrow[x.split()[1]] for x in schema.split(", ")]

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def go(batches):
        out = []
        for key, rows in runs(batches, len(keys)):
            out += run(key, rows)
            if len(out) >= 5000:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(1)


IDENTITY = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)


def between(mats: list[np.ndarray], s: int, e: int) -> list[int]:
    """States after each matrix on the best way from s to e."""
    best, back = np.where(np.arange(STATES) == s, 0.0, -np.inf), []
    for m in mats:
        all_ = best[:, None] + m
        back.append(all_.argmax(0))
        best = all_.max(0)
    out = [e]
    for b in back[:0:-1]:
        out.append(int(b[out[-1]]))
    return out[::-1]


def label_lines(lines: DataFrame, hmm: Hmm) -> DataFrame:
    """conv_id, turn, line, text, role, begins (a turn), turn_start, content (without the marker) of (conv_id long, turn long, line long, text).

    `turn` and `line` only give the order (null ones are 0); rows that agree in all three keep one of their orders, by text. Null texts are empty
    lines; other columns are ignored; a null conv_id is a conversation of its own; conversations of any length are labelled whole; an empty table gives an empty result.
    """
    scratch = Scratch(lines.sparkSession, "chat")
    rows = in_blocks(lines.select("conv_id", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("turn", "line")), F.coalesce("text", F.lit("")).alias("text")), scratch)
    seen = rows.select("conv_id", "block", "turn", "line", F.xxhash64("text").alias("h"), "opens", symbol(F.col("text")).alias("symbol"))
    # the step to a conversation's first line starts it, whatever the state before: all rows are alike
    opening = np.repeat(hmm.start[None], STATES, 0)
    step = lambda opens, symbol: (opening if opens else hmm.move) + hmm.emit[:, symbol][None]

    def block_matrix(key, rows):
        m = IDENTITY
        for i, row in enumerate(rows):
            m = times(m, step(row[-2] and not i, row[-1]))
        return [(*key, (key[1] >> 40) // SUPER, m.tobytes())]

    mats = scratch.table(grouped(seen, ["conv_id", "block"], ["turn", "line", "h"], block_matrix, "conv_id long, block long, super long, m binary"))
    of = lambda row: np.frombuffer(row[-1], float).reshape(STATES, STATES)

    def super_matrix(key, rows):
        m = IDENTITY
        for row in rows:
            m = times(m, of(row))
        return [(*key, m.tobytes())]

    supers = grouped(mats.select("conv_id", "super", "block", "m"), ["conv_id", "super"], ["block"], super_matrix, "conv_id long, super long, m binary")
    def choose(key, rows):
        ms = [of(r) for r in rows]
        total = IDENTITY
        for m in ms:
            total = times(total, m)
        s, e = map(int, np.unravel_index(total.argmax(), total.shape))
        states = between(ms, s, e)
        return [(key[0], r[1], a, b) for r, a, b in zip(rows, [s, *states[:-1]], states)]

    tops = grouped(supers, ["conv_id"], ["super"], choose, "conv_id long, super long, s int, e int")
    tops = scratch.table(tops).select(F.col("conv_id").alias("c"), F.col("super").alias("u"), "s", "e")

    def inside(key, rows):
        states = between([of(r) for r in rows], rows[0][3], rows[0][4])
        return [(key[0], r[2], a, b) for r, a, b in zip(rows, [rows[0][3], *states[:-1]], states)]

    both = mats.join(tops, mats["conv_id"].eqNullSafe(F.col("c")) & (F.col("super") == F.col("u"))).select("conv_id", "super", "block", "s", "e", "m")
    ends = grouped(both, ["conv_id", "super"], ["block"], inside, "conv_id long, block long, s int, e int")
    ends = scratch.table(ends).select(F.col("conv_id").alias("c"), F.col("block").alias("k"), "s", "e")

    def trace(key, rows):
        states = between([step(r[7] and not i, r[8]) for i, r in enumerate(rows)], rows[0][5], rows[0][6])
        return [(*key, r[2], r[3], r[9], x // 2, x % 2 == 0) for r, x in zip(rows, states)]

    full = rows.withColumn("h", F.xxhash64("text")).withColumn("symbol", symbol(F.col("text")))
    full = full.join(ends, full["conv_id"].eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))).select("conv_id", "block", "turn", "line", "h", "s", "e", "opens", "symbol", "text")
    told = table = scratch.table(grouped(full, ["conv_id", "block"], ["turn", "line", "h"], trace, "conv_id long, block long, turn long, line long, text string, role int, begins boolean"))
    scratch.keep(table)
    # where the turn of each line starts: in its block, or carried over from an earlier block
    told = told.withColumn("at", F.struct("turn", "line"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    own = F.max(F.when(F.col("begins"), F.col("at"))).over(upto(W.partitionBy("conv_id", "block").orderBy("turn", "line")))
    last = told.groupBy("conv_id", "block").agg(F.max(F.when(F.col("begins"), F.col("at"))).alias("last"), F.min("at").alias("low")).withColumn("super", F.floor(F.shiftright("block", 40) / SUPER))
    above = last.groupBy("conv_id", "super").agg(F.max("last").alias("last")).withColumn("above", F.max("last").over(earlier(W.partitionBy("conv_id").orderBy("super")))).select(F.col("conv_id").alias("ac"), F.col("super").alias("au"), "above")
    carried = last.withColumn("before", F.max("last").over(earlier(W.partitionBy("conv_id", "super").orderBy("block"))))
    carried = carried.join(above, carried["conv_id"].eqNullSafe(F.col("ac")) & (carried["super"] == F.col("au")))
    carried = carried.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.coalesce("before", "above").alias("before"), F.col("low"))
    out = told.withColumn("own", own).join(carried, told["conv_id"].eqNullSafe(F.col("c")) & (told["block"] == F.col("k")))
    name = F.get(F.array(*map(F.lit, ROLES)), F.col("role"))
    return out.select("conv_id", "turn", "line", "text", name.alias("role"), "begins", F.coalesce("own", "before", "low").alias("turn_start"), content(F.col("text"), F.col("role"), F.col("begins")).alias("content"))


def render_turns(labelled: DataFrame) -> DataFrame:
    """conv_id, turn (its first line's), line, role, n_lines, rendered: canonical turns of label_lines, in the form <|role|> text <|end|>.

    Empty lines stay; equal lines of a turn keep their number; a turn is one value, so it has to fit one row; an empty table gives an empty result.
    """
    turns = labelled.groupBy("conv_id", "turn_start", "role").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("turn", "line", "content"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["content"]), "\n")
    return turns.select("conv_id", F.col("turn_start.turn").alias("turn"), F.col("turn_start.line").alias("line"), "role", "n_lines", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), body, F.lit("\n<|end|>")).alias("rendered"))


# Forms in which transcripts mark speakers.
STYLES = {"system": ["System: ", "### Instructions: ", "[system] "], "user": ["User: ", "Human: ", "Q: ", "### User: ", "<user> "], "assistant": ["Assistant: ", "AI: ", "A: ", "### Assistant: ", "<assistant> "]}


def as_transcript(turns: DataFrame) -> DataFrame:
    """Lines of raw transcripts made of turns (conv_id, turn, role, text): three turns of four begin with a marker in one of STYLES, the others with none.

    Null texts are one empty line; turns of no known role get no marker; other columns are kept.
    """
    lines = lines_of(turns)
    h = F.xxhash64("conv_id", "turn")
    form = F.coalesce(*(F.when(F.col("role") == r, F.element_at(F.array(*map(F.lit, s)), (F.pmod(h, F.lit(len(s))) + 1).cast("int"))) for r, s in STYLES.items()), F.lit(""))
    marked = (F.col("line") == 0) & (F.pmod(F.shiftright(h, 8), F.lit(4)) != 0)
    return lines.withColumn("text", F.when(marked, F.concat(form, "text")).otherwise(F.col("text")))
