"""Resamples drawn by MD5, so that any SQL engine draws the same, without a join of single draws with rows.

Draw i of resample b in a group of n rows takes row md5(seed-b-i) mod n. Hashes are made in units (some resamples, a range of draws) by numpy; a task tells each chunk of CHUNK rows how
often it drew each of them (half a byte a row, or two bytes a draw where few were drawn), and a chunk's rows meet what all units drew of them once. So about half a byte to two bytes a draw are
shuffled, a task holds a unit or a chunk however many rows there are, and nothing is broadcast. Groups of about the same size share hashes, as only the modulus differs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.numbering import placed
from verdigris.sources.scratch import Scratch

#: Rows whose draws meet in one task; draws of a unit; draws hashed at once; resamples that a chunk adds up at once; bytes of a batch.
CHUNK, UNIT, AT_ONCE, SLAB, BATCH = 1 << 14, 1 << 21, 1 << 13, 32, 1 << 22
#: Partitions of the units, and draws for each beyond these.
TASKS, TASK_DRAWS = 64, 1 << 24
# MD5's additions, rotations, order of words and first state.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [t[i % 4] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
ORDER = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_first(message: list, size: int) -> np.ndarray:
    """The first 32 bits of the MD5 of `size` messages of one length (at most 55 bytes); each byte is a number or an array."""
    if len(message) > 55:
        raise ValueError("a message has at most 55 bytes")
    block = [*message, 0x80, *[0] * (55 - len(message)), *(8 * len(message)).to_bytes(8, "little")]
    words = []
    for at in range(0, 64, 4):
        fixed = sum(x << 8 * i for i, x in enumerate(block[at : at + 4]) if isinstance(x, int))
        moving = [x.astype(np.uint32) << np.uint32(8 * i) for i, x in enumerate(block[at : at + 4]) if not isinstance(x, int)]
        words.append((fixed, sum(moving[1:], moving[0]) if moving else None))
    a, b, c, d = (np.full(size, x, np.uint32) for x in START)
    for i in range(61):  # the last three steps do not change the first word
        if i < 16:
            t = d ^ (b & (c ^ d))
        elif i < 32:
            t = c ^ (d & (b ^ c))
        elif i < 48:
            t = b ^ c ^ d
        else:
            t = c ^ (b | ~d)
        fixed, moving = words[ORDER[i]]
        t += a
        t += np.uint32((SINES[i] + fixed) % 2**32)
        if moving is not None:
            t += moving
        a, high = t >> np.uint32(32 - TURNS[i]), t
        high <<= np.uint32(TURNS[i])
        high |= a
        high += b
        a, d, c, b = d, c, b, high
    return (b + np.uint32(START[0])).byteswap()


def decades(lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(first, end, digits) of the parts of [lo, hi) whose numbers have as many decimal digits."""
    bounds = [0, *(10**p for p in range(1, 20))]
    return [(max(lo, a), min(hi, b), p + 1) for p, (a, b) in enumerate(zip(bounds, bounds[1:])) if max(lo, a) < min(hi, b)]


def hashes(seed: int, b0: int, b1: int, lo: int, hi: int) -> np.ndarray:
    """The first 32 bits of md5(seed-b-i), a row for each b from b0 to before b1 and a column for each i from lo to before hi."""
    out = np.empty((b1 - b0, hi - lo), np.uint32)
    digits = lambda x, n: [(48 + x // 10**p % 10) for p in reversed(range(n))]
    for b_first, b_end, b_digits in decades(b0, b1):
        for i_first, i_end, i_digits in decades(lo, hi):
            wide = i_end - i_first
            found = np.empty((b_end - b_first) * wide, np.uint32)
            for at in range(0, len(found), AT_ONCE):
                j = np.arange(at, min(at + AT_ONCE, len(found)))
                message = [*f"{seed}-".encode(), *digits(b_first + j // wide, b_digits), ord("-"), *digits(i_first + j % wide, i_digits)]
                found[at : at + AT_ONCE] = md5_first(message, len(j))
            out[b_first - b0 : b_end - b0, i_first - lo : i_end - lo] = found.reshape(-1, wide)
    return out


def told(drawn: np.ndarray, rows: int) -> tuple[bool, bytes]:
    """(dense, data) of the sorted places drawn from a chunk of so many rows: counts of half a byte a row, or the places themselves."""
    if 4 * len(drawn) > rows:
        often = np.bincount(drawn, minlength=rows + rows % 2)
        if often.max() < 16:
            often = often.astype(np.uint8)
            return True, (often[::2] | often[1::2] << 4).tobytes()
    return False, drawn.astype(np.uint16).tobytes()


def often(dense: bool, data: bytes, rows: int) -> np.ndarray:
    """How often each row of a chunk was drawn, from what `told` gave."""
    if not dense:
        return np.bincount(np.frombuffer(data, np.uint16), minlength=rows)
    packed = np.frombuffer(data, np.uint8)
    return np.column_stack([packed & 15, packed >> 4]).ravel()[:rows]


def draws(groups: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(start, chunk, b, dense, data) of all resamples of groups (start, n)."""
    bits = F.ceil(F.log2("n")).cast("int")
    width = F.least(F.lit(UNIT), F.expr("shiftleft(1L, bits)"))
    some = F.greatest(F.lit(1), F.expr(f"shiftright({UNIT}L, bits)")).cast("int")
    units = groups.select("start", "n", bits.alias("bits")).withColumn("width", width).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), some)))
    units = units.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("width"))))
    total, parts = groups.agg(F.sum("n")).head()[0] or 0, units.count()
    units = units.repartition(max(1, min(parts, max(TASKS, total * resamples // TASK_DRAWS))), "bits", "b", "lo")
    units = units.sortWithinPartitions("bits", "b", "lo", F.col("n").desc())  # the largest group of a unit comes first, so its hashes do for all
    unit = UNIT

    def draw(batches):
        last, made, out, held = None, None, [], 0
        fields = [("start", pa.int64()), ("chunk", pa.int64()), ("b", pa.int32()), ("dense", pa.bool_()), ("data", pa.binary())]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])
        for given in batches:
            for start, n, bits, width, b0, lo in zip(*(given.column(c).to_pylist() for c in ("start", "n", "bits", "width", "b", "lo"))):
                hi, b1 = min(n, lo + width), min(resamples, b0 + max(1, unit >> bits))
                if last != (bits, b0, lo):
                    last, made = (bits, b0, lo), hashes(seed, b0, b1, lo, hi)
                for b in range(b0, b1):
                    k = np.sort(made[b - b0, : hi - lo] % np.uint64(n) if n >= 1 << 32 else made[b - b0, : hi - lo] % np.uint32(n))
                    first = int(k[0]) // CHUNK
                    ends = np.searchsorted(k, np.arange(first + 1, int(k[-1]) // CHUNK + 1) * CHUNK)
                    for chunk, mine in enumerate(np.split(k, ends), first):
                        if len(mine):
                            data = told(mine - k.dtype.type(chunk * CHUNK), min(CHUNK, n - chunk * CHUNK))
                            out.append((start, chunk, b, *data))
                            held += len(data[1]) + 64
                    if held > BATCH:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    return units.mapInArrow(draw, "start long, chunk long, b int, dense boolean, data binary")


def resampled_sums(rows: DataFrame, order: str, sums: dict[str, Column], resamples: int, seed: int, by: list[str] | None = None, within: str | None = None) -> DataFrame:
    """(by..., b, within, n, sums...): for each group, resample and value of `within`, how many rows were drawn and their sums.

    Rows are numbered by `order`, unique within a group. `sums` may hold no nulls; rows with a null in `by` take no part. What was not drawn at all has no row.
    """
    by, names = by or [], list(sums)
    scratch = Scratch(rows.sparkSession, "resampled")
    given = rows
    for c in by:
        given = given.filter(F.col(c).isNotNull())
    given = given.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col(order).alias("_order"), *([F.col(within).alias("_within")] if within else []), *(c.cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())))
    keys = [f"_by{i}" for i in range(len(by))]
    numbered = placed(given, [*keys, "_order"])
    groups = scratch.table(numbered.groupBy(*keys).agg(F.min("_k").alias("start"), F.count("*").alias("n")).filter("n > 0"))
    dense = numbered.join(groups.drop("n"), keys) if by else numbered.withColumn("start", F.lit(0).cast("long"))
    values = [f"_v{i}" for i in range(len(names))]
    dense = dense.select("start", F.floor((F.col("_k") - F.col("start")) / CHUNK).cast("long").alias("chunk"), (F.col("_k") - F.col("start")).alias("k"), *(["_within"] if within else []), *values)

    def add_up(drawn: pa.Table, mine: pa.Table) -> pa.Table:
        n = mine.num_rows
        x = np.column_stack([np.ones(n), *(mine.column(v).to_numpy() for v in values)])
        code = mine.column("_within").combine_chunks().dictionary_encode(null_encoding="encode") if within else None
        codes = code.indices.to_numpy() if within else np.zeros(n, np.int32)
        # rows go by code, and within one by place
        turn = np.lexsort((mine.column("k").to_numpy(), codes))
        x, place = x[turn], mine.column("k").to_numpy()[turn] % CHUNK
        kinds, firsts = np.unique(codes[turn], return_index=True)
        odd = np.flatnonzero(~np.isfinite(x).all(1))
        strange, x = x[odd], np.where(np.isfinite(x), x, 0.0)
        x[odd, 1:] = 0.0
        bs, dense_, data = drawn.column("b").to_numpy(), drawn.column("dense").to_pylist(), drawn.column("data")
        out_b, out_kind, out_sums = [], [], []
        for lo in range(0, len(bs), SLAB):
            c = np.stack([often(dense_[i], data[i].as_py(), n) for i in range(lo, min(lo + SLAB, len(bs)))])[:, place].astype(float)
            for kind, first, end in zip(kinds, firsts, [*firsts[1:], n]):
                total = c[:, first:end] @ x[first:end]
                for at, row in zip(odd, strange):
                    if first <= at < end:  # no sum of a resample that did not draw it
                        hit = c[:, at] > 0
                        total[hit, 1:] += c[hit, at, None] * row[1:]
                hit = np.flatnonzero(total[:, 0])
                out_b.append(bs[lo : lo + SLAB][hit])
                out_kind.append(np.full(len(hit), kind))
                out_sums.append(total[hit])
        cat = lambda parts, empty: np.concatenate(parts) if parts else empty
        total = cat(out_sums, np.zeros((0, len(names) + 1)))
        b = cat(out_b, np.zeros(0, np.int32))
        shared = [pa.array(np.full(len(b), mine.column("start")[0].as_py() if n else 0)), pa.array(b)]
        told_ = [code.dictionary.take(pa.array(cat(out_kind, np.zeros(0, np.int32))))] if within and n else []
        return pa.Table.from_arrays([*shared, *told_, *(pa.array(total[:, i]) for i in range(len(names) + 1))], names=["start", "b", *(["_within"] if within else []), "_n", *values])

    kind = f"`_within` {dense.schema['_within'].dataType.simpleString()}, " if within else ""
    met = draws(groups, resamples, seed).groupBy("start", "chunk").cogroup(dense.groupBy("start", "chunk"))
    parts = met.applyInArrow(add_up, f"start long, b int, {kind}_n double, {', '.join(f'{v} double' for v in values)}")
    found = parts.groupBy("start", "b", *(["_within"] if within else [])).agg(F.sum("_n").alias("n"), *(F.sum(v).alias(c) for v, c in zip(values, names)))
    found = found.join(groups.select("start", *(F.col(k).alias(c) for k, c in zip(keys, by))), "start") if by else found
    return found.select(*by, "b", *([F.col("_within").alias(within)] if within else []), "n", *names)
