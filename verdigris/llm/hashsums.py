"""Sorted arrays of hashes as compact bytes, and sums by hash over a whole corpus.

A chunk asks for its distinct hashes, in ascending order, with numbers to add up. Requests are cut by the hash's leading bits into
buckets; each bucket merges the sorted arrays of all chunks, adds up the numbers of equal hashes and answers every chunk with the sums of the hashes that it asked
for, in its order. So two exchanges of compact arrays stand for a shuffle of a row for each hash, and a frequent hash is one entry a chunk.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Scratch, give_back

#: Hashes asked for in a bucket: at most and at least, on average (the latter where there are more partitions than that).
MOST, LEAST = 1 << 22, 1 << 16
REQUEST = "chunk long, bucket long, keys binary, sums array<binary>"
ANSWER = "chunk long, bucket long, first binary, sums array<binary>, histogram array<long>"


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<BQ", width, len(x)) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """As uint32 where that holds them, else uint64."""
    width, n = struct.unpack_from("<BQ", data)
    out = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(memoryview(data)[9:], width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint32 if width <= 4 else np.uint64)


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def bucket_bits(asked: int, partitions: int) -> int:
    """Leading bits that name a bucket."""
    return max(asked // MOST, min(4 * partitions, asked // LEAST), 1).bit_length()


def requests(chunk: int, keys: np.ndarray, sums: list[np.ndarray], bits: int, lead: int):
    """Rows of REQUEST for sorted distinct keys of `bits` bits."""
    lead = min(lead, bits)
    cut = np.searchsorted(keys >> np.uint64(bits - lead), np.arange((1 << lead) + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(int(cut[bucket]), int(cut[bucket + 1]))
        yield chunk, bucket, packed_sorted(keys[part]), [packed(s[part]) for s in sums]


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, bucket, keys, sums = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(keys, pa.binary()), pa.array(sums, pa.list_(pa.binary()))], names=["chunk", "bucket", "keys", "sums"])


def add_up(asked: DataFrame, scratch: Scratch, of: int = 0) -> DataFrame:
    """Rows of ANSWER, one for each of REQUEST: the sums over all chunks, and which hashes no other request of the bucket holds before it.

    histogram, once a bucket: hashes, sum and numbers of hashes with 1, 2, 3 and 4 of the sum numbered `of`.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")  # so that the order in which requests arrive decides nothing
        keys = [unpacked_sorted(k) for k in table["keys"].to_pylist()]
        size = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")  # merges the sorted runs
        ranked = every[order]
        new = np.ones(len(every), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = np.flatnonzero(new)
        group = np.empty(len(every), np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.zeros(len(every), bool)
        first[order[at]] = True
        asked = table["sums"].to_pylist()
        totals = [np.add.reduceat(np.concatenate([unpacked(row[i]) for row in asked])[order], at) for i in range(len(asked[0]))]
        ends = np.cumsum(size)
        rows = [(np.packbits(first[e - n : e]).tobytes(), [packed(t[group[e - n : e]]) for t in totals]) for n, e in zip(size.tolist(), ends.tolist())]
        h = [len(at), int(totals[of].sum()), *(int((totals[of] == k).sum()) for k in (1, 2, 3, 4))]
        del every, order, ranked, group, totals
        give_back()
        return pa.Table.from_arrays([
            table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array([r[0] for r in rows], pa.binary()),
            pa.array([r[1] for r in rows], pa.list_(pa.binary())), pa.array([h, *[None] * (len(rows) - 1)], pa.list_(pa.int64())),
        ], names=["chunk", "bucket", "first", "sums", "histogram"])

    return scratch.table(asked.groupBy("bucket").applyInArrow(run, ANSWER))


def histogram(answers: DataFrame) -> list[int]:
    """hashes, sum, and how many hashes have 1, 2, 3 and 4: six numbers."""
    row = answers.filter("histogram is not null").agg(*(F.coalesce(F.sum(F.col("histogram")[i]), F.lit(0)) for i in range(6))).first()
    return [int(x) for x in row]


def by_chunk(answers: DataFrame, name: str) -> DataFrame:
    """chunk and its answers, in the order of their buckets: one array for each chunk, a number of entries that the chunk's own size bounds."""
    rows = F.array_sort(F.collect_list(F.struct("bucket", "first", "sums")))
    return answers.groupBy("chunk").agg(rows.alias(name))


def joined(rows) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first, sums) of one chunk's answers (from by_chunk), aligned with the keys it asked for."""
    sums = [np.concatenate(x) for x in zip(*([unpacked(s) for s in r["sums"]] for r in rows))]
    first, at = np.zeros(len(sums[0]), bool), 0
    for r in rows:
        n = struct.unpack_from("<BQ", r["sums"][0])[1]
        first[at : at + n] = np.unpackbits(np.frombuffer(r["first"], np.uint8), count=n).astype(bool)
        at += n
    return first, sums
