"""Token ids packed into rows of fixed length, by best-fit-decreasing.

Documents are encoded, split losslessly into segments of at most `length` tokens, and packed inside the task that reads
them: there is no shuffle. A task packs at most `shard_tokens` tokens at a time (longest segments first, each into the fullest row
that still holds it, found in a segment tree over free capacities), so memory is bounded however large a partition is.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from verdigris.llm.bpe import SLICE_BYTES, read_vocabulary
from verdigris.llm.common import list_array, slices, utf8

SCHEMA = "shard long, pack int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<int>"
NAMES = [x.strip().split()[0] for x in SCHEMA.split(",")]


def library_encoder(rank_file: bytes, pattern: str):
    """text -> uint32 ids by the tokenizer library, which gives the same ids as verdigris.llm.bpe at less cost; and the number of ids."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_to_numpy, max(ranks.values(), default=-1) + 1


class CapacityTree:
    """Counts of rows by free capacity, as a segment tree: the least capacity >= need that some row has, in log(length) steps."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, removed from the tree; of equal ones the row put in last."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):  # up to where a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Segments of each row, by index; ties in length keep their order."""
    tree, rows = CapacityTree(length), []
    for s in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[s])
        found = tree.take(need)
        if found is None:
            found = (length, len(rows))
            rows.append([])
        free, row = found
        rows[row].append(s)
        if free > need:
            tree.add(free - need, row)
    return rows


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, length: int = 2048, shard_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text", pad: int | None = None) -> DataFrame:
    """Packed rows of SCHEMA.

    ids: `length` ids as little-endian uint16 (uint32 for vocabularies over 65,535), filled up with `pad` (by default the first
    free id); cu_seqlens: 0 and the cumulative lengths of the row's segments; position_resets: the places in the row at which positions
    start at 0 again, one for each segment; doc_ids and doc_offsets: whose tokens a segment holds and from which token on. Null and empty texts have no tokens and so no segment;
    a null key is written as null; which segments share a row, and how many rows a task leaves not quite full, follows the partitions of `docs`; repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        encode, n_ids = library_encoder(sent.value, pattern)
        fill = n_ids if pad is None else pad
        kind = np.uint16 if fill < 1 << 16 and n_ids <= 1 << 16 else np.uint32
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        keys, texts, held, n_shards = [], [], 0, 0

        def shard():
            sizes = np.array([len(x) for x in texts], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            parts = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), parts)
            offset = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
            seg_len = np.minimum(length, sizes[doc] - offset)
            seg_start = first[doc] + offset
            flat = np.concatenate(texts)
            rows = best_fit_decreasing(seg_len, length)
            for lo in range(0, len(rows), 512):
                some = rows[lo : lo + 512]
                counts = np.array([len(r) for r in some])
                segs = np.concatenate([np.array(r) for r in some])
                lens = seg_len[segs]
                row = np.repeat(np.arange(len(some)), counts)
                ends = np.cumsum(lens)
                begins = ends - lens
                used = np.bincount(row, lens, len(some)).astype(np.int64)
                row_start = np.concatenate([[0], np.cumsum(used)[:-1]])
                within = np.arange(int(ends[-1])) - np.repeat(begins, lens)
                grid = np.full((len(some), length), fill, kind)
                token_row = np.repeat(row, lens)
                grid[token_row, np.repeat(begins - row_start[row], lens) + within] = flat[np.repeat(seg_start[segs], lens) + within]
                cu = np.insert(ends - row_start[row], np.cumsum(counts) - counts, 0).astype(np.int32)
                owner = [keys[d] for d in doc[segs].tolist()]
                docs_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), (task << 32) + n_shards, np.int64)),
                    pa.array(np.arange(lo, lo + len(some), dtype=np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array([g.tobytes() for g in grid], pa.binary()),
                    list_array(cu, counts + 1),
                    list_array((begins - row_start[row]).astype(np.int32), counts),
                    docs_of,
                    list_array(offset[segs].astype(np.int32), counts),
                ], names=NAMES)

        for b in batches:
            for lo, hi in slices(utf8(b.column(1))[1], SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(t, disallowed_special=()) if t else ()
                    if len(ids):
                        keys.append(k)
                        texts.append(ids)
                        held += len(ids)
                        if held >= shard_tokens:
                            yield from shard()
                            keys, texts, held, n_shards = [], [], 0, n_shards + 1
        if texts:
            yield from shard()

    return docs.select(key, text).mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet; `ids` of all rows of a file, end to end, are the id matrix."""
    packed.write.mode("overwrite").parquet(path)
