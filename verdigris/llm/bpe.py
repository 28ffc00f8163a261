"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece the table holds the one token that ends the prefix's BPE encoding. A token t may end prefix i
if the prefix before t has last token p and the merges of bytes(p)+bytes(t) give back exactly (p, t). Greedy merging
has one result, so exactly one t fits; following the table backwards from the end gives the whole encoding. Appending
bytes only adds entries, and an edit recomputes entries only until as many as the longest token has bytes agree again.
"""

from __future__ import annotations

import base64
import sys
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import slices, utf8

#: The vocabulary is broadcast; a larger file is refused.
MAX_VOCAB_BYTES = 64 << 20
#: Pieces longer than this are never kept in the piece cache; it and the tables of judged pairs and of shared prefixes are emptied at so many entries.
MAX_CACHED_PIECE, MAX_CACHED, MAX_PAIRS, MAX_PREFIXES = 64, 50_000, 300_000, 200_000
NONE = 1 << 62
#: Bytes of text encoded or decoded at a time, one text at least.
SLICE_BYTES = 1 << 20


class PrefixBPE:
    """Encoder for one rank table (`base64 rank` lines)."""

    def __init__(self, rank_file: bytes):
        lines = [x.split() for x in rank_file.splitlines() if x.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks), default=1)
        # every ending of a token; its rank if it is itself one, else -1
        self.tails = dict.fromkeys((t[i:] for t in self.ranks for i in range(len(t))), -1) | self.ranks
        self.prefixes: dict[bytes, int] = {}
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def merge(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """Rank-ordered merging of a short byte string, until at most `down_to` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > down_to:
            best, at = min((get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if best == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = len(self.merge(self.tokens[token])) == 1
        return known

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's right (1) or left (0) edge while it is merged, byte first: (part, rank of the merge that takes it)."""
        if (known := self._spines[side].get(token)) is None:
            known, part, taken = [], self.tokens[token], NONE
            while True:
                known.append((part, taken))
                if len(part) == 1:
                    break
                taken = self.ranks[part]
                part = self.merge(part, 2)[-side]
            known = self._spines[side][token] = known[::-1]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` can stand after `left`: no merge across the border comes before those that make the two."""
        if len(self._pairs) > MAX_PAIRS:
            self._pairs.clear()
        get, known = self.ranks.get, self.whole(left) and self.whole(right)
        a, b, i, j = self.spine(left, 1), self.spine(right, 0), 0, 0
        while known:
            (x, x_taken), (y, y_taken) = a[i], b[j]
            across = get(x + y, NONE)
            if across < x_taken and across <= y_taken:  # of equal merges the left one comes first
                known = False
            elif x_taken <= y_taken and i + 1 < len(a):
                i += 1
            elif j + 1 < len(b):
                j += 1
            else:
                break
        self._pairs[left << 32 | right] = known
        return known

    def ending(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of the prefix of `end` bytes. Sets last[end], and the entries before it that this one needs."""
        tail, pair, fits, begin = self.tails.get, self._pairs.get, [], end - 1
        while begin >= 0 and (token := tail(data[begin:end])) is not None:
            if token >= 0:
                fits.append((begin, token))
            begin -= 1
        for begin, token in reversed(fits):
            if not begin:
                known = self.whole(token)
            else:
                if (before := last[begin]) < 0:
                    before = self.ending(data, begin, last)
                if (known := pair(before << 32 | token)) is None:
                    known = self.follows(before, token)
            if known:
                last[end] = token
                return token
        raise ValueError("the vocabulary lacks a single byte of the text")

    def fill(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Set last[start+1 .. stop], given the entries up to `start`; last[i] belongs to the prefix of i bytes."""
        for end in range(start + 1, stop + 1):
            if last[end] < 0:
                self.ending(data, end, last)

    def follow(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern; a piece that is itself a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > MAX_CACHED_PIECE:
            last = [-1] * (len(piece) + 1)
            self.fill(piece, last, 0, len(piece))
            return self.follow(last, len(piece))
        if len(self.prefixes) > MAX_PREFIXES:
            self.prefixes.clear()
        out = []
        while piece:
            out.append(token := self.shared_ending(piece))
            piece = piece[: -len(self.tokens[token])]
        return out[::-1]

    def shared_ending(self, prefix: bytes) -> int:
        """The last token of a prefix, from a table that all short pieces share: words with a common beginning have its entries in common."""
        if (token := self.prefixes.get(prefix)) is not None:
            return token
        tail, pair, fits, begin = self.tails.get, self._pairs.get, [], len(prefix) - 1
        while begin >= 0 and (token := tail(prefix[begin:])) is not None:
            if token >= 0:
                fits.append((begin, token))
            begin -= 1
        for begin, token in reversed(fits):
            if not begin:
                known = self.whole(token)
            else:
                before = self.shared_ending(prefix[:begin])
                if (known := pair(before << 32 | token)) is None:
                    known = self.follows(before, token)
            if known:
                self.prefixes[prefix] = token
                return token
        raise ValueError("the vocabulary lacks a single byte of the text")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The prefix table of one piece, kept for exact appends and for re-encoding near edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self.bpe.fill(self.data, self.last, n, len(self.data))

    def edit(self, start: int, removed: int, inserted: bytes) -> int:
        """Replace data[start:start+removed]; returns how many entries were computed anew."""
        old, shift = self.last, len(inserted) - removed
        self.data = self.data[:start] + inserted + self.data[start + removed :]
        n = len(self.data)
        self.last = old[: start + 1] + [-1] * (n - start)
        agree, at = 0, start
        while at < n and agree < self.bpe.longest:
            self.bpe.fill(self.data, self.last, at, at + 1)
            at += 1
            agree = agree + 1 if at > start + len(inserted) and self.last[at] == old[at - shift] else 0
        if at < n:
            self.last[at + 1 :] = old[at + 1 - shift :]
        return at - start

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.follow(self.last, len(self.data))


class PieceCache(dict):
    """piece -> its ids as int32 bytes. Pieces move to `older` when it is full, and back when they are asked for, so frequent ones stay."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = array("i", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= MAX_CACHED_PIECE:
            if len(self) >= MAX_CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def encoder(rank_file: bytes, pattern: str):
    """text -> int32 bytes of its ids. The last one is kept in the worker process between tasks, in a module of its own, as functions that
    travel with a plan bring their globals along anew."""
    kept = sys.modules.setdefault("_verdigris_worker", ModuleType("_verdigris_worker")).__dict__
    key = (hash(rank_file), pattern)
    if key not in kept:
        for other in [k for k in kept if isinstance(k, tuple)]:
            del kept[other]
        kept[key] = (PieceCache(PrefixBPE(rank_file)), regex.compile(pattern).findall)
    cache, split = kept[key]
    get = cache.__getitem__

    def encode(text: str | None) -> bytes:
        return b"".join(map(get, split(text))) if text else b""

    return encode, cache.bpe


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MAX_VOCAB_BYTES} bytes, the bound for broadcasting it")
    return data


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of `docs` and `ids` array<int>, one row out for each row in, whole texts, without special tokens.

    Null and empty texts give an empty array; repeated rows are encoded alike; an empty table gives an empty result; a
    column already named `ids` is replaced. The driver reads the vocabulary file once and broadcasts it.
    """
    docs = docs.drop(ids)
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    n_cols = len(docs.columns)
    at = docs.columns.index(text)
    schema = docs.withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches):
        encode, _ = encoder(sent.value, pattern)
        for b in batches:
            for lo, hi in slices(utf8(b.column(at))[1], SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                out = [encode(t) for t in part.column(at).to_pylist()]
                values = np.frombuffer(b"".join(out), np.int32)
                offsets = np.zeros(len(out) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in out], out=offsets[1:])
                arrays = [part.column(i) for i in range(n_cols)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `docs` and `out` (binary): the bytes of the ids.

    Null ids give null, no ids give no bytes, ids outside the vocabulary raise; rows of any length are decoded whole; repeated rows are decoded
    alike; a column named as `out` is replaced; an empty table gives an empty result.
    """
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = docs.columns.index(ids)
    schema = docs.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches):
        data, start, size = token_bytes(sent.value)
        for b in batches:
            rows = np.concatenate([[0], np.cumsum(b.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for lo, hi in slices(rows, SLICE_BYTES // 4):
                part = b.slice(lo, hi - lo)
                column = part.column(at)
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lens = size[ids]
                ends = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(lens, out=ends[1:])
                text = np.empty(ends[-1], np.uint8)
                for i in range(0, len(ids), SLICE_BYTES // 4):  # a long text's indices in parts
                    j = min(i + SLICE_BYTES // 4, len(ids))
                    text[ends[i] : ends[j]] = data[np.repeat(start[ids[i:j]] - ends[i:j], lens[i:j]) + np.arange(ends[i], ends[j])]
                rows = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                made = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends[rows]), pa.py_buffer(text)])
                if column.null_count:
                    made = pa.compute.if_else(column.is_valid(), made, pa.scalar(None, pa.large_binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, made.cast(pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def token_bytes(rank_file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, and where each rank's begin and how many they are."""
    found = {int(b): base64.b64decode(a) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
    size = np.zeros(max(found, default=-1) + 1, np.int64)
    for rank, token in found.items():
        size[rank] = len(token)
    return np.frombuffer(b"".join(found.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size, size


def digest_columns(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )


def encode_texts(rank_file: bytes, pattern: str, texts) -> list[list[int]]:
    """Local form of the encoder."""
    encode, _ = encoder(rank_file, pattern)
    return [np.frombuffer(encode(t), np.int32).tolist() for t in texts]


