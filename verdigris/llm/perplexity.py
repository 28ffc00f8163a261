"""Quality rules: word and line statistics, and bands of n-gram perplexity.

The language model is a modified Kneser-Ney model of word pairs that backs off to words and, below them, to their spelling. A
word is a run of letters, digits (folded to one) and bytes beyond ASCII; marks, and characters of scripts written without
spaces, stand alone. Texts are read into chunks of word numbers. The pairs of a chunk, as hashes in ascending order, are counted in sorted arrays that
the corpus' hashes are dealt over (see hashsums), and each chunk is told the corpus counts of its own pairs; in the same way what belongs to a
word is added up: how often it stands before another, before how many words once, twice or more, and after how many. Nothing is
kept for frequent pairs only, and nothing but scalars reaches the driver, so what is gathered grows with the corpus. As a text is
scored by a model that counted it, each pair is scored without one of its occurrences, so nothing is known for being itself.

Pair hashes have PAIR_BITS bits more than their number needs, so one in 2**PAIR_BITS pairs at most is counted with another one's. Spelling
is a modified Kneser-Ney model of order 4 over a 32-symbol alphabet (white space, folded Latin letters, digits, classes of
other characters), and the share of each code point that is not folded to a letter.

Each language has its own lower and upper bound of the perplexity of spelling, and an upper bound of that of words (copies lower it, so
it has no lower one), from the quartiles of all its documents that pass the base rules; a text beyond them is rejected. The
bounds widen for short texts, whose perplexity varies more.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm.common import LOWER, SPACE, Scratch, Words, distinct, free_names, give_back, mix, slices, utf8
from verdigris.llm.hashsums import REQUEST, add_up, bucket_bits, by_chunk, histogram, joined, packed, packed_sorted, request_batch, requests, unpacked, unpacked_sorted

ORDER, BITS = 4, 5
SYMBOLS = 1 << BITS
#: Bounds in robust standard deviations from a language's median; the least deviation; symbols at which a text's own spread equals it.
LOWER_WIDTH, UPPER_WIDTH, LEAST_SPREAD, SHORT = 3.5, 5.6, 0.03, 1000.0
#: Documents of a language at which its own statistics weigh as much as those of all documents.
LEAST_DOCS = 30
#: Bands of more languages than this are joined, not broadcast.
MAX_BROADCAST_LANGUAGES = 10_000
#: Words of a chunk at least, unless its task has fewer; bits of a word's hash; bits of a pair's hash beyond those that number the pairs.
CHUNK_WORDS, WORD_BITS, PAIR_BITS = 1 << 21, 48, 7
#: Symbols of text in a bucket of chunks, on average: a few chunks, as a task gets all of its bucket at once.
BUCKET_SYMBOLS = 1 << 24
#: Bins of a log perplexity, for exact quartiles from counts.
BINS = 1000
#: 0 white space, 1 letters, digits and bytes beyond ASCII, 2 marks, each a word of its own.
KIND = np.array([0 if SPACE[b] else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
#: Lead bytes of characters of scripts without spaces between words (from U+3000 on), each a word of its own.
ALONE = np.zeros(256, bool)
ALONE[0xE3:0xF5] = True
FOLD = LOWER.copy()
FOLD[48:58] = 48
SYMBOL_MARK = np.zeros(256, bool)
SYMBOL_MARK[list(b"#*$%&|<>")] = True


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    ascii_, latin = np.full(256, 31, np.uint8), np.full(256, 28, np.uint8)
    for b in range(128):
        c = chr(b)
        ascii_[b] = 0 if SPACE[b] else ord(c.lower()) - 96 if c.isalpha() else 27 if c.isdigit() else 30 if SYMBOL_MARK[b] else 29 if c.isprintable() else 31
    ascii_[0x80:0xC0] = 28  # continuation bytes; lead bytes carry no symbol
    for b in range(0x80, 0xC0):  # those after the lead byte 0xC3
        base = unicodedata.normalize("NFD", chr(b + 0x40))[0].lower()
        latin[b] = ord(base) - 96 if "a" <= base <= "z" else 19 if b == 0x9F else 28
    return ascii_, latin


ASCII, LATIN = _alphabet()


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One symbol a character of one or two bytes (more for longer ones), and each text's offsets in them."""
    sym, place = placed(raw, off)
    return sym, place[off - off[0]]


def placed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols, and how many of them stand before each byte."""
    data = raw[off[0] : off[-1]]
    out = ASCII[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[after] = LATIN[data[after]]
    keep = data < 0xC0
    digit = out == 27
    keep[1:] &= ~(digit[1:] & digit[:-1])  # a run of digits is one symbol, so numbers weigh as one rare word
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return out[keep], place


def points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and code point of every character beyond ASCII that is not folded to a letter."""
    data = raw[off[0] : off[-1]]
    at = np.flatnonzero(data >= 0xC0)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    at = at[(data[at] != 0xC3) | (LATIN[pad[at + 1]] == 28)]
    x, *b = (pad[at + i].astype(np.int32) for i in range(4))
    b = [y & 63 for y in b]
    return at, np.where(x < 0xE0, (x & 31) << 6 | b[0], np.where(x < 0xF0, (x & 15) << 12 | b[0] << 6 | b[1], (x & 7) << 18 | b[0] << 12 | b[1] << 6 | b[2]))


def grams(sym: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Packed 4-grams that end at each symbol; before a text stands white space."""
    key = sym.astype(np.int32)
    starts = off[:-1]
    for back in range(1, ORDER):
        prev = np.zeros(len(sym), np.int32)
        prev[back:] = sym[: len(sym) - back]
        for i in range(back):
            at = starts + i
            prev[at[at < len(sym)]] = 0
        key |= prev << (BITS * back)
    return key


def count_spelling(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """How often each 4-gram of symbols and each code point of `points` occurs; the alphabet and Unicode bound what reaches the driver."""
    size = SYMBOLS**ORDER

    def run(batches):
        total = np.zeros(size + 0x110000, np.int64)
        for b in batches:
            raw, off = utf8(b.column(0))
            for lo, hi in slices(off):
                mine = off[lo : hi + 1]
                total[:size] += np.bincount(grams(*symbols(raw, mine)), minlength=size)
                at, n = np.unique(points(raw, mine)[1], return_counts=True)
                total[size + at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["what", "n"])
        give_back()

    rows = docs.select(text).mapInArrow(run, "what int, n long").groupBy("what").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 0x110000, np.int64)
    out[rows["what"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:size], out[size:]


@dataclass
class Model:
    """keys[i] ascending, values[i]: discounted probability of an n-gram, or back-off weight of a context (see `key`)."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def key(kind: int, order: int, gram: np.ndarray) -> np.ndarray:
        """kind 0: n-gram of this order; 1: context of n-grams of this order."""
        with np.errstate(over="ignore"):
            return mix(gram.astype(np.uint64) + np.uint64((kind * 8 + order + 1) << 32))

    def find(self, kind: int, order: int, gram: np.ndarray, missing: float) -> np.ndarray:
        key = self.key(kind, order, gram)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.values[at], missing) if len(self.keys) else np.full(len(gram), missing)

    def table(self) -> np.ndarray:
        """Natural log of the probability of each 4-gram's last symbol after the others."""
        p = np.full(1, 1.0 / SYMBOLS)
        for order in range(1, ORDER + 1):
            gram = np.arange(SYMBOLS**order)
            p = self.find(0, order, gram, 0.0) + self.find(1, order, np.arange(SYMBOLS ** (order - 1)), 1.0)[gram >> BITS] * p[gram % (SYMBOLS ** (order - 1))]
        return np.log(np.maximum(p, 1e-12)).astype(np.float32)


def cuts(of: list[int] | np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from the counts 0, 1, 2, and 3 or more; of[k]: how many n-grams have count k."""
    y = of[1] / max(of[1] + 2 * of[2], 1)
    return np.array([0.0] + [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.1), k - 0.1) if of[k] and of[k + 1] else 0.5 * k for k in (1, 2, 3)])


def fit_model(counts: np.ndarray) -> Model:
    """Modified Kneser-Ney of spelling, from the counts of all 4-grams."""
    gram = np.flatnonzero(counts)
    n = counts[gram]
    keys, values = [], []
    for order in range(ORDER, 0, -1):
        drop = cuts(np.bincount(np.minimum(n, 5), minlength=5).astype(float))[np.minimum(n, 3)]
        context = gram >> BITS
        width = SYMBOLS ** (order - 1)
        total, freed = np.bincount(context, n, width), np.bincount(context, drop, width)
        seen = np.flatnonzero(total)
        keys += [Model.key(0, order, gram), Model.key(1, order, seen)]
        values += [(n - drop) / total[context], freed[seen] / total[seen]]
        # the order below counts in how many distinct larger n-grams each one ends
        gram, n = np.unique(gram % width, return_counts=True) if order > 1 else (gram, n)
    keys, values = np.concatenate(keys), np.concatenate(values)
    at = np.argsort(keys)
    return Model(keys[at], values[at].astype(np.float32))


def shares(counts: np.ndarray) -> np.ndarray:
    """Log of each code point's share; 0 for those that do not occur."""
    out = np.zeros(len(counts), np.float32)
    at = np.flatnonzero(counts)
    out[at] = np.log(counts[at] / counts.sum())
    return out


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and hash (of WORD_BITS bits, never 0) of every word of the model."""
    w = Words(FOLD[raw[off[0] : off[-1]]], off - off[0], lower=False)
    kind, n = KIND[w.data], len(w.data)
    lead = np.maximum.accumulate(np.where((w.data & 0xC0) != 0x80, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    alone = ALONE[w.data[lead]]
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (alone[1:] != alone[:-1])
    new |= ALONE[w.data]
    new[w.off[w.off < n]] = True
    stops = np.append(np.flatnonzero(new), n)
    start = np.flatnonzero(new & (kind > 0))
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    word = np.maximum(w.span_hash(start, end) >> np.uint64(64 - WORD_BITS), np.uint64(1))
    return start, end, np.searchsorted(w.off, start, "right") - 1, word


def spelling(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log probability of the symbols of each word, as if white space stood before it, and of its code points."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    raw = data[np.repeat(start - off[:-1], end - start) + np.arange(off[-1])]
    sym, place = placed(raw, off)
    logs = np.zeros(len(sym) + 1)
    np.cumsum(table[grams(sym, place[off])], out=logs[1:])
    unfolded = np.zeros(len(raw) + 1)
    at, point = points(raw, off)
    unfolded[at + 1] = share[point]
    unfolded = np.cumsum(unfolded)
    return logs[place[off[1:]]] - logs[place[off[:-1]]] + unfolded[off[1:]] - unfolded[off[:-1]]


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_scored long, log_perplexity double"
NAMES = [x.split()[0] for x in METRICS.split(", ")]


def repeated(key: np.ndarray) -> np.ndarray:
    """The values that occur twice or more, in ascending order."""
    ranked = np.sort(key)
    return np.unique(ranked[1:][ranked[1:] == ranked[:-1]])


def first_of_each(key: np.ndarray) -> np.ndarray:
    """For each element: is it the first of its value."""
    first = np.ones(len(key), bool)
    at = np.flatnonzero(np.isin(key, repeated(key)))
    first[at] = False
    first[at[np.unique(key[at], return_index=True)[1]]] = True
    return first


def measure(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """The columns of METRICS for a run of texts."""
    w = Words(raw, off, lower=False)
    rows = w.n_rows
    n_words = np.bincount(w.row, minlength=rows)
    word_chars = w.per_row(~w.space & ((w.data & 0xC0) != 0x80))
    n_symbols = w.per_row(SYMBOL_MARK[w.data])
    # lines: from a text's start or a line break to the next one
    feeds = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.off[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([w.off[1:], feeds]), kind="stable")
    words_before = np.searchsorted(w.start, np.stack([starts, ends]))
    filled = words_before[0] < words_before[1]
    starts, ends = starts[filled], ends[filled]
    row = np.searchsorted(w.off, starts, "right") - 1
    with np.errstate(over="ignore"):
        key = w.span_hash(starts, ends) + mix(row.astype(np.uint64))
        n_dup_lines = np.bincount(row[~first_of_each(key)], minlength=rows)
        h, at = w.windows(5)
        h += mix(w.row[at].astype(np.uint64))
    cover = np.zeros(len(w.hash) + 6, np.int64)
    twice = at[np.isin(h, repeated(h))]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    n_repeat = np.bincount(w.row[np.cumsum(cover)[: len(w.hash)] > 0], minlength=rows)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    sym, soff = symbols(raw, off)
    logs = np.zeros(len(sym) + 1)
    np.cumsum(-table[grams(sym, soff)], out=logs[1:])
    n = np.diff(soff)
    mean = np.where(n > 0, (logs[soff[1:]] - logs[soff[:-1]]) / np.maximum(n, 1), 0.0)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, n, mean]


DOCUMENT = f"own long, other long, lang string, {METRICS}"


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def scan(docs: DataFrame, model: Model, share: np.ndarray) -> DataFrame:
    """Chunks of (own, other, lang, text), some texts each: their DOCUMENT rows, numbers of words, distinct words with their spelling, and the words' numbers."""
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.values, share))
    names = ["own", "other", "lang", *NAMES]

    def run(batches):
        table, made, held, task, n_chunks = None, [], [], TaskContext.get().partitionId(), 0

        def chunk():
            word, hashes, spelt, count = (np.concatenate([h.pop() for h in held]) for _ in range(4))
            known, _, often, number = distinct(word)
            rank = np.empty(len(known), np.int64)  # frequent words get small numbers, which take less room
            by_count = np.argsort(-often, kind="stable")
            rank[by_count] = np.arange(len(known))
            at = np.searchsorted(known, hashes)
            logs = np.zeros(len(known), np.float16)
            logs[at] = spelt
            batch = pa.Table.from_batches(made).combine_chunks().to_batches()
            row = [(task << 32) + n_chunks, len(word), to_bytes(batch[0]), packed(count), packed_sorted(known), packed(rank), logs.tobytes(), packed(rank[number])]
            made.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=CHUNK_NAMES)

        for b in batches:
            if table is None:
                keys, values, share = sent.value
                table = Model(keys, values).table()
            raw, off = utf8(b.column(3))
            for lo, hi in slices(off):
                part, mine = b.slice(lo, hi - lo), off[lo : hi + 1]
                made.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(x) for x in measure(raw, mine, table))], names=names))
                start, end, row, word = words_of(raw, mine)
                hashes, at, *_ = distinct(word)
                held.append([np.bincount(row, minlength=hi - lo), spelling(raw[mine[0] : mine[-1]], start[at], end[at], table, share).astype(np.float16), hashes, word])
                if sum(len(h[-1]) for h in held) >= CHUNK_WORDS:
                    yield chunk()
                    n_chunks += 1
                    give_back()
        if held:
            yield chunk()
        give_back()

    return docs.select("own", "other", "lang", "text").mapInArrow(run, CHUNK)


CHUNK = "chunk long, n_words long, documents binary, counts binary, known binary, rank binary, spelt binary, words binary"
CHUNK_NAMES = [x.split()[0] for x in CHUNK.split(", ")]


class Chunk:
    """One row of CHUNK: `hash` of each distinct word by its number, then 0 for what stands before a text; `word` and `context`, the numbers of
    each word and of the one before it; `count`, how many words each text has."""

    def __init__(self, row: dict):
        known, rank = unpacked_sorted(row["known"]), unpacked(row["rank"]).astype(np.int32)
        self.hash = np.zeros(len(known) + 1, np.uint64)
        self.hash[rank] = known
        self.spelt = np.zeros(len(known) + 1)
        self.spelt[rank] = np.frombuffer(row["spelt"], np.float16)
        count = unpacked(row["counts"]).astype(np.int64)
        self.word = unpacked(row.pop("words")).astype(np.int32)
        self.count = count
        self.context = np.concatenate([np.array([len(known)], np.int32), self.word[:-1]])[: len(self.word)]
        first = np.cumsum(count) - count
        self.context[first[count > 0]] = len(known)
        # words in ascending order of their hashes, with 0 before them
        self.keys = np.concatenate([[np.uint64(0)], known])
        self.order = np.concatenate([[len(known)], rank]).astype(np.int64)

    def pairs(self, bits: int) -> np.ndarray:
        out = np.empty(len(self.word), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(out), 1 << 18):
                part = slice(lo, lo + (1 << 18))
                out[part] = mix(self.hash[self.context[part]] * np.uint64(0x9FB21C651E98DF25) + self.hash[self.word[part]]) >> np.uint64(64 - bits)
        return out


def of_chunks(chunks: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run(row of `columns`) -> record batches, for each chunk."""

    def go(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from run({c: b.column(j)[i].as_py() for j, c in enumerate(columns)})
                give_back()

    return chunks.select(*columns).mapInArrow(go, schema)


def count_pairs(chunks: DataFrame, bits: int, lead: int, scratch: Scratch) -> DataFrame:
    """Answers to all chunks: the corpus count of each of their distinct pairs."""

    def ask(row):
        keys, _, n, _ = distinct(Chunk(row).pairs(bits))
        if rows := list(requests(row["chunk"], keys, [n], bits, lead)):
            yield request_batch(rows)

    return add_up(of_chunks(chunks, ["chunk", "counts", "known", "rank", "spelt", "words"], ask, REQUEST), scratch)


def count_words(told: DataFrame, bits: int, lead: int, scratch: Scratch) -> DataFrame:
    """Answers to all chunks: for each of their words, how often it stands before another, before how many it does once, twice, more often, and after how many."""

    def ask(row):
        c = Chunk(row)
        first, (n,) = joined(row["pairs"])
        at = distinct(c.pairs(bits))[1]
        size = len(c.hash)
        stats = [np.bincount(c.context, minlength=size)]
        stats += [np.bincount(c.context[at[first & (np.minimum(n, 3) == k)]], minlength=size) for k in (1, 2, 3)]
        stats.append(np.bincount(c.word[at[first]], minlength=size))
        if rows := list(requests(row["chunk"], c.keys, [s[c.order] for s in stats], WORD_BITS, lead)):
            yield request_batch(rows)

    return add_up(of_chunks(told, ["chunk", "counts", "known", "rank", "spelt", "words", "pairs"], ask, REQUEST), scratch, of=4)


def pair_costs(n, total, freed, kinds, spelt, cut_pair, cut_word, all_kinds: int, all_freed: float) -> np.ndarray:
    """Negative log probability of a word after another, without one occurrence of the pair: n of the pair, total and freed mass of the
    context, kinds of contexts and log of the spelling of the word."""
    take, lower = (lambda x, c=c: c[np.clip(x, 0, 3).astype(np.int64)] for c in (cut_pair, cut_word))
    left, once = total - 1.0, (n == 1).astype(float)
    fewer, others = kinds - once, np.maximum(all_kinds - once, 1)  # a pair met once is one context less of its word
    some = left > 0
    left = np.where(some, left, 1)
    seen = np.where(some, (n - 1 - take(n - 1)) / left, 0.0)
    back = np.where(some, (freed - take(n) + take(n - 1)) / left, 1.0)
    share = np.where(all_kinds > once, (fewer - lower(fewer)) / others, 0.0)
    low = np.where(all_kinds > once, (all_freed - lower(kinds) + lower(fewer)) / others, 1.0)
    with np.errstate(divide="ignore"):
        return -np.logaddexp(np.log(np.maximum(seen + back * share, 0)), np.log(np.maximum(back * low, 1e-300)) + spelt)


def score_chunks(told: DataFrame, bits: int, of_pairs: list[int], of_words: list[int]) -> DataFrame:
    """The DOCUMENT rows of all chunks, with `cost`, the sum over their words."""
    cut_pair, cut_word = cuts([0, *of_pairs[2:]]), cuts([0, *of_words[2:]])
    n_words, all_kinds, one, two = of_words[:4]
    # words that follow nothing (what stands before a text) have kinds 0 and free nothing
    all_freed = cut_word[1] * one + cut_word[2] * two + cut_word[3] * max(n_words - 1 - one - two, 0)
    names = ["own", "other", "lang", *NAMES, "cost"]

    def run(row):
        c = Chunk(row)
        keys, at, _, inverse = distinct(c.pairs(bits))
        cost = np.zeros(0)
        if len(keys):
            n = joined(row.pop("pairs"))[1][0]
            stats = np.zeros((5, len(c.hash)))
            for i, s in enumerate(joined(row.pop("words_told"))[1]):
                stats[i, c.order] = s
            freed = cut_pair[1:] @ stats[1:4]
            cost = np.empty(len(keys))
            for lo in range(0, len(keys), 1 << 18):
                part = slice(lo, lo + (1 << 18))
                context, word = c.context[at[part]], c.word[at[part]]
                cost[part] = pair_costs(n[part].astype(float), stats[0, context], freed[context], stats[4, word], c.spelt[word], cut_pair, cut_word, all_kinds, all_freed)
            cost = cost[inverse]
        with pa.ipc.open_stream(row["documents"]) as stream:
            for b in stream:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.bincount(np.repeat(np.arange(len(c.count), dtype=np.int32), c.count), cost, len(c.count)).astype(float))], names=names)

    return of_chunks(told, ["chunk", "documents", "counts", "known", "rank", "spelt", "words", "pairs", "words_told"], run, f"{DOCUMENT}, cost double")


def own_hashes(text: str, lang: str) -> list[Column]:
    """Two hashes that stand for a text and its language."""
    return [F.xxhash64(text, lang), F.xxhash64(lang, F.lit(1), text)]


def score_texts(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang") -> DataFrame:
    """own, other (hashes of text and language), lang, METRICS, log_word_perplexity (a symbol, as log_perplexity is) and copies, a row for each text and language."""
    own, other = own_hashes(text, lang)
    source = docs.select(own.alias("own"), other.alias("other"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    grams_, points_ = count_spelling(source)
    chunks = scratch.bucketed(scan(source, fit_model(grams_), shares(points_)), "chunk", int(grams_.sum()) // BUCKET_SYMBOLS)
    n_words = int(chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, lead = min(64, n_words.bit_length() + PAIR_BITS), bucket_bits(n_words, partitions)
    pairs = count_pairs(chunks, bits, lead, scratch)
    scratch.reclaim()
    asked = by_chunk(pairs, "pairs")
    words = count_words(chunks.join(asked, "chunk"), bits, lead, scratch)
    scratch.reclaim()
    told = chunks.join(asked, "chunk", "left").join(by_chunk(words, "words_told"), "chunk", "left")
    scored = score_chunks(told, bits, histogram(pairs), histogram(words))
    # copies score alike in one chunk; in several, alike but for the rounding of sums
    texts = scored.groupBy("own", "other").agg(F.min("lang").alias("lang"), *(F.min(c).alias(c) for c in [*NAMES, "cost"]), F.count("*").alias("copies"))
    out = texts.withColumn("log_word_perplexity", F.col("cost") / F.greatest("n_scored", F.lit(1)))
    return scratch.table(out.select("own", "other", "lang", *NAMES, "log_word_perplexity", "copies"))


def quartiles(texts: DataFrame, by: list[str], of: str, name: str) -> DataFrame:
    """by..., n, and the quartiles of a column as an array, exact up to the width of a bin and in any order of the rows."""
    bins = texts.groupBy(*by, F.floor(F.col(of) * BINS).alias("bin")).agg(F.sum("copies").alias("m"))
    whole = W.partitionBy(*by, F.lit(0))  # a row for each bin that occurs: thousands at most
    upto = bins.withColumn("upto", F.sum("m").over(whole.orderBy("bin"))).withColumn("n", F.sum("m").over(whole))
    at = [F.min(F.when(F.col("upto") >= q * F.col("n"), (F.col("bin") + 0.5) / BINS)) for q in (0.25, 0.5, 0.75)]
    return upto.groupBy(*by).agg(F.first("n").alias("n"), F.array(*at).alias(name))


def fit_bands(texts: DataFrame) -> DataFrame:
    """lang, low, mid, high (log perplexity), word_mid, word_high (that of words) from what score_texts gives, each text as often as it occurs.

    The quartiles of every language are drawn towards those of all documents, the more the fewer documents it has. Without any text that
    passes the base rules there is no row.
    """
    scored = texts.filter("not base_failed").withColumn("lang", F.struct("lang"))  # so that a null language is joined as any other
    of = lambda by: [quartiles(scored, by, c, n) for c, n in (("log_perplexity", "q"), ("log_word_perplexity", "w"))]
    (q, w), (all_q, all_w) = of(["lang"]), of([])
    every = all_q.select(F.col("q").alias("all_q")).crossJoin(all_w.select(F.col("w").alias("all_w")))  # one row each
    q = q.join(w.drop("n"), "lang").crossJoin(F.broadcast(every))
    own = 1 / (1 + F.pow(LEAST_DOCS / F.col("n"), F.lit(2)))
    shrunk = lambda c: F.zip_with(c, f"all_{c}", lambda x, y: own * x + (1 - own) * y).alias(c)
    q = q.select(F.col("lang.lang").alias("lang"), shrunk("q"), shrunk("w"))
    q = q.withColumn("spread", F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(LEAST_SPREAD)))
    # of the upper half only, as copies widen the lower one
    words = F.col("w")[1] + UPPER_WIDTH * F.greatest((F.col("w")[2] - F.col("w")[1]) / 0.6745, F.lit(LEAST_SPREAD))
    return q.select("lang", (F.col("q")[1] - LOWER_WIDTH * F.col("spread")).alias("low"), F.col("q")[1].alias("mid"), (F.col("q")[1] + UPPER_WIDTH * F.col("spread")).alias("high"), F.col("w")[1].alias("word_mid"), words.alias("word_high"))


def judge_texts(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """texts with in_band. Only where a language has no text that passes the base rules there is no band; none of its texts is kept anyway."""
    few = bands.count() <= MAX_BROADCAST_LANGUAGES
    right = bands.withColumnRenamed("lang", "of_lang")
    rows = texts.join(F.broadcast(right) if few else right, texts["lang"].eqNullSafe(right["of_lang"]), "left")
    wider = F.sqrt(1 + SHORT / F.greatest(F.col("n_scored"), F.lit(1)))
    x, word = F.col("log_perplexity") - F.col("mid"), F.col("log_word_perplexity") - F.col("word_mid")
    inside = (x >= (F.col("low") - F.col("mid")) * wider) & (x <= (F.col("high") - F.col("mid")) * wider) & (word <= (F.col("word_high") - F.col("word_mid")) * wider)
    return rows.withColumn("in_band", F.coalesce(inside, F.lit(True))).select(*texts.columns, "in_band")


def judge_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of `docs`, METRICS, log_word_perplexity double, in_band boolean, kept boolean.

    kept is false if base_failed, or if a log perplexity leaves its language's band. Null and empty texts have no words and
    fail; long texts are read whole; repeated rows are judged alike (and each counts in the model); an empty table gives
    an empty result; columns named as the new ones are replaced. Every language (null is one) has its own band,
    drawn towards all documents by how few of its documents pass the base rules.
    """
    made = [*NAMES, "log_word_perplexity", "in_band", "kept"]
    docs = docs.drop(*made)
    scratch = Scratch(docs.sparkSession, "quality")
    texts = score_texts(docs, scratch, text, lang)
    scratch.keep(texts)
    bands = scratch.table(fit_bands(texts))
    right = scratch.table(judge_texts(texts, bands).drop("lang", "copies"))
    scratch.keep(right)
    own, other = free_names(docs, "own", "other")
    right = right.withColumnsRenamed({"own": own, "other": other}).withColumn("kept", F.expr("not base_failed and in_band"))
    a, b = own_hashes(text, lang)
    return docs.withColumn(own, a).withColumn(other, b).join(right, [own, other]).select(*docs.columns, *made)
