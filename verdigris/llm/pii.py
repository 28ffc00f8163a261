"""Personal data: base patterns, and identifiers that bootstrapped contexts discover.

Emails, IP addresses, card and phone numbers found by the base patterns are seed instances, and so are secrets: long values of letters and digits that
are assigned to a name such as token or password. The words around an instance
are lexical patterns (the last word before it; the last two; the next one); what stands before an instance in its own word, as in `acct=123`, is the last word. Spark counts, for each pattern, how often a labelled instance
stands by it and how often anything does, over the whole corpus; the share is the pattern's confidence. Patterns with enough distinct instances
and a high confidence score the unlabelled identifier-like spans that stand by them (noisy-or over patterns): every run of a word's characters, and
digits in groups over several words. What passes is labelled and the next round starts from the larger set, until a round labels nothing new.

The patterns whose occurrences a pass counts are sent to the tasks as a bitmap of fixed size; counts of patterns that only
share its bits are dropped by the exact join that follows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Scratch, Words, free_names, give_back, mix, slices, utf8

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds of the base patterns come first.
BASE_KINDS, SECRET_KIND = 4, 4
#: Least distinct instances and least confidence of a pattern; least score of an instance.
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE = 3, 0.8, 0.8
#: Digits that make a token identifier-like (an at sign does too).
LEAST_DIGITS = 4
BITMAP_BITS = 1 << 24

DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: A value of 16 characters or more, with letters and digits, that is assigned to a name of a secret.
SECRET = re.compile(rb"""(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9](?:[A-Za-z0-9_+/.=-]*[A-Za-z0-9])?)""")
LEAST_SECRET = 16
CORE = re.compile(rb"[A-Za-z0-9](?:[A-Za-z0-9._%+@:/-]*[A-Za-z0-9])?")
#: Digits in groups, maybe over several words, as phones and cards are written; as long as those at most.
GROUPS = re.compile(rb"(?<![A-Za-z0-9._%+@:/-])\(?[0-9](?:[ ().-]{0,3}+[0-9])++")
MAX_GROUPS_DIGITS, MAX_GROUPS_BYTES = 19, 40
IS_CORE = np.zeros(256, bool)
IS_CORE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@:/-")] = True
IS_LETTER = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
IS_LOCAL = np.zeros(256, bool)
IS_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
DIGITS = frozenset(b"0123456789")


def luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: bytes):
    """An email ends its local part at an at sign, so each at sign is tried once, with the longest local part that is free."""
    end, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and IS_LOCAL[text[start - 1]]:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find(b"@", max(at + 1, end))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(b".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = [c - 48 for c in m[0] if c in DIGITS]
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of seed secrets."""
    found = (m.span(1) for m in SECRET.finditer(text))
    return [(a, SECRET_KIND, z) for a, z in found if z - a >= LEAST_SECRET and any(c in DIGITS for c in text[a:z]) and not text[a:z].isdigit()]


def next_words(w: Words) -> np.ndarray:
    """For every word: hash of the word to its right in the same text (none counts as a word)."""
    after = np.zeros(len(w.hash), np.uint64)
    after[:-1] = np.where(w.row[1:] == w.row[:-1], w.hash[1:], np.uint64(0))
    return mix(after ^ np.uint64(0xA0761D6478BD642F))


def contexts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For every word: hash of the one word and of the two words to its left in the same text (none counts as a word)."""
    n = len(w.hash)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:] = np.where(w.row[1:] == w.row[:-1], w.hash[:-1], np.uint64(0))
    two[2:] = np.where(w.row[2:] == w.row[:-2], w.hash[:-2], np.uint64(0))
    with np.errstate(over="ignore"):
        return mix(one + np.uint64(1)), mix(one * np.uint64(0x9FB21C651E98DF25) + two + np.uint64(2))


def left_of(w: Words, one: np.ndarray, two: np.ndarray, at: np.ndarray, last: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of spans that begin at bytes `at`, and which of them have their last word inside their own.

    `last` and `outside` are those of `marks`: letters and digits before `at` in its word count if a character that no core holds follows them.
    """
    word = np.searchsorted(w.start, at, "right") - 1
    before = np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
    inside = before >= w.start[word]
    inside &= outside[at] > outside[np.where(inside, before + 1, at)]
    word_one, word_two = one[word], two[word]
    if inside.any():
        i = word[inside]
        prefix = w.span_hash(w.start[i], before[inside] + 1)
        previous = np.where((i > 0) & (w.row[i - 1] == w.row[i]), w.hash[i - 1], np.uint64(0))
        with np.errstate(over="ignore"):
            word_one[inside], word_two[inside] = mix(prefix + np.uint64(1)), mix(prefix * np.uint64(0x9FB21C651E98DF25) + previous + np.uint64(2))
    return word_one, word_two, inside


def marks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The last letter or digit up to each byte, and how many bytes before each that no core holds."""
    last = np.maximum.accumulate(np.where(IS_LETTER[w.data], np.arange(len(w.data)), -1)) if len(w.data) else np.zeros(0, np.int64)
    outside = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(~IS_CORE[w.data], out=outside[1:])
    return last, outside


def core_starts(w: Words) -> np.ndarray:
    """Where the cores begin: the first letter or digit of each run that a core may hold, in one text."""
    core, letter = IS_CORE[w.data], IS_CORE[w.data] & IS_LETTER[w.data]
    new = np.zeros(len(core) + 1, bool)
    new[:-1] = core
    new[1:-1] &= ~core[:-1]
    new[w.off] = True
    run = np.cumsum(new[:-1])
    at = np.flatnonzero(letter)
    first = np.ones(len(at), bool)
    first[1:] = run[at[1:]] != run[at[:-1]]
    return at[first]


def groups(text: bytes):
    """Digits in groups over several words."""
    for m in GROUPS.finditer(text):
        a, z = m.span()
        if text[z : z + 1].isalnum():
            z = a + len(text[a : max(text.rfind(b" ", a, z), a)].rstrip(b" (.-"))
        elif text[z : z + 1] == b")" and b"(" in text[text.rfind(b" ", a, z) + 1 : z]:
            z += 1
        what = text[a:z]
        if b" " in what and z - a <= MAX_GROUPS_BYTES and LEAST_DIGITS <= sum(c in DIGITS for c in what) <= MAX_GROUPS_DIGITS:
            yield a, z


def occurrences(docs: DataFrame) -> DataFrame:
    """For each row of (doc_id, own, other, text): base spans, and the instances (labelled or not) with their contexts, offsets in code points."""
    digit = np.zeros(256, bool)
    digit[list(b"0123456789")] = True

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(3))
            for lo, hi in slices(off):
                w = Words(raw, off[lo : hi + 1])
                one, two = contexts(w)
                after = next_words(w)
                points = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
                digits = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum(digit[w.data], out=digits[1:])
                ats = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum(w.data == 64, out=ats[1:])
                likely = (digits[w.end] - digits[w.start] >= LEAST_DIGITS) | (ats[w.end] > ats[w.start])
                last, outside = marks(w)
                base, n_base, found, n_found, starts, ends = [], [], [], [], [], []
                for r in range(hi - lo):
                    s, e = int(w.off[r]), int(w.off[r + 1])
                    spans, mine = [], []
                    if digits[e] > digits[s] or ats[e] > ats[s]:
                        text = w.data[s:e].tobytes()
                        spans = base_spans(text)
                        seeds = spans + secret_spans(text)
                        mine = [(a, z, k, text[a:z]) for a, k, z in seeds]
                        taken = sorted((a, z) for a, _, z in seeds)
                        for i in range(int(w.first[r]), int(w.first[r + 1])) if likely[w.first[r] : w.first[r + 1]].any() else ():
                            if likely[i]:
                                for core in CORE.finditer(text, int(w.start[i]) - s, int(w.end[i]) - s):
                                    if (sum(c in DIGITS for c in core[0]) >= LEAST_DIGITS or b"@" in core[0]) and not any(a < core.end() and core.start() < z for a, z in taken):
                                        mine.append((core.start(), core.end(), -1, core[0]))
                        if digits[e] - digits[s] >= LEAST_DIGITS:
                            mine += [(a, z, -1, text[a:z]) for a, z in groups(text) if not any(x < z and a < y for x, y in taken)]
                    n_base.append(len(spans))
                    n_found.append(len(mine))
                    p0 = int(points[s])
                    base += [(int(points[s + a]) - p0, k, int(points[s + z]) - p0) for a, k, z in spans]
                    for a, z, k, what in mine:
                        starts.append(s + a)
                        ends.append(s + z)
                        found.append((int(points[s + a]) - p0, int(points[s + z]) - p0, k, what.decode("utf-8", "replace")))
                left = left_of(w, one, two, np.array(starts, np.int64), last, outside)[:2]
                right = after[np.searchsorted(w.start, np.array(ends, np.int64) - 1, "right") - 1]
                column = lambda rows, i, t: pa.array([x[i] for x in rows], t)
                lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo),
                    b.column(1).slice(lo, hi - lo),
                    b.column(2).slice(lo, hi - lo),
                    lists(n_base, pa.StructArray.from_arrays([column(base, i, pa.int32()) for i in range(3)], ["start", "kind", "end"])),
                    lists(n_found, pa.StructArray.from_arrays([*(column(found, i, t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))), *(pa.array(x.view(np.int64)) for x in (*left, right))], ["start", "end", "kind", "what", "one", "two", "right"])),
                ], names=["doc_id", "own", "other", "base", "found"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, own long, other long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,kind:int,what:string,one:long,two:long,right:long>>")


def count_contexts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(pattern, n): how often each context, of a word or of a core inside one, that the bitmap may hold occurs in (text)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        held: list[np.ndarray] = []

        def counted():
            if held:
                value, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["pattern", "n"])
                held.clear()

        for b in batches:
            raw, off = utf8(b.column(0))
            for lo, hi in slices(off):
                w = Words(raw, off[lo : hi + 1])
                one, two = contexts(w)
                more = left_of(w, one, two, core_starts(w), *marks(w))
                for pattern in (one, two, next_words(w), more[0][more[2]], more[1][more[2]]):
                    at = (pattern % np.uint64(BITMAP_BITS)).astype(np.int64)
                    held.append(pattern[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])
                if sum(map(len, held)) > 2_000_000:
                    yield from counted()
        yield from counted()
        give_back()

    return docs.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def bitmap_of(patterns: DataFrame) -> np.ndarray:
    """The bitmap of a column `pattern`, put together by Spark; the driver gets its 2**18 words at most."""
    # unsigned remainder of a signed hash: BITMAP_BITS is a power of two, so it is the low bits
    slot = F.col("pattern").bitwiseAND(BITMAP_BITS - 1)
    words = patterns.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(pattern & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def own_hashes(key: str, text: str) -> list[Column]:
    """Two hashes that stand for a row."""
    return [F.xxhash64(key, text), F.xxhash64(text, F.lit(1), key)]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: list[int] | None = None) -> DataFrame:
    """doc_id, own, other (hashes of the row), base and spans (arrays of start, kind index into KINDS, end; code points, end exclusive), a row for each row of `docs`.

    Null and empty texts have no spans; rows alike in key and text get the same spans (and each counts); texts are read whole; null keys are
    allowed; of kinds that tie for a span the first one holds; other columns are ignored; an empty table gives an empty result. `rounds`, if given, is told
    how many distinct instances each round has labelled.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    own, other = own_hashes(key, text)
    source = docs.select(F.col(key).alias("doc_id"), own.alias("own"), other.alias("other"), F.col(text).alias("text"))
    read = scratch.table(occurrences(source))
    flat = read.select("own", "other", F.explode("found").alias("x")).select("own", "other", "x.*")
    flat = flat.groupBy(*flat.columns).agg(F.count("*").alias("times"))  # repeated rows
    flat = scratch.table(flat.withColumn("seed", F.col("kind").between(0, BASE_KINDS - 1)).withColumn("inst", F.xxhash64("what")).drop("what"))
    labelled = lambda flat, best: flat.join(best, F.col("inst") == F.col("i"), "left").withColumn("kind", F.when(F.col("kind") < 0, F.coalesce("as", F.lit(-1))).otherwise(F.col("kind"))).drop("i", "as")
    # a seed is one wherever it stands
    read_, flat = flat, scratch.table(labelled(flat, flat.filter("kind >= 0").groupBy(F.col("inst").alias("i")).agg(F.min("kind").alias("as"))))
    scratch.drop(read_)
    while not flat.filter("kind < 0").isEmpty():  # labels only grow, so this ends
        edges = flat.select("inst", "kind", "times", F.explode(F.array("one", "two", "right")).alias("pattern")).groupBy("pattern", "kind", "inst").agg(F.sum("times").alias("n"))
        edges = scratch.table(edges)
        known = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("n").alias("hits"))
        known = scratch.table(known.filter(F.col("support") >= LEAST_SUPPORT))
        followed = count_contexts(source.select("text"), bitmap_of(known))
        sure = known.join(followed, "pattern").withColumn("confidence", F.least(F.col("hits") / F.col("n"), F.lit(1.0))).filter(F.col("confidence") >= LEAST_CONFIDENCE)
        score = 1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        scored = edges.filter("kind < 0").select("pattern", "inst").join(sure.select("pattern", F.col("kind").alias("as"), "confidence"), "pattern").groupBy("inst", "as").agg(score.alias("score"))
        best = scored.groupBy("inst").agg(F.max(F.struct("score", -F.col("as"))).alias("b")).select("inst", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("as")).filter(F.col("score") >= LEAST_SCORE)
        best = scratch.table(best.select(F.col("inst").alias("i"), "as"))
        n = best.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        before, flat = flat, scratch.table(labelled(flat, best))
        scratch.drop(before, edges, known, best)
    scratch.keep(read, flat)
    new = flat.filter("not seed and kind >= 0").groupBy(F.col("own").alias("o"), F.col("other").alias("p")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    # a part of a longer span says nothing more
    new = new.withColumn("more", F.expr("filter(more, x -> not exists(more, y -> y.start <= x.start and x.end <= y.end and y.end - y.start > x.end - x.start))"))
    out = read.join(new, (F.col("own") == F.col("o")) & (F.col("other") == F.col("p")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return out.select("doc_id", "own", "other", "base", spans.alias("spans"))


def written(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(BASE_KINDS)), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def mask_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each span of personal data in `text` replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null, empty and clean texts stay as they are; repeated rows are masked alike; long texts are masked whole; null keys are allowed; all columns stay,
    whatever their names; an empty table gives an empty result.
    """
    mine, mine_too, theirs, theirs_too, found_at = free_names(docs, "mine", "mine_too", "theirs", "theirs_too", "found")
    found = find_personal_data(docs, key, text).filter(F.size("spans") > 0).groupBy(F.col("own").alias(theirs), F.col("other").alias(theirs_too)).agg(F.first("spans").alias(found_at))
    columns = docs.columns
    own, other = own_hashes(key, text)
    joined = docs.withColumn(mine, own).withColumn(mine_too, other).join(found, (F.col(mine) == F.col(theirs)) & (F.col(mine_too) == F.col(theirs_too)), "left")
    at, spans_at = columns.index(text), len(columns)

    def run(batches):
        for b in batches:
            for lo, hi in slices(utf8(b.column(at))[1]):
                part, made = b.slice(lo, hi - lo), []
                for t, spans in zip(part.column(at).to_pylist(), part.column(spans_at).to_pylist()):
                    if t and spans:
                        parts, end = [], 0
                        for s in spans:
                            if s["start"] >= end:
                                parts += [t[end : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                            end = max(end, s["end"])
                        t = "".join([*parts, t[end:]])
                    made.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if i == at else part.column(i) for i in range(len(columns))], names=columns)

    return joined.select(*columns, found_at).mapInArrow(run, docs.schema)
