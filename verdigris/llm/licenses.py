"""Licence notices in texts, with a bounded number of wrong characters.

A notice of n characters may differ by n // ERROR_EVERY edits. Cut into one piece more than that, at least one piece of any such occurrence is unharmed, so an
automaton over all pieces of all notices names every place where an occurrence can be. There, and only there, the fuzzy matcher of the `regex` library looks for the
notice within its edits and between words, and says where it begins and ends. A notice of no edits is one piece: its places are those where it stands exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import LOWER, list_array, slices, utf8

#: One edit is allowed for so many characters of a notice.
ERROR_EVERY = 12
# Phrases that count wherever their words stand, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices as words, and their labels. Where notices overlap, the one nearest to the text decides.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "distributed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "spdx license identifier mit": "mit",
    "licensed under the apache license version 2 0": "apache",
    "released under the apache license version 2 0": "apache",
    "spdx license identifier apache 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "released under the gnu general public license": "gpl",
    "spdx license identifier gpl 3 0": "gpl",
    "spdx license identifier gpl 2 0": "gpl",
    "gnu lesser general public license": "lgpl",
    "spdx license identifier lgpl 2 1": "lgpl",
    "gnu affero general public license": "agpl",
    "spdx license identifier agpl 3 0": "agpl",
    "mozilla public license version 2 0": "mpl",
    "subject to the terms of the mozilla public license": "mpl",
    "eclipse public license version 2 0": "epl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the bsd license": "bsd",
    "released under the bsd license": "bsd",
    "licensed under the 3 clause bsd license": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under the isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1 0": "boost",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "dedicated to the public domain under cc0 1 0": "cc0",
}

#: Characters of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, by bytes of UTF-8, after lower-casing A-Z.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
SPANS = "array<struct<label: string, start: long, end: long, word: long, words: long, edits: int, base: boolean>>"


@dataclass(frozen=True)
class Notice:
    """Words joined by single blanks; base: counted wherever it stands, without edits."""

    text: str
    label: str
    edits: int
    base: bool


def notice_list(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, error_every: int = ERROR_EVERY) -> list[Notice]:
    return [Notice(t, label, 0, True) for t, label in phrases.items()] + [Notice(t, label, len(t) // error_every, False) for t, label in notices.items()]


def as_bytes(text: str) -> str:
    """A string with a character for each byte of UTF-8, so that places in it are places in the bytes."""
    return text.encode().decode("latin-1")


class Finder:
    """The automaton over all pieces, and the fuzzy pattern of each notice."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices, pieces = notices, {}
        for i, notice in enumerate(notices):
            cut = [len(notice.text) * k // (notice.edits + 1) for k in range(notice.edits + 2)]
            for lo, hi in zip(cut, cut[1:]):
                pieces.setdefault(as_bytes(notice.text[lo:hi]), []).append((i, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()
        # a blank or an edge must stand on both sides; (?e) goes on from the first fit to the nearest one there
        self.patterns = [regex.compile(rf"(?e)(?<=[ \n])(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?=[ \n])") if n.edits else None for n in notices]

    def matches(self, data: bytes):
        """(notice, start, end, edits) of the matches in `data`: texts as words joined by single blanks, with a newline before, between and behind them. Bytes."""
        text, windows = data.decode("latin-1"), {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last + 1 - size
            for i, offset in owners:
                notice = self.notices[i]
                if not notice.edits:
                    if text[at - 1] in " \n" and text[at + size] in " \n":
                        yield i, at, at + size, 0
                    continue
                # up to four bytes for each character before and behind the piece that an edit may have made
                lo = at - 4 * (offset + notice.edits) - 1
                hi = last + 1 + 4 * (len(notice.text) - offset + notice.edits) + 1
                held = windows.setdefault(i, [])
                if held and lo <= held[-1][1]:
                    held[-1][1] = max(hi, held[-1][1])
                    held[-1][0] = min(lo, held[-1][0])
                else:
                    held.append([lo, hi])
        for i, held in windows.items():
            for lo, hi in held:
                lo, hi = max(lo, 0), min(hi, len(data))
                while lo and data[lo] & 0xC0 == 0x80:  # whole characters
                    lo -= 1
                while hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi += 1
                window = data[lo:hi].decode()
                for m in self.patterns[i].finditer(window):
                    start = lo + len(window[: m.start()].encode())
                    yield i, start, start + len(m.group().encode()), sum(m.fuzzy_counts)


def nearest_only(found: list[tuple], notices: tuple[Notice, ...]) -> list[tuple]:
    """Of fuzzy matches that overlap, those nearest to their notice (by share of edits, then the longer one, then the first in place and list). Base ones all stay."""
    out, taken = [m for m in found if notices[m[0]].base], []
    for m in sorted((m for m in found if not notices[m[0]].base), key=lambda m: (m[3] / len(notices[m[0]].text), m[1] - m[2], m[1], m[0])):
        if all(m[2] <= lo or m[1] >= hi for lo, hi in taken):
            taken.append((m[1], m[2]))
            out.append(m)
    return sorted(out, key=lambda m: (m[1], m[0]))


def scan(raw: np.ndarray, off: np.ndarray, finder: Finder):
    """(words, matches) of a run of texts; matches: row -> [(notice, start, end, word, words, edits)], start and end in code points of the text."""
    base = int(off[0])
    data, off = LOWER[raw[base : int(off[-1])]], off - base
    word = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, off)  # the word at which each text begins
    words = np.diff(first)
    # words joined by blanks, texts by newlines: word k is at places[k], behind as many separators as words and texts before it
    row = np.searchsorted(off, starts, "right") - 1
    sizes = ends - starts
    places = np.cumsum(sizes) - sizes + np.arange(len(starts)) + 1
    joined = np.full(int(sizes.sum()) + len(starts) + 1, ord(" "), np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(starts)), sizes) + 1] = data[word]
    joined[0] = joined[-1] = ord("\n")
    if len(starts):
        joined[places[1:][np.diff(row) > 0] - 1] = ord("\n")
    found: dict[int, list[tuple]] = {}
    for i, start, end, edits in finder.matches(joined.tobytes()):
        k = int(np.searchsorted(places, start, "right")) - 1
        found.setdefault(int(row[k]), []).append((i, start, end, edits, k))
    for r, held in found.items():
        text, out = data[off[r] : off[r + 1]], []
        for i, start, end, edits, k in nearest_only(held, finder.notices):
            last = int(np.searchsorted(places, end, "left")) - 1
            points = lambda at: int(np.count_nonzero((text[: at - off[r]] & 0xC0) != 0x80))
            out.append((i, points(starts[k]), points(ends[last]), k - int(first[r]), last - k + 1, edits))
        found[r] = out
    return words, found


def find_notices(docs: DataFrame, text: str = "text", notices: list[Notice] | None = None) -> DataFrame:
    """The columns of `docs` and n_words long, spans (label, start and end in code points of the text, first word and number of words, edits, base), score double.

    score is that of the nearest match, 1 - edits / characters of its notice: 1 for an exact one, 0 for none. A null or empty text has no words; texts are scanned whole, however
    long; a match does not reach over two texts; repeated rows are judged alike; columns of the new names are replaced; an empty table gives an empty result.
    """
    notices = tuple(notice_list() if notices is None else notices)
    kept = docs.drop("n_words", "spans", "score")
    given = kept.columns
    fields = ["label", "start", "end", "word", "words", "edits", "base"]

    def run(batches):
        finder = Finder(notices)
        for batch in batches:
            raw, off = utf8(batch.column(text))
            for lo, hi in slices(off):
                words, found = scan(raw, off[lo : hi + 1], finder)
                rows = [found.get(r, []) for r in range(hi - lo)]
                flat = [m for x in rows for m in x]
                columns = [[notices[m[0]].label for m in flat], *([m[i] for m in flat] for i in range(1, 6)), [notices[m[0]].base for m in flat]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)
                spans = pa.ListArray.from_arrays(list_array(np.zeros(len(flat), np.int8), [len(x) for x in rows]).offsets, struct)
                score = [max((1 - m[5] / len(notices[m[0]].text) for m in x), default=0.0) for x in rows]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(words, pa.int64()), spans, pa.array(score, pa.float64())], names=[*given, "n_words", "spans", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, n_words long, spans {SPANS}, score double")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; nulls and odd texts as in `find_notices`."""
    found = find_notices(docs.select(F.col(key), F.col(text)), text)
    base = F.filter("spans", lambda s: s["base"])
    at = F.transform(base, lambda s: s["word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string")))
    return found.select(F.col(key), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score", F.array_join(shown, ",").alias("spans"))
