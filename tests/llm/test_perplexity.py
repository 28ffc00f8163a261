import random
import re

import numpy as np
import pyarrow as pa

from verdigris.llm import perplexity as q
from verdigris.llm.common import slices, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_figures_are_those_of_brute_force():
    r = random.Random(2)
    parts = ["a", "b", "a b c d e ", "\n", " ", "\t", "é", "世", "#", "|x", "a\n", "\x0b", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 60))) for _ in range(600)] + [None, "", "x", "\n\n", "a b c d e " * 200]
    raw, off = utf8(pa.array(texts))
    table = np.zeros(q.SYMBOLS**q.ORDER, np.float32)
    got = [q.measure(raw, off[lo : hi + 1], table) for lo, hi in slices(off, 500)]
    columns = [np.concatenate([g[i] for g in got]) for i in range(5)]
    for i, t in enumerate(texts):
        assert tuple(int(c[i]) for c in columns) == brute(t or ""), repr(t)


def kneser_ney(full):
    """Probability of the last symbol of any gram after the others, by recursion over dictionaries."""
    from collections import Counter

    def level(counts):
        of = Counter(counts.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        cut = [0.0] + [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.1), k - 0.1) if of[k] and of[k + 1] else 0.5 * k for k in (1, 2, 3)]
        return counts, {g: cut[min(n, 3)] for g, n in counts.items()}

    levels = [level(full)]
    while len(next(iter(levels[-1][0]))) > 1:
        levels.append(level(Counter(g[1:] for g in levels[-1][0])))

    def p(gram, i=0):
        if not gram:
            return 1 / q.SYMBOLS
        counts, drop = levels[i]
        after = [g for g in counts if g[:-1] == gram[:-1]]
        rest = p(gram[1:], i + 1)
        if not after:
            return rest
        total = sum(counts[g] for g in after)
        return (counts[gram] - drop[gram]) / total * (gram in counts) + sum(drop[g] for g in after) / total * rest if gram in counts else sum(drop[g] for g in after) / total * rest

    return p


def test_the_model_of_spelling_is_plain_kneser_ney(spark):
    from collections import Counter

    texts = ["the cat sat on the mat with the other cat", "a dog and the cat ran to the old mat", "123 the 45", "\u043f\u0451\u0441"] * 3
    counts, points = q.count_spelling(spark.createDataFrame([(t,) for t in texts], "text string"))
    raw, off = utf8(pa.array(texts))
    flat = q.grams(*q.symbols(raw, off)).tolist()
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == Counter(flat)
    assert {i: n for i, n in enumerate(points.tolist()) if n} == {0x43F: 3, 0x451: 3, 0x441: 3}
    model = q.fit_model(counts)
    p = np.exp(model.table().astype(float)).reshape(-1, q.SYMBOLS)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and (np.diff(model.keys.astype(float)) > 0).all()
    apart = lambda g: tuple(g >> q.BITS * i & q.SYMBOLS - 1 for i in range(q.ORDER - 1, -1, -1))
    plain = kneser_ney(Counter(map(apart, flat)))
    for g in [*set(flat), 5, 777, 123456]:
        assert abs(plain(apart(g)) - p.reshape(-1)[g]) < 1e-6


def test_bands_reject_gibberish_and_keep_prose(spark):
    r = random.Random(3)
    words = ["".join(r.choice(["an", "er", "on", "the", "ing", "ed", "is"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(80)), "en") for i in range(300)]
    rows += [(900, "".join(r.choice("zqxjkvw#%") for _ in range(600)).replace("z", " "), "en"), (901, None, None), (902, "", "en"), (903, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as kept", "0 as n_words")
    out = {x["doc_id"]: x for x in q.judge_documents(docs).collect()}
    assert all(out[i]["kept"] for i in range(300)) and not out[900]["kept"] and not out[901]["kept"] and out[903]["base_failed"]
    assert len(out) == len(rows) and q.judge_documents(docs.limit(0)).count() == 0


def plain_weights(texts):
    """high and low of every pair of words (here split at blanks), from counts without one occurrence of it."""
    from collections import Counter

    c = Counter(p for t in texts for p in zip(["", *t.split()], t.split()))

    def cuts(counts):
        of = Counter(counts)
        y = of[1] / max(of[1] + 2 * of[2], 1)
        d = [0.0] + [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.1), k - 0.1) if of[k] and of[k + 1] else 0.5 * k for k in (1, 2, 3)]
        return lambda n: d[min(n, 3)]

    kinds = Counter(w for _, w in c)
    take, lower = cuts(c.values()), cuts(kinds.values())
    out = {}
    for pair in c:
        less = Counter(c)
        less[pair] -= 1
        less = +less
        follow = {w: n for (v, w), n in less.items() if v == pair[0]}
        k = Counter(w for _, w in less)
        total, types = sum(follow.values()), sum(k.values())
        back = sum(map(take, follow.values())) / total if total else 1.0
        seen = (follow.get(pair[1], 0) - take(follow.get(pair[1], 0))) / total if total else 0.0
        out[pair] = (c[pair], seen + back * (k[pair[1]] - lower(k[pair[1]])) / types, back * sum(map(lower, k.values())) / types)
    return out


def test_words_are_priced_as_by_plain_kneser_ney(spark, monkeypatch):
    from verdigris.llm.common import Scratch

    texts = ["the cat sat on the mat with the other cat", "a dog and the cat ran to the old mat", "\u043a\u043e\u0442 \u0438 \u043f\u0451\u0441", "\u043a\u043e\u0442 \u0438 \u043a\u043e\u0442", "", None] * 2 + ["the end"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    counts, points = q.count_spelling(docs)
    table, share = q.fit_model(counts).table(), q.shares(points)
    weights = plain_weights([t or "" for t in texts])

    def price(t):
        total = 0.0
        for pair in zip(["", *t.split()], t.split()):
            raw = np.frombuffer(pair[1].encode(), np.uint8)
            spelt = np.float16(q.spelling(raw, np.array([0]), np.array([len(raw)]), table, share)[0])
            total -= np.log(weights[pair][1] + weights[pair][2] * np.exp(float(spelt)))
        return total

    found = []
    for words in (1 << 20, 3):  # one chunk a task, and many
        monkeypatch.setattr(q, "CHUNK_WORDS", words)
        got = {r["own"]: r for r in q.score_texts(docs, Scratch(spark, "t")).collect()}
        own = {r["text"]: r["h"] for r in docs.select("text", q.own_hashes("text", "lang")[0].alias("h")).collect()}
        for t in set(texts):
            r = got[own[t]]
            assert abs(r["log_word_perplexity"] * max(r["n_scored"], 1) - price(t or "")) < 1e-6 and r["copies"] == texts.count(t)
        found.append(len(got))
    assert found == [7, 7]


def test_sums_of_hashes_are_those_of_a_counter(spark):
    from collections import Counter

    from verdigris.llm import hashsums
    from verdigris.llm.common import Scratch

    r = random.Random(4)
    chunks = {c: Counter(r.choice([7, 7, r.randrange(1 << 40)] + list(range(50))) << 20 for _ in range(r.randrange(1, 300))) for c in range(9)}
    rows = [x for c, n in chunks.items() for x in hashsums.requests(c, np.array(sorted(n), np.uint64), [np.array([n[k] for k in sorted(n)]), np.ones(len(n), int)], 62, 3)]
    answers = hashsums.add_up(spark.createDataFrame(rows, hashsums.REQUEST), Scratch(spark, "t"))
    total, holders = sum(chunks.values(), Counter()), Counter(k for n in chunks.values() for k in n)
    firsts = Counter()
    for row in hashsums.by_chunk(answers, "x").collect():
        first, (sums, held) = hashsums.joined(row["x"])
        keys = sorted(chunks[row["chunk"]])
        assert sums.tolist() == [total[k] for k in keys] and held.tolist() == [holders[k] for k in keys]
        firsts.update(k for k, f in zip(keys, first) if f)
    assert firsts == Counter(dict.fromkeys(total, 1))
    of = Counter(total.values())
    assert hashsums.histogram(answers) == [len(total), sum(total.values()), of[1], of[2], of[3], of[4]]
    x = np.array([0, 1, 255, 256, 1 << 60], np.uint64)
    assert (hashsums.unpacked(hashsums.packed(x)) == x).all() and (hashsums.unpacked_sorted(hashsums.packed_sorted(x)) == x).all() and not len(hashsums.unpacked(hashsums.packed(x[:0])))


def test_words_marks_and_characters_without_spaces():
    raw, off = utf8(pa.array(["Ab 12,x", "\u4e16\u754ca", "", "\u043f\u0451\u0441"]))
    start, end, row, word = q.words_of(raw, off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end)] == ["Ab", "12", ",", "x", "\u4e16", "\u754c", "a", "\u043f\u0451\u0441"]
    assert row.tolist() == [0] * 4 + [1] * 3 + [3] and word.min() > 0 and word.max() < 1 << q.WORD_BITS


def test_structured_lines_and_words_are_told_apart():
    t, u = "a", "b"
    for _ in range(10):
        t, u = t + u, u + t  # equal modulo a power of two in any polynomial
    raw, off = utf8(pa.array([f"{t}\n{u}\n{t}"]))
    assert q.measure(raw, off, np.zeros(q.SYMBOLS**q.ORDER, np.float32))[3].tolist() == [1]


def test_shuffled_words_and_other_scripts_are_told_from_prose(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for lang, letters in (("en", "abcdefghijklmnop"), ("ru", "абвгдежзийклмноп")):
        words = ["".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(200)]
        after = {w: [words[(3 * i + k) % 200] for k in range(3)] for i, w in enumerate(words)}
        for i in range(200):
            text = [r.choice(words)]
            while len(text) < 200:
                text.append(r.choice(after[text[-1]]))
            rows.append((len(rows), " ".join(text), lang))
        rows.append((len(rows), " ".join(r.choice(words) for _ in range(400)), lang))
        if lang == "ru":
            rows.append((len(rows), " ".join("".join(r.choice(letters) for _ in w) for w in r.choices(words, k=200)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    inside = {x["doc_id"]: x["in_band"] for x in q.judge_documents(docs).collect()}
    assert [i for i, k in sorted(inside.items()) if not k] == [200, 401, 402]
    monkeypatch.setattr(q, "MAX_BROADCAST_LANGUAGES", 0)
    clash = docs.selectExpr("*", "1 as _own", "2 as _other", "3 as _low", "4 as kept").unionByName(docs.limit(3).selectExpr("*", "1 as _own", "2 as _other", "3 as _low", "4 as kept"))
    out = q.judge_documents(clash.repartition(5)).collect()
    assert len(out) == len(rows) + 3 and {x["doc_id"]: x["in_band"] for x in out} == inside
    assert {(x["_own"], x["_other"], x["_low"]) for x in out} == {(1, 2, 3)}


def test_rare_languages_are_judged_by_one_rule_at_all_sizes(spark):
    r = random.Random(7)
    words = ["".join(r.choice(["an", "er", "on", "the", "ing", "ed", "is"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    prose = lambda: " ".join(r.choice(words) for _ in range(80))
    bad = " ".join("".join(r.choice("zqxjkvw") for _ in range(r.randrange(3, 9))) for _ in range(150))
    for n in (1, 28, 29, 30):
        rows = [(i, prose(), "xx") for i in range(n)] + [(900, bad, "xx")] + [(1000 + i, prose(), "en") for i in range(29 if n == 1 else 200)]
        kept = {x["doc_id"]: x["kept"] for x in q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert [i for i, k in kept.items() if not k] == [900], n
