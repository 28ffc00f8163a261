import random
import re

import pytest

from verdigris.llm import licenses, queries

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def base(text):
    """n_words, places (start, label) by comparing words at every place."""
    w = words(text)
    return len(w), [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]


def least_edits(notice, text):
    """Fewest edits of the notice against any run of whole words, by dynamic programming over all its ends."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for i, c in enumerate(text):
        fresh = text[i - 1] == " " if i else True  # a run begins at a word
        new = [0 if fresh else 10**6]
        prev = row if i else list(range(len(notice) + 1))
        if fresh:
            prev = [min(p, k) for k, p in enumerate(prev)]
        for k, x in enumerate(notice):
            new.append(min(prev[k] + (x != c), prev[k + 1] + 1, new[k] + 1))
        new[0] = 10**6
        row = new
        if i + 1 == len(text) or text[i + 1] == " ":
            best = min(best, row[-1])
    return best


def edited(r, text, edits):
    t = list(text)
    for _ in range(edits):
        at = r.randrange(1, len(t) - 1)
        what = r.randrange(3)
        if what == 0:
            t[at] = r.choice("xyzé7")
        elif what == 1:
            t.insert(at, r.choice("xqé"))
        else:
            del t[at]
    return "".join(t)


def test_base_places_equal_a_plain_reading(spark):
    r = random.Random(5)
    vocabulary = ["mit", "MIT", "license", "License", "apache", "general", "public", "éa", "x1", "of", "GNU"]
    texts = ["".join(r.choice(vocabulary) + r.choice([" ", "  ", ", ", "-", "\n", "_", " "]) for _ in range(r.randrange(0, 40))) for _ in range(600)] + ["", None, "---", "mit license", "MIT License mit license"]
    got = {x["doc_id"]: x for x in licenses.report(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert len(got) == len(texts)
    hit = 0
    for i, t in enumerate(texts):
        n, places = base(t)
        x = got[i]
        assert (x["n_words"], x["n_base"]) == (n, len(places))
        assert (x["first_word"], x["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x["base_labels"] == ",".join(sorted({b for _, b in places})) and set(x["labels"].split(",")) >= set(x["base_labels"].split(",")) - {""}
        assert not places or x["score"] == 1
        hit += bool(places)
    assert hit > 100


def test_notices_are_found_just_when_their_edits_allow(spark):
    r = random.Random(8)
    notices = [n for n in licenses.notice_list() if not n.base]
    rows = []
    for notice in notices:
        for edits in (0, 1, notice.edits, notice.edits + 2):
            about = lambda: " ".join("".join(r.choice("abcdeimnprstuü") for _ in range(r.randrange(2, 8))) for _ in range(6))
            rows.append((notice, f"{about()} {edited(r, notice.text, edits)} {about()}"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], SCHEMA)
    for notice in notices:  # each alone, so that no other one covers its place
        alone = [i for i, (n, _) in enumerate(rows) if n == notice]
        for i in alone:
            joined = " ".join(words(rows[i][1])).encode()
            got = list(licenses.Finder((notice,)).matches(b"\n" + joined + b"\n"))
            least = least_edits(notice.text, joined.decode())
            assert bool(got) == (least <= notice.edits), (notice, joined)
            assert not got or min(m[3] for m in got) >= least
    found = {x["doc_id"]: x for x in licenses.find_notices(df).collect()}
    for i, (notice, text) in enumerate(rows):
        if i % 4 == 0:
            assert notice.label in {s["label"] for s in found[i]["spans"]} and found[i]["score"] == 1
            exact = [s for s in found[i]["spans"] if not s["base"]][0]
            assert " ".join(words(text[exact["start"] : exact["end"]])) == notice.text and exact["words"] == len(notice.text.split()) and exact["word"] == 6


def test_spans_are_of_the_whole_text_and_the_nearest_notice_decides(spark):
    filler = "größe wörter " * 30_000
    text = f"{filler}LICENSED under CC-BY-NC\n4.0; {filler}Relaesed under the MIT Licence. {filler}"
    got = licenses.find_notices(spark.createDataFrame([(1, text), (1, text), (2, "licensed under cc by sa 4 0")], SCHEMA)).collect()
    assert got[0] == got[1] and [s["label"] for s in got[0]["spans"]] == ["cc-by-nc"]  # three edits are too many for the second
    s = got[0]["spans"][0]
    assert text[s["start"] : s["end"]] == "LICENSED under CC-BY-NC\n4.0" and s["word"] == 60_000
    assert [s["label"] for s in got[2]["spans"]] == ["cc-by-sa"]
    wrong = licenses.find_notices(spark.createDataFrame([(1, "Released undr the MIT Licence.")], SCHEMA)).collect()[0]
    assert [(s["label"], s["edits"], s["base"]) for s in wrong["spans"]] == [("mit", 2, False)] and wrong["score"] == pytest.approx(1 - 2 / 30)


def test_nulls_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None), (2, ""), (3, "xé")], SCHEMA).selectExpr("*", "1 as spans", "2 as score", "'k' as label")
    out = licenses.find_notices(df)
    assert sorted(r["n_words"] for r in out.collect()) == [0, 0, 1] and set(out.columns) == {"doc_id", "text", "label", "n_words", "spans", "score"}
    assert licenses.report(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in licenses.report(df.filter("doc_id = 2")).collect()] == [(0, 0, None, None, "", "", 0.0, "")]


def test_the_query_finds_all_notices_of_the_table_and_leaves_other_documents(spark):
    data = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_licenses"](spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n, places = base(t)
        assert (got[i]["n_words"], got[i]["n_base"]) == (n, len(places))
        want = {label for _, label in places} | ({"cc-by-nc"} if "Licensed under CC BY-NC" in (t or "") else set())
        assert got[i]["labels"] == ",".join(sorted(want))
