import hashlib
import random
import re

from verdigris.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    pieces = ["@", ".", "a", "b1", "x@y.zz", "1.2.3.4", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-0100", "+", " ", "-", "é", "12", "4" * 16, "%", "__", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(20000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 12)))
        raw = text.encode()
        at = [len(raw[:i].decode("utf-8", "ignore")) for i in range(len(raw) + 1)]
        assert [(at[a], k, at[b]) for a, k, b in pii.base_spans(raw)] == brute(text), text


def test_contexts_discover_identifiers_and_leave_others_alone(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117"]
    rows = [(i, f"some words then member number: {c} and more é {i}") for i, c in enumerate(cards * 3)]
    rows += [(100, "other words then member number: 9876-ABCD-5521 and more"), (101, "released as version 20260101 today"), (102, "member number: none"), (103, None), (104, ""), (105, "x " * 60000 + "a@b.cc")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumnRenamed("text", "text")
    out = {r["doc_id"]: r for r in pii.report(pii.find_personal_data(docs.selectExpr("*", "'z' as spans", "1 as base"))).collect()}
    assert out[100]["spans"] == "card:32:46" and out[100]["n_card"] == 0 and out[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[101]["spans"] == "" and out[103]["spans"] == "" and out[104]["spans"] == ""
    assert out[105]["spans"] == "email:120000:120006"
    start = rows[0][1].index(cards[0])
    assert out[0]["spans"] == f"card:{start}:{start + 16}" and out[0]["n_card"] == 1
    masked = {r["doc_id"]: r["text"] for r in pii.mask_documents(docs).collect()}
    assert masked[100] == "other words then member number: [CARD] and more" and masked[103] is None and masked[101] == rows[16][1]
    assert pii.find_personal_data(docs.limit(0)).count() == 0 and pii.mask_documents(docs).count() == len(rows) + 1


def test_candidates_are_all_cores_and_digits_over_several_words(spark):
    phones = ["+1 (555) 555-0100", "+44 20 7946 0958", "+49 30 901820 11", "+33 1 70 18 99 00"]
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005"]
    rows = [(i, f"please w{i} call me at: {p} or write") for i, p in enumerate(phones * 6)]
    rows += [(100 + i, f"w{i} acct={c} x{i}") for i, c in enumerate(cards * 6)] + [(200 + i, f'w{i} {{"card":"{c}"}} x{i}') for i, c in enumerate(cards * 6)]
    asked = {
        300: ("please call me at: (555) 010-0199 or write", "phone", "(555) 010-0199"),
        301: ("please call me at: 030 555 12 34 or write", "phone", "030 555 12 34"),
        302: ("other acct=99887766 here", "card", "99887766"),
        303: ('other {"card":"5551234567"} here', "card", "5551234567"),
        304: ("the acct other=99887755 here", "", ""),
        305: ("made of 030 555 12 35 parts", "", ""),
        306: ("é call me at: 555 1234 5x or write", "phone", "555 1234"),
    }
    rows += [(i, t) for i, (t, _, _) in asked.items()]
    found = pii.report(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    out = {r["doc_id"]: r["spans"] for r in found.filter("doc_id >= 300").collect()}
    assert out == {i: f"{kind}:{t.index(what)}:{t.index(what) + len(what)}" if kind else "" for i, (t, kind, what) in asked.items()}


def test_rounds_go_on_until_nothing_new_is_labelled(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005"]
    sets = [cards] + [[f"{k}{i}77-{i}{k}A" for i in range(4)] for k in range(1, 6)]
    rows = []
    for k in range(5):  # context k is made certain by set k and followed by set k + 1 now and then
        rows += [f"w{i} field{'abcde'[k]} {x} v{i}" for i, x in enumerate(sets[k] * 6)] + [f"y{i} field{'abcde'[k]} {x} z{i}" for i, x in enumerate(sets[k + 1])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.report(pii.find_personal_data(docs)).collect()}
    assert [rows[i] for i, x in sorted(out.items()) if not x.startswith("card:")] == []


def test_secrets_seed_contexts_that_discover_others(spark):
    import hashlib

    h = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'lorem ipsum token = "{h(i)}" dolor') for i in range(17)]
    rows += [(100 + i, f"they deploykey {h(i if i < 17 else 500 + i)} afterwards sit amet") for i in range(20)]  # 17 are known
    rows += [(200 + i, f"see commit {h(900 + i)} for more") for i in range(8)] + [(300, "password: short1"), (301, "the token = abcdefghijklmnopqrst")]
    rounds: list[int] = []
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string")
    found = {r["doc_id"]: [rows_[s["start"] : s["end"]] for s in r["spans"]] for r in pii.find_personal_data(docs, rounds=rounds).collect() for rows_ in [dict(rows)[r["doc_id"]]]}
    assert all(found[i] == [h(i)] for i in range(17)) and all(found[100 + i] == [h(i if i < 17 else 500 + i)] for i in range(20))
    assert all(found[200 + i] == [] for i in range(8)) and found[300] == found[301] == []
    assert rounds == [3, 0]
    clash = docs.selectExpr("*", "1 as _own", "2 as _spans", "3 as _key")
    masked = pii.mask_documents(clash).collect()
    assert len(masked) == len(rows) + 2 and {(r["_own"], r["_spans"], r["_key"]) for r in masked} == {(1, 2, 3)}
    assert {r["text"] for r in masked if r["doc_id"] == 3} == {'lorem ipsum token = "[SECRET]" dolor'}
