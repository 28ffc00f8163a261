import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators import judging, quality, retrieval, similarity
from verdigris.plans import gate as plan
from verdigris.sources import files, schemas

SEED = """
company: Acme
as_of: "2026-01-01"
docs:
  - id: HR-001
    title: Leave
    effective_date: "2024-01-01"
    facts:
      - {key: days, value: "20 days", text: "Staff get {value} of leave."}
    refs: [PRC-001]
  - id: HR-002
    title: Leave (new)
    effective_date: "2025-01-01"
    supersedes: HR-001
    facts:
      - {key: days, value: "25 days", text: "Staff get {value} of leave."}
  - id: PRC-001
    title: Prices
    effective_date: "2027-01-01"
    facts:
      - {key: seat, value: "16 USD", text: "The Pro tier costs {value} per seat."}
"""


@pytest.fixture
def docs(spark, tmp_path):
    (tmp_path / "seed.yaml").write_text(SEED)
    head, seed = files.read_seed(spark, str(tmp_path / "seed.yaml"))
    files.write_corpus(files.render_documents(seed, head["company"]), str(tmp_path / "docs"))
    return files.read_corpus(spark, str(tmp_path / "docs" / "*.md"))


def test_corpus_round_trip(docs):
    rows = {r["id"]: r for r in docs.collect()}
    assert list(rows) == ["HR-001", "HR-002", "PRC-001"] and rows["HR-002"]["supersedes"] == "HR-001" and rows["HR-001"]["supersedes"] is None
    assert rows["HR-001"]["body"] == "# Leave\n\nAcme HR policy. Document HR-001, effective 2024-01-01.\n\nStaff get 20 days of leave.\n\nRelated documents: PRC-001."
    assert rows["PRC-001"]["title"] == "Prices" and rows["PRC-001"]["text"].startswith('---\nid: PRC-001\ntitle: "Prices"\nkind: pricing\n')


def test_search_ties_and_dates(spark, docs):
    index = retrieval.Index(docs, "id", "body")
    ask = spark.createDataFrame([("q", "Pro tier price per seat"), ("none", "zzz")], "query_id string, query string")
    hits = index.search(ask).collect()
    assert hits[0]["doc_id"] == "PRC-001" and {h["query_id"] for h in hits} == {"q"}
    twins = spark.createDataFrame([("PRD-777", "same words"), ("PRD-111", "same words")], "doc_id string, body string")
    got = retrieval.Index(twins).search(spark.createDataFrame([("q", "words words")], "query_id string, query string")).orderBy("rank").collect()
    assert [g["doc_id"] for g in got] == ["PRD-111", "PRD-777"]
    assert [r["id"] for r in retrieval.effective(docs.withColumnRenamed("id", "doc_id"), "2026-01-01").withColumnRenamed("doc_id", "id").collect()] == ["HR-002"]
    s = docs.filter("id = 'PRC-001'").select(retrieval.snippet(F.col("body"), F.lit("cost per seat")).alias("s")).first()["s"]
    assert s == "The Pro tier costs 16 USD per seat."


def task(i, kind="lookup", split="dev", **more):
    base = {"id": f"{split}-{i:04d}", "input": f"Question number {i} about {kind} in {split}?", "reference": "16", "gold_doc_ids": ["HR-002"], "type": kind, "answer_kind": "numeric", "tags": [kind], "split": split}
    if kind == "unanswerable":
        base |= {"reference": None, "gold_doc_ids": [], "answer_kind": "abstain"}
    return base | more


def test_strict_task_reading(spark, tmp_path):
    lines = [json.dumps(task(1)), "", json.dumps(task(1)), json.dumps(task(2) | {"extra": 1}), json.dumps(task(3, "unanswerable", reference="x")), json.dumps(task(4, "conflicting", gold_doc_ids=["A", "B"])), json.dumps(task(5))]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    good, bad = files.read_tasks(spark, str(tmp_path / "t.jsonl"))
    assert sorted(r["id"] for r in good.collect()) == ["dev-0001", "dev-0005"]
    assert sorted(int(r["key"].rsplit(":", 1)[1]) for r in bad.collect()) == [3, 4, 5, 6]
    with pytest.raises(ValueError, match=":3"):
        files.load_tasks(spark, str(tmp_path / "t.jsonl"))
    assert files.read_lines(spark, str(tmp_path / "absent"), schemas.LABEL).count() == 0


def test_task_checks(spark, docs):
    rows = [task(i, t, s) for s in ("gate", "dev") for i, t in enumerate(schemas.TYPES * 2)]
    rows += [task(90, split="gate", gold_doc_ids=["NO-1"]), task(91, input="Question number 3 about conflicting in GATE!!"), task(92), task(92)]
    kind = schemas.TASK
    tasks = spark.createDataFrame([tuple(r[f] for f in files.FIELDS) for r in rows], kind)
    got = [(r["rule"], r["key"]) for r in quality.check_tasks(tasks, docs, {"gate": 11}, 1).collect()]
    assert ("gold", "gate-0090") in got and ("id", "dev-0092") in got and ("near-duplicate", "gate-0003/dev-0091") in got
    assert not [g for g in got if g[0] == "schema"]


def test_near_duplicates_are_those_of_brute_force(spark):
    import random

    r = random.Random(3)
    base = ["the quick brown fox jumps over the lazy dog and runs away home", "pack my box with five dozen liquor jugs for the long trip", ""]
    rows = []
    for i in range(80):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            if t:
                t[r.randrange(len(t))] = r.choice("abcdefgh ")
        rows.append((i, "".join(t)))
    df = spark.createDataFrame(rows, "id int, t string")
    got = {(x["a"], x["b"]): x["jaccard"] for x in similarity.near_duplicates(df.filter("id < 40"), df.filter("id >= 40"), "id", "t").collect()}
    norm = {i: " ".join(t.split()) for i, t in rows}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} if len(t) >= 5 else {t} for i, t in norm.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(40) for b in range(40, 80)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.8}) and len(got) > 50


def jaccards(rows, left, right):
    norm = {i: " ".join(t.split()) for i, t in rows}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} if len(t) >= 5 else {t} for i, t in norm.items()}
    return {(a, b): j for a in left for b in right if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8}


def test_one_template_in_most_rows(spark, monkeypatch):
    """Nearly all rows are a long template with words of their own: its shingles are under most rows, and sizes and grids split what meets."""
    import random

    r = random.Random(9)
    monkeypatch.setattr(similarity, "HOT", 5)
    monkeypatch.setattr(similarity, "AT_ONCE", 500)
    monkeypatch.setattr(similarity, "FAN_IN", 2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    template = " ".join(word() for _ in range(25))
    rows = [(i, f"{' '.join(word() for _ in range(r.randrange(0, 9)))} {template}") for i in range(120)] + [(200 + i, " ".join(word() for _ in range(30))) for i in range(20)]
    rows += [(300, ""), (301, "ab"), (302, "ab"), (303, "é \U0001f600 z" * 9), (304, "é \U0001f600 z" * 9)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(5)
    got = {(x["a"], x["b"]): x["jaccard"] for x in similarity.near_duplicates(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), "id", "t").collect()}
    want = jaccards([(i, "".join(c for c in t if c != "\U0001f600")) for i, t in rows], [i for i, _ in rows if i % 2 == 0], [i for i, _ in rows if i % 2])
    assert got == pytest.approx(want) and 300 < len(got) < 60 * 60


def test_few_shingles_of_a_text_are_joined(spark):
    import random

    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))) for i in range(40)]
    classes = spark.createDataFrame(rows, "id long, norm string")
    scratch = similarity.Scratch(spark, "t")
    counts = similarity.sketch(classes, 5, scratch)
    shingles = sum(len({t[k : k + 5] for k in range(len(t) - 4)}) for _, t in rows)
    assert counts.sum() == shingles
    chosen = similarity.prefixes(classes, 5, 0.8, counts)
    assert chosen.count() < 0.21 * shingles and chosen.filter("short").count() < 0.13 * shingles


def test_no_shingles_are_shuffled(spark, monkeypatch):
    """What is written for a join is some sketches of a bit or two a shingle, not entries of its prefixes; blocks, cells, pieces and the filter of wanted texts lose no pair."""
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(3, 160)))) for i in range(90)]
    rows += [(i + 100, " ".join(w for w in t.split() if r.random() > 0.03 * (i % 5))) for i, t in rows] + [(i + 300, t) for i, t in rows[:9]] + [(400, ""), (401, None)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    want = jaccards([(i, t or "") for i, t in rows], [i for i, _ in rows if i % 3 == 0], [i for i, _ in rows if i % 3])
    assert len(want) > 30
    for limits in ({}, {"HOT": 4, "BLOCKS": 1000, "PIECE": 3, "SENT": 2, "FEW": 0}, {"HELD": 300, "LEAST_BITS": 64, "MOST_BITS": 128, "WIDE": 1, "CACHED": 8}):
        for name, value in limits.items():
            monkeypatch.setattr(similarity, name, value)
        got = {(x["a"], x["b"]): x["jaccard"] for x in similarity.near_duplicates(df.filter("id % 3 = 0"), df.filter("id % 3 > 0"), "id", "t").collect()}
        assert got == pytest.approx(want)
        monkeypatch.undo()
    texts = spark.createDataFrame([(str(i), i, 1, t) for i, t in rows if t], "cls string, row long, side int, norm string")
    for x in similarity.parities(texts, 5).collect():
        assert 8 * len(x["odd"]) <= max(64, 1.5 * x["k"])


def test_blocks_of_a_size():
    """A size that most texts have is cut into blocks by hash, and every two blocks of similar sizes meet in one cell."""
    bins = [(b, 50_000 if b == 30 else 40, 10 + b, 10 + b) for b in range(60)]
    places, cells, number = similarity.layout(bins, 0.8)
    assert [b for b, *_ in places] == list(range(60)) and {p[1] for p in places if p[0] == 30} == {23}
    own, later = {c: b for b, c, role in cells if role < 2}, [(c, b) for b, c, role in cells if role == 2]
    met = sorted((own[c], b) for c, b in later)
    assert len(own) == number and len(set(met)) == len(met) and sorted(b for b, _, role in cells if role == 0) == list(range(max(own.values()) + 1))
    hot = next(p for p in places if p[0] == 30)
    assert {(x, y) for x in range(hot[3], hot[3] + 23) for y in range(x + 1, hot[3] + 23)} <= set(met)


def test_corruptions(spark, docs):
    example = [("e", "t", "v", 0, "multi_hop", "q", "25 days; from 2025", "They get 25 days, and it began in 2025.", ["HR-002"], None)]
    examples = spark.createDataFrame(example, schemas.EXAMPLE)
    got = {k: judging.corrupted(examples, docs, k, "Acme").first() for k in judging.CORRUPTIONS}
    assert got["wrong_number"]["answer"] == "They get 32 days, and it began in 2025." and got["wrong_number"]["example_id"] == "e~wrong_number"
    assert got["dropped_fact"]["answer"] == "They get 25 days"
    assert got["unsupported_claim"]["answer"].startswith("They get 25 days, and it began in 2025. ") and got["wrong_citation"]["citations"] == ["PRC-001"] or got["wrong_citation"]["citations"] == ["HR-001"]
    more = judging.augmented(examples, docs, "Acme", 1)
    assert more.count() == 5 and judging.augmented(more, docs, "Acme", 1).count() == 5
    padded = judging.perturbations(examples).collect()
    assert sorted(len(p["text"]) >= f * len(example[0][7]) for p, f in zip(sorted(padded, key=lambda p: len(p["text"])), (1.5, 2.0))) == [True, True]


def test_samples_to_verdict(spark, docs, tmp_path):
    tasks = spark.createDataFrame([tuple(task(i)[f] for f in files.FIELDS) for i in range(4)], schemas.TASK)
    calls = [("search_docs", {"query": "x"}), ("get_doc", {"doc_id": "HR-002"})]
    messages = spark.createDataFrame([(f"dev-{i:04d}", e, 0, "assistant", "", calls) for i in range(4) for e in (1, 2)], schemas.MESSAGE)
    final = lambda a, c: f'FINAL: {{"answer": "{a}", "citations": ["{c}"], "abstain": false}}'
    none = spark.createDataFrame([], "sample_id string, epoch int, correct boolean, faithful boolean, reason string, error boolean, cost_usd double")

    def results(run, answer):
        out = spark.createDataFrame([(f"dev-{i:04d}", e, None, None, final(answer(i), "HR-002"), {"m": (1000, 100)}, 1.0) for i in range(4) for e in (1, 2)], schemas.OUTCOME)
        return judging.score_samples(out, messages, tasks, docs, none, {"default": (1.0, 1.0)}, run, run)

    base, cand = results("base", lambda i: 16), results("cand", lambda i: 99)
    row = base.first()
    assert row["success"] is True and row["status"] == "ok" and row["scores"]["gold_retrieval"] and row["cost_usd"] == pytest.approx(0.0011)
    out = plan.compare(base, cand, 200, 1)
    assert out["verdict"] == "block" and out["delta"] == -1.0 and plan.compare(base, base, 200, 1)["verdict"] == "pass"
    text = plan.render(out, [], [], {"run_id": "r", "head_sha": "s"})
    assert text.startswith("<!-- eval-gate:v1 ") and "Merge blocked" in text
    cache = files.ResultCache(spark, str(tmp_path))
    assert cache.get("k") is None
    cache.put("k", base)
    assert cache.get("k").count() == 8


def test_judges_are_asked_twice_at_most(spark):
    good = '{"correct": true, "faithful": true, "reason": "r"}'
    rows = spark.createDataFrame([("a", "good"), ("b", "bad")], "id string, prompt string")
    got = {r["id"]: r for r in judging.ask_judge(rows, ["id"], "prompt", lambda p: (good if p == "good" else "{}", 0.5)).collect()}
    assert got["a"]["correct"] and got["a"]["cost_usd"] == 0.5 and got["b"]["error"] and got["b"]["cost_usd"] == 1.0


def test_streams_agree_with_batch(spark, tmp_path):
    from verdigris.streaming import live

    tasks = [("r", "v", f"t{i}", k, "ok", None, [], False, None, None if i == 0 else i % 2 == 0, 1.0, 1, 1, 0.5, "") for i in range(4) for k in range(2)]
    rows = spark.createDataFrame(tasks, schemas.RESULT)
    rows.write.parquet(str(tmp_path / "in"))
    for name, df, mode in (("rate", live.success_rate(live.once(live.read_arriving(spark, str(tmp_path / "in")))), "complete"), ("cost", live.spending(live.read_arriving(spark, str(tmp_path / "in")), 3.5), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "rate" else mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.table("cost").collect()
    assert (got[-1]["spent"], got[-1]["calls"], got[-1]["over"]) == (4.0, 8, True)


def test_quota_and_sizes(spark):
    rows = spark.createDataFrame([("lookup",)] * 45 + [("multi_hop",)] * 30, "type string")
    got = {r["type"]: (r["have"], r["want"], r["off"]) for r in quality.mix_report(rows, "type", schemas.SHARES, 150, 1).collect()}
    assert got["lookup"] == (45, 45, False) and got["multi_hop"] == (30, 38, True) and got["conflicting"] == (0, 22, True)
    assert schemas.parse_split_sizes("gate=150, dev=50") == {"gate": 150, "calibration": 120, "dev": 50}
    with pytest.raises(ValueError):
        schemas.parse_split_sizes("gate=x")


def test_not_every_pair_of_a_size_is_looked_at(spark, monkeypatch):
    """Rows of a size in which unlike ones share words and some are near copies: families by equal bytes hold every similar pair, and few pairs are compared to find them."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(50, 65))) for _ in range(700)]
    for i in range(300):
        of = texts[r.randrange(40)].split()
        for _ in range(r.randrange(0, 6)):
            of[r.randrange(len(of))] = r.choice(words)
        texts.append(" ".join(of))
    df = spark.createDataFrame([(str(i), i, i % 2 + 1, t) for i, t in enumerate(texts)], "cls string, row long, side int, norm string")
    table = pa.Table.from_pandas(similarity.parities(df, 5).toPandas().rename(columns={"row": "id", "side": "sides"}).assign(piece=0))
    want = {tuple(sorted(p)) for p in jaccards(list(enumerate(texts)), range(0, 1000, 2), range(1, 1000, 2))}
    part = lambda x, lo, hi: tuple(v[..., lo:hi] for v in x)
    a = max(similarity.by_width(table), key=lambda x: len(x[2]))
    n, compared, look = len(a[2]), [], similarity.near_pairs
    want = {p for p in want if set(p) <= set(a[1].tolist())}
    assert n > 500 and len(want) > 100
    monkeypatch.setattr(similarity, "near_pairs", lambda rows, x, y, t: compared.append(len(x)) or look(rows, x, y, t))
    monkeypatch.setattr(similarity, "WORD_S", 1e-3)
    for x, y, same in ((a, a, True), (part(a, 0, n // 2), part(a, n // 2, n), False)):
        pairs = lambda found: {tuple(sorted((int(p), int(q)))) for i, j in found for p, q in zip(x[1][i], y[1][j])}  # noqa: B023, E731
        each = pairs(similarity.near_sets(x, y, same, 0.8))
        here = {p for p in want if same or len(set(p) & set(x[1].tolist())) == 1}
        compared.clear()
        assert similarity.grouping(x, y, same, 0.8) and here <= pairs(similarity.close(x, y, same, 0.8)) <= each
        assert sum(compared) < len(x[2]) * len(y[2]) / (20 if same else 10)
        apart = int(similarity.allowed(x[2][-1], y[2][-1], 0.8))
        for width, size in ((len(a[5]), 3), (len(a[5]), 7), (len(a[5]) // 2, 5)):
            monkeypatch.setattr(similarity, "HITS", 1 << 21 if size > 3 else 50)
            family = similarity.families(x, y, same, 0.8, width, size, apart)
            assert here <= pairs(similarity.near_in_families(x, y, same, 0.8, family)) <= each
    alike = np.zeros(4, np.int64)
    assert similarity.merged(np.arange(4), np.array([3, 2, 1]), np.array([2, 1, 0])).tolist() == alike.tolist()
    assert [(g, q) for g, q in similarity.shares(4, 9)] == [(2, 2), (2, 1)]


def test_rounds_bound_what_is_sent_at_once():
    for n in (40, 30_000, 3_000_000):
        bins = [(b, n, 1000 + 15 * b, 1015 + 15 * b) for b in range(60)]
        places, cells, _ = similarity.layout(bins, 0.8)
        own = sum(m * similarity.sketch_bytes(hi) for _, m, _, hi in bins)
        copies = len(cells) / len({b for b, *_ in cells})
        rounds = similarity.number_of_rounds(bins, places, cells)
        assert copies * own / rounds < 1.5 * similarity.AT_A_TIME * own
