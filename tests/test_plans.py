import pytest
from pyspark.sql import functions as F

from verdigris.plans import certify, gate, orchestrate
from verdigris.sources import files, schemas, transcripts


def results(spark, run, good, cost=0.01, errors=0):
    rows = []
    for i in range(30):
        for k in range(2):
            ok = bool(good(i, k))
            rows.append((run, run, f"t{i:02d}", k, "ok", "a", ["D"], False, (ok, True, 1.0, 1.0, False, None, i < errors), ok, 1.0, 10, 1, cost, f"{run}-{i}-{k}"))
    return spark.createDataFrame(rows, schemas.RESULT)


def test_outcomes_of_the_gate(spark, tmp_path):
    base = results(spark, "base", lambda i, k: True)
    bad = results(spark, "cand", lambda i, k: i % 3 > 0)
    tags = spark.createDataFrame([(f"t{i:02d}", ["lookup", "hr" if i % 3 else "pricing"]) for i in range(30)], "task_id string, tags array<string>")
    cert, now = {"cert_inputs": {"rubric": "1"}}, {"rubric": "1"}
    ask = {"changed": ["prompts/a.md"], "head_sha": "s", "run_id": "r", "key_parts": {"base": 1}}
    made = []

    def run(request=ask, cand=bad, certificate=cert, cap=4.0):
        return orchestrate.run_gate(request, certificate, now, files.ResultCache(spark, str(tmp_path)), lambda: made.append(1) or base, lambda: cand, tags, cap, 200, 1)

    out = run()
    assert out["outcome"] == "block" and out["exit"] == 1 and not out["cache_hit"] and "Merge blocked" in out["report"]
    assert {t["tag"] for t in out["tags"] if t["flagged"]} == {"lookup", "pricing"} and out["worst"][0]["trace_id"] == "cand-0-0"
    assert run(cand=base)["outcome"] == "pass" and run()["cache_hit"] and len(made) == 1
    assert run(ask | {"changed": ["README.md"]})["outcome"] == "not_applicable"
    assert run(ask | {"fork": True})["exit"] == 2 and "rubric" in run(certificate=None)["message"]
    assert run(ask | {"prior": {"head_sha": "s", "verdict": "block"}})["replayed"] and run(ask | {"prior": {"head_sha": "s", "verdict": "block"}, "reason": "flaky"}).get("replayed") is None
    assert run(cap=0.1)["outcome"] == "error" and "judge errors" in run(cand=results(spark, "c", lambda i, k: True, errors=5))["message"]
    assert orchestrate.equal_sides([(base, base)], 100, 1)["passed"]
    assert "Success of the base" in out["report"] and "holds no agreement" in out["report"] and "Hash of rubric" in out["report"]
    made = gate.write_outcome(spark, str(tmp_path / "out"), out)
    assert [m.rsplit("/", 1)[-1] for m in made] == ["gate.json", "comment.md"] and (tmp_path / "out/comment.md").read_text() == out["report"]
    assert transcripts.read_json(spark, made[0])["outcome"] == "block"


@pytest.mark.parametrize(("judge", "want"), [("agrees", True), ("contrary", False), ("long", False)])
def test_certificates(spark, judge, want):
    rows = [(f"e{i:02d}", "t", "v", 0, "multi_hop", "q", "r", "bad" if i < 8 else "good " * (1 + i % 5), ["D"], None) for i in range(40)]
    examples = spark.createDataFrame(rows, schemas.EXAMPLE)
    labels = spark.createDataFrame([(r[0], "t", "v", "fail" if r[7] == "bad" else "pass", "p", "") for r in rows], schemas.LABEL)

    def ask(prompt):
        good = "good" in prompt
        ok = {"agrees": good, "contrary": not good, "long": len(prompt) > 30}[judge]
        return f'{{"correct": {str(ok).lower()}, "faithful": true, "reason": "r"}}', 0.0

    short = spark.createDataFrame([("e10", "go")], "example_id string, compressed string")
    judged = certify.judged_variants(examples, short, lambda df: df.withColumn("prompt", F.col("answer")), ask)
    assert judged.count() == 121
    out = certify.certify(examples, labels, judged, {"rubric": "1"}, "2026-01-01", 200, 1)
    assert out["certified"] is want and out["n_labels"] == 40 and out["judge_errors"] == 0


def test_report_drops_tag_rows_that_do_not_fit():
    result = {"verdict": "pass", "delta": 0.01, "lo": -0.01, "hi": 0.03, "n": 10, "p_neg": 0.2, "mde": 0.1, "sd": 0.2, "dropped": [], "eps_points": 2.0}
    tags = [{"tag": f"tag{i}" * 20, "n": 1, "delta": 0.01, "lo": 0.0, "hi": 0.1, "flagged": False} for i in range(900)]
    out = gate.render(result, tags, [], {})
    assert len(out) < gate.MOST_CHARS and "more tags" in out and gate.replay_note(gate.replay_note("x")) == gate.replay_note("x")
    assert len(gate.fitting(["x" * 9] * 5, 30, lambda n: f"{n}")) == 3 and gate.fitting(["x"], 5, str) == ["x"] and gate.fitting(["x" * 9], 5, str) == ["1"]
    drawn = gate.bars(gate.interval(-20, 10, -5, 2), 20)
    assert [x.count("<") - x.count(">") for x in drawn] == [-10, 5, 20, 2] and len({x.index("|") for x in drawn}) == 1
    assert [t["tag"] for t in gate.largest([{"tag": t, "delta": x} for t, x in (("a", 0.1), ("b", -0.2), ("c", 0.2))], 2)] == ["b", "c"]
    own = [{"author": "bot", "body": out}, {"author": "you", "body": out}, {"author": "bot", "body": None}]
    assert gate.own_comments(own, "bot") == own[:1] and "no certificate" in gate.certificate_line(None)
    assert gate.certificate_line({"certified": True, "created_at": "d", "n_labels": 40, "agreement": {"kappa": {"point": 0.966, "lo": 0.908}}}) == "Judge certified on d: kappa 0.97 (at least 0.91) from 40 labels."


def test_files_and_pages(spark, tmp_path):
    transcripts.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert transcripts.read_json(spark, str(tmp_path / "m.json")) == {"a": 1} and transcripts.read_json(spark, str(tmp_path / "none.json")) is None
    assert transcripts.latest_file(spark, str(tmp_path / "*.json")).endswith("m.json")
    transcripts.paged_source(spark, "pages_of_numbers", "n int", lambda page, size: [(i,) for i in range((page - 1) * size, min(page * size, 25))])
    got = spark.read.format("pages_of_numbers").option("size", "10").option("pages", "2").load()
    assert sorted(r["n"] for r in got.collect()) == list(range(25))
    assert files.file_hash(spark, [str(tmp_path / "m.json")]).startswith("sha256:")


def test_calls_batches_and_stable_files(spark, tmp_path):
    from verdigris.operators import judging
    from verdigris.operators import statistics as st

    tasks = spark.createDataFrame([("a", "good"), ("b", "bad")], "id string, input string")

    def agent(asked):
        if asked == "bad":
            raise TimeoutError("late")
        return {"completion": "FINAL: x", "usage": {"m": (3, 4)}, "total_time": 0.5}

    got = judging.generate(tasks, 2, agent)
    rows = {(r["sample_id"], r["epoch"]): r for r in got.collect()}
    assert len(rows) == 4 and rows["a", 2]["usage"]["m"]["out"] == 4 and rows["b", 1]["error"] == "TimeoutError: late"
    root = str(tmp_path / "job")
    assert files.finished_batches(spark, root) is None
    for _ in range(2):
        files.write_batch(tasks, root, "1")
    files.write_batch(tasks.limit(1), root, "2")
    assert files.finished_batches(spark, root).groupBy("batch").count().count() == 2 and files.finished_batches(spark, root).count() == 3
    path = tmp_path / "t.jsonl"
    assert files.write_ordered_lines(tasks.withColumn("n", F.lit(None).cast("string")).repartition(3), str(path), "id") == 2
    assert path.read_bytes() == b'{"id":"a","input":"good","n":null}\n{"id":"b","input":"bad","n":null}\n'
    v = spark.range(1).select(st.analytic_verdict(F.lit(-0.1), F.lit(0.28), F.lit(149)).alias("a"), st.analytic_verdict(F.lit(-0.03), F.lit(0.45), F.lit(300)).alias("b")).first()
    assert (v["a"], v["b"]) == ("block", "warn") and files.new_run_id("r").startswith("r20")


def test_grids_hashes_prompts_and_numbers(spark, tmp_path):
    from verdigris.functions import scoring
    from verdigris.operators import judging, pairing, quality
    from verdigris.operators import statistics as st

    tasks = spark.createDataFrame([(f"t{i}",) for i in range(3)], "id string")
    grid = judging.runs_of(spark.createDataFrame([("a",), ("b",), ("a",)], "variant string"), tasks, 2).collect()
    assert len(grid) == len(set(grid)) == 12
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "system.md").write_text(folder)
    same = [str(tmp_path / f / "system.md") for f in ("one", "two")]
    assert files.file_hash(spark, same) != files.file_hash(spark, same[::-1]) and len(set(files.input_hashes(spark, {"a": same[:1], "b": same[1:]}).values())) == 2
    (tmp_path / "answer.md").write_text("answer it\n")
    assert files.load_prompt(str(tmp_path), "one") == "one\n\nanswer it\n"
    numbered = quality.numbered(spark.range(100, 300).repartition(5).withColumnRenamed("id", "k"), "k", "dev", 7).orderBy("k").collect()
    assert [r["id"] for r in numbered] == [f"dev-{i:04d}" for i in range(8, 208)]
    from pyspark.sql import functions as F

    row = spark.range(1).select(st.thresholded_mde(F.lit(0.28), F.lit(149)).alias("a"), st.thresholded_mde(F.lit(0.08), F.lit(149)).alias("b"), judging.self_preference(F.lit("x/Name-4"), F.lit("name-9")).alias("c")).first()
    assert abs(row["a"] - 0.0643) < 2e-4 and abs(row["b"] - 0.0255) < 2e-4 and row["c"]
    assert {"answer_match", "gold_retrieval", "citations_scored", "abstention", "to_judge"} <= set(scoring.SCORERS)
    one, two = spark.createDataFrame([("a", True), ("b", None), ("c", True)], "task_id string, success boolean"), spark.createDataFrame([("a", False), ("b", True), ("d", True)], "task_id string, success boolean")
    assert sorted(r["task_id"] for r in pairing.dropped(pairing.paired(one, two)).collect()) == ["b", "c", "d"]


def test_a_wrong_number_spoils_a_whole_number_only(spark):
    from verdigris.operators import judging

    kind = "example_id string, reference string, answer string, citations array<string>, synthetic string"
    rows = spark.createDataFrame([("a", "25 days", "25.5 kg and 25 days", [], None), ("b", "25 days", "it was 1.25 only", [], None)], kind)
    docs = spark.createDataFrame([], "id string, text string, body string")
    assert [r["answer"] for r in judging.corrupted(rows, docs, "wrong_number", "").collect()] == ["25.5 kg and 32 days"]
