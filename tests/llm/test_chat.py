import itertools

import numpy as np

from verdigris.llm import chat


def turns(spark, n_conv=60, n_turn=9):
    said = {"system": "Be brief and kind to people.", "user": "What is it?", "assistant": "It is a long answer that goes on for quite a while and says things.\nAnd a second line of it."}
    rows = []
    for c in range(n_conv):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * n_turn
        rows += [(c, i, r, said[r] + f" {c}") for i, r in enumerate(roles[: n_turn + c % 3])]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "SUPER", 2)
    lines = chat.as_transcript(turns(spark))
    hmm = chat.fit_hmm(lines.filter("conv_id < 40"))
    test = lines.filter("conv_id >= 40")
    got = chat.label_lines(test.select("conv_id", "turn", "line", "text"), hmm).join(test.select("conv_id", "turn", "line", "role").withColumnRenamed("role", "true"), ["conv_id", "turn", "line"])
    rows = got.collect()
    assert len(rows) == test.count() and sum(r["role"] == r["true"] for r in rows) >= 0.95 * len(rows)
    starts = {(r["conv_id"], r["turn_start"]["turn"]) for r in rows}
    assert all(r["turn_start"]["turn"] <= r["turn"] for r in rows) and len(starts) > 100
    rendered = chat.render_turns(chat.label_lines(test.select("conv_id", "turn", "line", "text"), hmm)).collect()
    assert len(rendered) == len(starts) and all(r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("\n<|end|>") for r in rendered)


def best_path(hmm, seen):
    best, path = -np.inf, None
    for p in itertools.product(range(chat.STATES), repeat=len(seen)):
        score = hmm.start[p[0]] + hmm.emit[p[0], seen[0]] + sum(hmm.move[a, b] + hmm.emit[b, s] for a, b, s in zip(p, p[1:], seen[1:]))
        if score > best:
            best, path = score, p
    return [(chat.ROLES[s // 2], s % 2 == 0) for s in path]


def test_viterbi_in_blocks_is_the_best_of_all_paths(spark, monkeypatch):
    hmm = chat.fit_hmm(chat.as_transcript(turns(spark)))
    said = ["User: hi?", "well", "AI: ok", "no marker here at all", "q"]
    lines = [(1, i, 0, t) for i, t in enumerate(said)] + [(2, 3, i, t) for i, t in enumerate(said)] + [(None, i // 2, i % 2, t) for i, t in enumerate(said[::-1])]
    lines = spark.createDataFrame(lines, "conv_id long, turn long, line long, text string")
    symbols = {r["text"]: r["s"] for r in lines.select("text", chat.symbol(lines["text"]).alias("s")).collect()}
    for block, long, super_ in ((2, 4096, 1), (2, 1, 1), (64, 2, 2)):
        monkeypatch.setattr(chat, "BLOCK", block)
        monkeypatch.setattr(chat, "LONG", long)
        monkeypatch.setattr(chat, "SUPER", super_)
        rows = chat.label_lines(lines, hmm).collect()
        for conv, texts in ((1, said), (2, said), (None, said[::-1])):
            got = [(r["role"], r["begins"]) for r in sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: (r["turn"], r["line"]))]
            assert got == best_path(hmm, [symbols[t] for t in texts])


def test_a_first_line_begins_a_turn_as_the_start_says(spark):
    hmm = chat.fit_hmm(chat.as_transcript(turns(spark)))
    hmm.start = np.log(np.array([1e-12, 1e-15, 1.0, 1e-15, 1e-12, 1e-15]))
    long_line = "It is a long answer that goes on for quite a while and says things about the weather."
    lines = spark.createDataFrame([(1, 0, 0, long_line), (1, 1, 0, "And a second line of it.")], "conv_id long, turn long, line long, text string")
    first = chat.label_lines(lines, hmm).filter("turn = 0").first()
    assert first["begins"] and first["role"] == "user"


def test_markers_go_only_where_a_turn_of_their_role_begins(spark):
    from pyspark.sql import functions as F

    rows = [("Answer: 42 is kept", 2, False), ("Answer: 42", 2, True), ("Q: is it?", 1, True), ("Q: is it?", 2, True), ("plain", 1, True)]
    df = spark.createDataFrame(rows, "text string, role int, begins boolean")
    got = [r["c"] for r in df.select(chat.content(F.col("text"), F.col("role"), F.col("begins")).alias("c")).collect()]
    assert got == ["Answer: 42 is kept", "42", "is it?", "Q: is it?", "plain"]


def test_nulls_repeats_and_empty_tables(spark):
    hmm = chat.fit_hmm(chat.as_transcript(turns(spark)))
    odd = spark.createDataFrame([(None, 0, 0, None), (None, 0, 0, None), (2, 0, 0, ""), (2, 0, 1, "x" * 100000)], "conv_id long, turn long, line long, text string").selectExpr("*", "1 as block", "2 as opens", "3 as role")
    assert chat.label_lines(odd, hmm).count() == 4 and chat.label_lines(odd.limit(0), hmm).count() == 0
    assert chat.render_turns(chat.label_lines(odd, hmm)).count() >= 2
