import hashlib
import random
import zlib

import duckdb
import pytest

from verdigris.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, shared):
    """Nodes by looking at every prefix of every conversation."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    digest = lambda x: hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()[:16]
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:2], digest(x)))] for c, v in own.items()}
    if shared:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % 5, [])[: cut[c]] + own[c][cut[c] :] for c in own}
    members = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []

    def walk(k):
        below = [walk(x) for x in children.get(k, [])]
        leaves = sum(x[0] for x in below) if below else 1
        saved = sum(x[1] for x in below) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(own[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def conversations(seed, n=150, turns=9, words=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "user", "assistant", None]) if t % 4 else "user", r.choice(["é", "a b", "ü" * 3, "", None][:words])) for c in range(n) for t in range(r.randrange(1, turns))]


@pytest.mark.parametrize("seed,words", [(1, 2), (2, 5)])
def test_tries_equal_brute_force(spark, seed, words):
    rows = conversations(seed, words=words)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes(trie.shared_trie(df)) == brute(rows, True)
    assert nodes(trie.prefix_trie(df)) == brute(rows, False)


def test_long_conversations_and_groups_of_copies_cross_blocks_pieces_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "PIECE", 4)
    long = [(7, t, "user", f"t{t}") for t in range(300)] + [(9, t, "user", f"t{t}" if t < 201 else "other") for t in range(230)]
    rows = long + [(c, t, "user", "same") for c in range(20, 60) for t in range(3)] + [(c, t, "user", "same") for c in range(60, 63) for t in range(5)] + conversations(4, 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert nodes(trie.prefix_trie(df)) == brute(rows, False)
    assert nodes(trie.shared_trie(df)) == brute(rows, True)


def test_chains_that_hang_on_chains(spark):
    # conversation c agrees with c - 1 up to turn c, so the tree is a staircase
    rows = [(c, t, "user", f"{min(c, t + 1)}-{t}") for c in range(30) for t in range(c + 2)]
    assert nodes(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_nulls_ties_copies_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, 0, None, ""), (2, 0, None, ""), (-7, 5, "user", "long " * 50_000), (-7, None, "user", "a"), (6, 1, "r", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "'x' as pos", "2 as depth", "3 as first")
    assert nodes(trie.prefix_trie(df)) == brute(rows, False)
    empty = trie.shared_trie(df.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0
    assert trie.prefix_trie(df.filter("conv_id is null")).count() == 0


def test_a_conversation_may_lose_all_its_turns(spark):
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    got = nodes(trie.shared_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, True) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_the_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.01"
    sql = duckdb.connect()
    sql.execute(f"create view conversations as select * from read_parquet('{data}/conversations.parquet')")
    want = sql.sql(queries.ORACLES["op12_trie"])
    assert sorted(want.columns) == sorted(COLUMNS)
    got = nodes(queries.QUERIES["op12_trie"](spark, data))
    assert got == sorted(want.select(*COLUMNS).fetchall(), key=str) and len(got) > 200
