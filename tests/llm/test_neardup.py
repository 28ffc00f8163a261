import random

import pytest

from verdigris.llm import neardup


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [[r.choice(words) for _ in range(r.randrange(20, 120))] for _ in range(12)]
    for i in range(220):
        w = list(r.choice(base)) if i % 3 else [r.choice(words) for _ in range(r.randrange(1, 60))]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows + [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "one"), (306, "w1 w2 w3 " * 3000), (307, "w1 w2 w3 " * 3000)]


@pytest.mark.parametrize(("small", "pivots"), [(8, 3), (2, 1)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, small, pivots):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rows = corpus(small)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.find_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert got[303] == (1, 303) and got[304] == (1, 303) and got[300] == (0, 300) and got[301] == (0, 301)


def test_a_chain_is_one_component(spark):
    from verdigris.llm.common import Scratch

    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (100, 102)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100, 102: 100}


def test_null_keys_repeats_and_empty_tables(spark):
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(5, text, "x"), (5, text, "x"), (7, text, None), (None, text, "n"), (None, None, None)], "doc_id long, text string, component_id string")
    out = {(r["doc_id"], r["n_shingles"]): r for r in neardup.find_groups(docs).collect()}
    assert out[7, 10]["component_id"] == 5 and not out[7, 10]["kept"] and out[5, 10]["kept"]
    assert out[None, 10]["component_id"] is None and out[None, 10]["kept"] and out[None, 0]["kept"]
    left = neardup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["5", "None", "None"]
    assert neardup.find_groups(docs.limit(0)).count() == 0 and neardup.drop_copies(docs.limit(0)).count() == 0


def test_structured_words_do_not_collide_and_texts_under_one_key_are_apart(spark):
    t, u = "a", "b"
    for _ in range(10):
        t, u = t + u, u + t
    one, two = "k l m n o p q r s t u v", "A B C D E F G H I J K L"
    rows = [(1, t), (2, u), (5, one), (5, two), (9, two), (9, one + " x y z"), (9, two), (9, one + " x y z")]
    docs = spark.createDataFrame([(*r, "d", "k") for r in rows], "doc_id long, text string, _digest string, _key string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.find_groups(docs).collect()} == {(1, 1), (2, 2), (5, 5), (9, 5), (9, 9)}
    left = neardup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted({(1, t), (2, u), (5, one), (5, two), (9, one + " x y z")})


def test_the_query_equals_its_sql(spark):
    import duckdb

    from verdigris.llm import queries

    data = "/root/testdata/sf0.001"
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    got = queries.op2_minhash(spark, data)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == sorted(sql.sql(f"select doc_id, n_shingles, component_id, kept from ({queries.ORACLES['op2_minhash']})").fetchall())
