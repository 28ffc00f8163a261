import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import index as ix
from verdigris.operators import retrieval

RANKED = ["query_id", "rank", "doc_id"]


@pytest.fixture
def small(monkeypatch):
    """Blocks of a few postings, so that some hundred documents have many."""
    monkeypatch.setattr(ix, "SEGMENT", 8)


def corpus(spark, n=600, seed=2):
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(common, k=r.randrange(5, 40)) + r.choices(rare, k=r.randrange(0, 4)))) for i in range(n)]
    rows += [(10_000, None), (10_001, ""), (10_002, rows[3][1]), (10_003, rows[3][1])]
    asks = [(q, " ".join(r.choices(common, k=4) + r.choices(rare, k=r.randrange(0, 5)))) for q in range(25)] + [(100, rows[3][1]), (101, "zzz"), (102, ""), (103, "c1 c1 c2"), (104, rare[0])]
    return spark.createDataFrame(rows, "doc_id long, body string"), spark.createDataFrame(asks, "query_id long, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_top_k_equals_scoring_everything_and_leaves_blocks_unread(spark, small, tmp_path):
    docs, asks = corpus(spark)
    saved = ix.Index.save(docs, str(tmp_path / "i"))
    again = ix.Index.open(spark, str(tmp_path / "i"))
    for k in (1, 5):
        assert rows(again.search(asks, k)) == rows(retrieval.Index(docs).search(asks, k))
    asked = saved.asked(asks)
    scratch = ix.Scratch(spark, "t")
    bars = saved.bars(asked, 3, scratch)
    all_blocks = saved.headers(asked).count()
    planned = saved.plan(asked, bars)
    assert planned.filter("not naming").count() > 0 and planned.filter("not scanned").count() > 0
    wanted = saved.wanted(planned)
    read = wanted.filter("read").count()
    assert 0 < read < all_blocks / 2, (read, all_blocks)
    assert wanted.filter("not read").count() > 0  # by their peaks, beside the terms that name no candidates


def test_blocks_are_bounded_and_headers_true(spark, small, tmp_path):
    docs, _ = corpus(spark)
    saved = ix.Index.save(docs, str(tmp_path / "i"))
    b = saved.blocks.withColumn("best", F.array_max(F.zip_with("tfs", "lengths", lambda t, n: ix.weight(t, n, F.lit(saved.average)))))
    assert b.filter("n <> size(docs) or abs(best - peak) > 1e-12 or size(docs) <> size(array_distinct(docs))").count() == 0
    assert b.agg(F.max("n")).head()[0] <= 4 * ix.SEGMENT and saved.n_docs == 604
    frequency = {r["term"]: r["df"] for r in saved.terms.collect()}
    assert frequency == {r["term"]: r["n"] for r in b.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def test_an_index_is_kept_until_its_files_change(spark, tmp_path, monkeypatch):
    docs, asks = corpus(spark, 60)
    docs.write.parquet(str(tmp_path / "d"))
    first = ix.kept(spark.read.parquet(str(tmp_path / "d")))
    monkeypatch.setattr(ix.Index, "save", classmethod(lambda *a: pytest.fail("the index was there")))
    second = ix.kept(spark.read.parquet(str(tmp_path / "d")))
    assert second.path == first.path
    plan = second.asked(asks)._jdf.queryExecution().toString() + second.search(asks)._jdf.queryExecution().toString()
    assert "body#" not in plan and "documents" not in plan
    monkeypatch.undo()
    spark.createDataFrame([(77_777, "c1 zzz")], "doc_id long, body string").write.mode("append").parquet(str(tmp_path / "d"))
    third = ix.kept(spark.read.parquet(str(tmp_path / "d")))
    assert third.path != first.path and third.n_docs == first.n_docs + 1
    assert [r["doc_id"] for r in third.search(asks.filter("query_id = 101")).collect()] == [77_777]


def test_an_empty_corpus_gives_no_hits(spark, tmp_path):
    docs, asks = corpus(spark, 5)
    assert ix.Index.save(docs.limit(0), str(tmp_path / "i")).search(asks).count() == 0
    text = ix.Index.save(docs.select(F.concat(F.lit("D"), "doc_id").alias("id"), "body"), str(tmp_path / "s"), "id").search(asks.filter("query_id = 100"), 2)
    assert [r["doc_id"] for r in text.orderBy("rank").collect()] == ["D10002", "D10003"]


def test_more_text_and_more_pairs_take_more_tasks(spark, small, tmp_path, monkeypatch):
    docs, asks = corpus(spark)
    counted, dealt = [], []
    frequencies, spread = ix.frequencies, ix.spread
    monkeypatch.setattr(ix, "frequencies", lambda *a: counted.append(frequencies(*a)) or counted[-1])
    monkeypatch.setattr(ix, "spread", lambda *a: dealt.append(spread(*a).rdd.getNumPartitions()) or spread(*a))
    monkeypatch.setattr(ix, "TASK_WORDS", 500)
    monkeypatch.setattr(ix, "TASK_ROWS", 1000)
    words = docs.agg(F.sum(F.regexp_count("body", F.lit("[a-z0-9]+")))).head()[0]
    got = rows(ix.Index.save(docs, str(tmp_path / "i")).search(asks, 3))
    assert counted[0].rdd.getNumPartitions() >= words / 500 > 4 and max(dealt) > 4
    assert got == rows(retrieval.Index(docs).search(asks, 3))
