import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs.count()))
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("near_dedup", "pii"):
            assert docs.select("doc_id").distinct().count() == seen[-1][1]
    assert [n for n, _ in seen] == ["quality", "near_dedup", "pii", "mixing", "bpe"]
    assert 200 > seen[0][1] > seen[1][1] == seen[2][1] > 100 and seen[3][1] == seen[4][1]
    assert docs.filter("n_tokens <> size(ids) or n_tokens = 0").count() == 0


def test_run_gives_the_rows_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids", "position"] and rows.count() > 100


def test_the_order_of_training_survives_the_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, "")
    want = [r["doc_id"] for r in mixed.select("doc_id").collect()]
    mixed.write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    assert [r["doc_id"] for r in out.orderBy("position").select("doc_id").collect()] == want
    assert out.select("position").distinct().count() == len(want) > 1000
    assert corpus_pipeline.encode(spark, docs.limit(3), "").count() == 3


def test_stages_take_nulls_repeats_clashes_and_nothing(spark):
    prose = "the rain fell on the old town and nobody minded it much today"
    rows = [(1, prose, "en", "s", 9), (1, prose, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, prose + " at all", "en", None, 1), (4, "mail a.b@example.com now", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as _own", "2 as _digest", "3 as _spans", "4 as position")
    n = {"quality": 3, "near_dedup": 5, "pii": 6, "mixing": None, "bpe": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").collect()
        assert n[name] is None or len(out) == n[name], (name, out)
        assert name == "bpe" or all((r["_own"], r["_digest"], r["_spans"], r["position"]) == (1, 2, 3, 4) for r in out)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert {r["text"] for r in corpus_pipeline.personal_data(spark, docs, "").collect() if r["doc_id"] == 4} == {"mail [EMAIL] now"}
