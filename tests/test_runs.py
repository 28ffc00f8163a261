import os

import pytest
from pyspark.sql import functions as F

from verdigris.sources import runs


@pytest.fixture()
def rows(spark):
    spark.dataSource.register(runs.Runs)
    return spark.range(100).repartition(4).select(
        F.concat(F.lit("t"), "id").alias("task_id"), F.when(F.col("id") % 10 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("id") % 7 != 0, F.lit(0.5)).alias("cost_usd"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("citations"), F.struct((F.col("id") % 2 == 0).alias("correct")).alias("judge"),
    )


def written(rows, folder, run_id, mode="append", **options):
    rows.write.format("run").options(run_id=run_id, **options).mode(mode).save(folder)


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_round_trip_with_manifest(spark, rows, tmp_path, form):
    folder = str(tmp_path)
    written(rows, folder, "r1", form=form, config='{"model": "m"}')
    back = spark.read.format("run").option("run_id", "r1").load(folder)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    found = runs.manifest(folder, "r1")
    assert (found["samples"], found["not_ok"], found["cost_usd"], found["config"]) == (100, 10, 42.5, {"model": "m"})
    more = spark.read.format("run").schema("task_id string, extra long").option("run_id", "r1").load(folder)
    assert more.filter("extra is null").count() == 100


def test_a_failed_task_leaves_no_run(spark, rows, tmp_path):
    folder = str(tmp_path)
    bad = rows.withColumn("task_id", F.when(F.col("task_id") == "t77", F.raise_error("lost")).otherwise(F.col("task_id")))
    with pytest.raises(Exception, match="lost"):
        written(bad, folder, "r1")
    assert runs.manifest(folder, "r1") is None
    with pytest.raises(Exception, match="no finished run"):
        spark.read.format("run").option("run_id", "r1").load(folder).collect()
    # again, and then a failed job over a finished run: the finished one stays
    written(rows, folder, "r1")
    with pytest.raises(Exception, match="lost"):
        written(bad, folder, "r1", "overwrite")
    assert spark.read.format("run").option("run_id", "r1").load(folder).count() == 100
    with pytest.raises(Exception, match="is finished"):
        written(rows, folder, "r1")
    # files that nobody lists, as of a task that ended after its job was given up
    (tmp_path / "r1" / "late.parquet").write_bytes(b"x")
    written(rows.limit(7), folder, "r1", "overwrite")
    assert spark.read.format("run").option("run_id", "r1").load(folder).count() == 7
    assert len(os.listdir(tmp_path / "r1")) == len(runs.manifest(folder, "r1")["files"]) + 1


def test_files_without_a_manifest_entry_are_not_read(spark, rows, tmp_path):
    folder = str(tmp_path)
    written(rows, folder, "r1")
    name = runs.manifest(folder, "r1")["files"][0][0]
    (tmp_path / "r1" / "left-behind.parquet").write_bytes((tmp_path / "r1" / name).read_bytes())
    assert spark.read.format("run").option("run_id", "r1").load(folder).count() == 100


def test_empty_run(spark, rows, tmp_path):
    written(rows.limit(0), str(tmp_path), "none")
    assert spark.read.format("run").option("run_id", "none").load(str(tmp_path)).count() == 0
    assert runs.manifest(str(tmp_path), "none")["samples"] == 0


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    from verdigris.sources import files, schemas

    path = str(tmp_path / "results")
    rows = spark.createDataFrame([(r, "v", f"t{i}", 0, "ok", None, [], False, None, True, 1.0, 1, 1, 0.5, "") for r in ("a", "b") for i in range(4)], schemas.RESULT)
    files.write_results(rows, path)
    files.write_results(rows.filter("run_id = 'a'"), path)
    assert files.read_results(spark, path).count() == 8 and files.read_results(spark, path, "a").count() == 4


def test_trace_ids_reach_the_results(spark):
    from verdigris.operators import judging
    from verdigris.sources import schemas

    none = spark.createDataFrame([], "sample_id string, epoch int, correct boolean, faithful boolean, reason string, error boolean, cost_usd double")
    from test_corpus import task
    from verdigris.sources.files import FIELDS

    tasks = spark.createDataFrame([tuple(task(i)[f] for f in FIELDS) for i in range(2)], schemas.TASK)
    out = spark.createDataFrame([("dev-0000", 1, None, None, "x", {}, 1.0, "t0"), ("dev-0001", 1, None, None, "x", {}, 1.0, None)], schemas.OUTCOME + ", trace_id string")
    got = judging.score_samples(out, spark.createDataFrame([], schemas.MESSAGE), tasks, spark.createDataFrame([], "id string"), none, {}, "r", "v")
    assert sorted((r["task_id"], r["trace_id"]) for r in got.collect()) == [("dev-0000", "t0"), ("dev-0001", "")]
