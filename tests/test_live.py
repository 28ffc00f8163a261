import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdigris.streaming import live

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
KIND = "run_id string, ts timestamp, cost double"


def calls(first, last):
    """Calls of three runs, one with a gap of two days, some without a cost."""
    for i in range(first, last):
        at = START + dt.timedelta(minutes=17 * i)
        yield "a", at, 1.5
        if i % 3 == 0:
            yield "b", at, None if i % 2 else 4.0
        if i < 20 or i > 200:
            yield "c", at, 2.0


def settled(rows, cap, idle, until):
    """The same by hand, over all calls at once."""
    sums = {}
    for run, at, cost in rows:
        hour = at.replace(minute=0, second=0, microsecond=0)
        if hour + dt.timedelta(hours=1) <= until:
            c, n = sums.get((run, hour), (0.0, 0))
            sums[run, hour] = c + (cost or 0.0), n + 1
    out, state = [], {}
    for run, hour in sorted(sums):
        spent, last = state.get(run, (0.0, None))
        if last is not None and hour - last > dt.timedelta(hours=idle):
            spent = 0.0
        cost, n = sums[run, hour]
        out.append((run, hour.replace(tzinfo=None), n, spent, spent + cost, spent >= cap))
        state[run] = spent + cost, hour
    return out


def test_spending_goes_on_from_its_checkpoint(spark, tmp_path):
    """Three parts, each after a stop; the second fails between its write and its commit, and runs again."""
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    everything = []
    for number, (first, last) in enumerate([(0, 90), (90, 230), (230, 260)]):
        rows = list(calls(first, last))
        everything += rows
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)

        def broken(batch):
            batch.withColumn("batch", F.lit(-1)).count()
            raise RuntimeError("lost")

        stream = lambda: live.hourly_spending(spark.readStream.schema(KIND).parquet(source), 20.0)
        with live.rocksdb(spark):
            if number == 1:
                with pytest.raises(Exception, match="lost"):
                    live.append_once(stream(), out, progress, broken)
            live.append_once(stream(), out, progress)
    until = max(at for _, at, _ in everything) - dt.timedelta(hours=2)
    got = sorted((r["run_id"], r["hour"], r["calls"], r["spent_before"], r["spent"], r["refused"]) for r in live.appended(spark, out, live.SETTLED).collect())
    assert got == settled(everything, 20.0, 24, until)
    assert any(r[0] == "c" and r[3] == 0.0 and r[1] > dt.datetime(2024, 1, 2) for r in got)


def test_a_batch_that_is_written_twice_is_there_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    spark.range(10).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)

    class Lost(Exception):
        pass

    written = []

    def fails_after_write(batch, number):
        made = batch.withColumn("batch", F.lit(number))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        written.append(number)
        raise Lost("after the write")

    with pytest.raises(Exception, match="after the write"):
        stream().writeStream.foreachBatch(fails_after_write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    assert written == [0] and spark.read.parquet(out).count() == 10
    live.append_once(stream(), out, progress)
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    live.append_once(stream(), out, progress)
    got = live.appended(spark, out, "id long, batch long").collect()
    assert sorted(r["id"] for r in got) == list(range(15)) and {r["batch"] for r in got} == {0, 1}


def test_nothing_arrives(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "in"))
    with live.rocksdb(spark):
        live.append_once(live.hourly_spending(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), 1.0), str(tmp_path / "out"), str(tmp_path / "p"))
    assert live.appended(spark, str(tmp_path / "out"), live.SETTLED).count() == 0
