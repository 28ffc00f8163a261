"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: As many buckets as Spark allows by default.
MAX_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (as in tests) gets a temporary one; on a cluster that would be a folder of each machine, so it raises.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_own_checkpoint_dir", None) or tempfile.mkdtemp(prefix="verdigris-")
        spark._own_checkpoint_dir = found
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


class Scratch:
    """Tables written to the shared folder so that lineage is cut and a lost executor costs nothing but a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.names: dict[str, str] = {}
        self.made = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[self.made] = path
        out._scratch = path
        return out

    def bucketed(self, df: DataFrame, key: str, least: int = 1) -> DataFrame:
        """A table whose rows are dealt by `key` as a shuffle would deal them, over `least` buckets at least, so that joins on the key leave it where it is."""
        self.made += 1
        path, name = f"{self.root}/{self.made}", f"verdigris_{uuid.uuid4().hex}"
        n = min(max(least, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), MAX_BUCKETS)
        df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[self.made], self.names[path] = path, name
        out._scratch = path
        return out

    def reclaim(self) -> None:
        """Let Spark delete the shuffle files of plans that nobody holds any longer: it does once the driver has collected them, which takes
        Python's references and two collections of the JVM."""
        gc.collect()
        for _ in range(2):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        wanted = {t._scratch for t in tables}
        self._delete([p for p in self.paths.values() if p not in wanted])

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        self._delete([t._scratch for t in tables])

    def _delete(self, paths: list[str]) -> None:
        context = self.spark.sparkContext
        for p in paths:
            if p in self.names:
                self.spark.sql(f"drop table if exists {self.names.pop(p)}")
            path = context._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = {k: p for k, p in self.paths.items() if p not in paths}
