"""Transcript tables, paged services as a data source, and JSON documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verdigris.sources import schemas


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGE).json(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OUTCOME).json(path)


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file of a folder or pattern that was written last; of equal times the greatest name."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("x")).first()
    return row["x"]["path"] if row["x"] else None


def read_json(spark: SparkSession, path: str) -> dict | None:
    """One JSON document, such as a manifest or a certificate; None if there is none."""
    from verdigris.sources.files import path_exists

    if not path_exists(spark, path):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text, through the file system of the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, indent=2, default=str) + "\n")


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """Rows of a paged service: `fetch(page, size)` gives a list of tuples, a short page ends it. Pages up to `pages` are read in parallel tasks.

    Make one for a service with `paged_source`, register it and read it by its name.
    """

    fetch: Callable[[int, int], list[tuple]]
    rows_schema: str
    short_name: str

    @classmethod
    def name(cls):
        return cls.short_name

    def schema(self):
        return self.rows_schema

    def reader(self, schema):
        return PagedReader(type(self).fetch, int(self.options.get("pages", "1")), int(self.options.get("size", "100")))


class PagedReader(DataSourceReader):
    def __init__(self, fetch, pages: int, size: int):
        self.fetch, self.pages, self.size = fetch, pages, size

    def partitions(self):
        return [Page(i) for i in range(1, self.pages + 1)]

    def read(self, partition):
        number = partition.number
        while True:
            rows = self.fetch(number, self.size)
            yield from rows
            # the last task goes on until a short page
            if len(rows) < self.size or number < self.pages:
                return
            number += 1


def paged_source(spark: SparkSession, name: str, schema: str, fetch: Callable[[int, int], list[tuple]]) -> None:
    spark.dataSource.register(type(f"Paged_{name}", (PagedSource,), {"fetch": staticmethod(fetch), "rows_schema": schema, "short_name": name}))
