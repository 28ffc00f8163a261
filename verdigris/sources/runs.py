"""Runs as a Spark data source: results and the manifest that makes them readable, in one commit.

    spark.dataSource.register(Runs)
    rows.write.format("run").option("run_id", "r1").option("config", '{"model": "m"}').mode("append").save(folder)
    spark.read.format("run").schema(...).option("run_id", "r1").load(folder)

Each task writes files of its own under `<folder>/<run_id>/`; when all have ended, the driver writes `manifest.json` beside them, which names them with their rows, samples that are
not ok and cost. A reader takes the files of the manifest and no others, so a run whose job failed, or files that a repeated task left behind, are never seen. A job that fails
removes what it wrote; a task that still runs then can leave a file, which nobody reads and the run's next commit removes. A run has one writer at a time. Files are Parquet or JSON lines (option `form`); folders are anything that Arrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a file at most, so that a large task writes and a large run reads in pieces.
ROWS = 1_000_000


def opened(folder: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def manifest(folder: str, run_id: str) -> dict | None:
    """The manifest of a finished run; None if there is none."""
    from pyarrow import fs

    system, path = opened(folder)
    at = f"{path}/{run_id}/manifest.json"
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]
    not_ok: int
    cost: float


class Runs(DataSource):
    @classmethod
    def name(cls):
        return "run"

    def _options(self) -> tuple[str, str]:
        if not self.options.get("path") or not self.options.get("run_id"):
            raise ValueError("a run needs a folder and the option run_id")
        return self.options["path"].rstrip("/"), self.options["run_id"]

    def schema(self):
        found = manifest(*self._options())
        if found is None:
            raise FileNotFoundError(f"no finished run {self.options['run_id']}")
        return StructType.fromJson(found["schema"])

    def reader(self, schema):
        return RunReader(*self._options(), schema)

    def writer(self, schema, overwrite):
        form = self.options.get("form", "parquet")
        if form not in ("parquet", "json"):
            raise ValueError(f"unknown form {form!r}")
        return RunWriter(*self._options(), schema, form, overwrite, json.loads(self.options.get("config", "{}")))


class RunWriter(DataSourceArrowWriter):
    """`overwrite` replaces a finished run of the same name when the new one commits; without it a finished run is an error, told before any task starts."""

    def __init__(self, folder: str, run_id: str, schema: StructType, form: str, overwrite: bool, config: dict):
        self.folder, self.run_id, self.schema, self.form, self.config = folder, run_id, schema, form, config
        self.attempt = uuid.uuid4().hex
        if not overwrite and manifest(folder, run_id):
            raise FileExistsError(f"run {run_id} is finished")

    def write(self, iterator):
        """One task: files of at most ROWS rows (and of at least a batch), each with a name of its own."""
        import pyarrow as pa

        files, held, rows, not_ok, cost = [], [], 0, 0, 0.0
        for batch in iterator:
            held.append(batch)
            rows += batch.num_rows
            names = batch.schema.names
            if "status" in names:
                not_ok += sum(s != "ok" for s in batch.column("status").to_pylist())
            if "cost_usd" in names:
                cost += sum(c for c in batch.column("cost_usd").to_pylist() if c is not None)
            if rows >= ROWS:
                files.append(self._file(pa.Table.from_batches(held)))
                held, rows = [], 0
        if rows:
            files.append(self._file(pa.Table.from_batches(held)))
        return Written(files, not_ok, cost)

    def _file(self, table) -> tuple[str, int]:
        import pyarrow.parquet as pq

        system, path = opened(self.folder)
        system.create_dir(f"{path}/{self.run_id}", recursive=True)
        name = f"{self.attempt}-{uuid.uuid4().hex}.{self.form}"
        with system.open_output_stream(f"{path}/{self.run_id}/{name}") as f:
            if self.form == "parquet":
                pq.write_table(table, f)
            else:
                for batch in table.to_batches(10_000):
                    f.write("".join(json.dumps(row, default=str) + "\n" for row in batch.to_pylist()).encode())
        return name, table.num_rows

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        files = sorted(f for m in done for f in m.files)
        found = {
            "run_id": self.run_id,
            "form": self.form,
            "config": self.config,
            "schema": self.schema.jsonValue(),
            "samples": sum(n for _, n in files),
            "not_ok": sum(m.not_ok for m in done),
            "cost_usd": sum(m.cost for m in done),
            "files": files,
        }
        system, path = opened(self.folder)
        root = f"{path}/{self.run_id}"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{self.attempt}.tmp") as f:
            f.write((json.dumps(found, indent=1) + "\n").encode())
        system.move(f"{root}/{self.attempt}.tmp", f"{root}/manifest.json")
        kept = {name for name, _ in files} | {"manifest.json"}
        self._clear(lambda name: name not in kept)

    def abort(self, messages):
        """What this job has written goes, also files of tasks that ended without a message; a finished run of the same name stays."""
        self._clear(lambda name: name.startswith(self.attempt))

    def _clear(self, unwanted) -> None:
        from pyarrow import fs

        system, path = opened(self.folder)
        for info in system.get_file_info(fs.FileSelector(f"{path}/{self.run_id}", allow_not_found=True)):
            if unwanted(info.base_name):
                system.delete_file(info.path)


class RunFile(InputPartition):
    def __init__(self, name: str):
        self.name = name


class RunReader(DataSourceReader):
    """One task a file; columns that a file lacks are null."""

    def __init__(self, folder: str, run_id: str, schema: StructType):
        self.folder, self.run_id, self.columns = folder, run_id, schema
        found = manifest(folder, run_id)
        if found is None:
            raise FileNotFoundError(f"no finished run {run_id}")
        self.form, self.files = found["form"], [name for name, _ in found["files"]]

    def partitions(self):
        return [RunFile(name) for name in self.files]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.json as pj
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # a run without rows has no files
            return
        wanted = to_arrow_schema(self.columns)
        system, path = opened(self.folder)
        with system.open_input_file(f"{path}/{self.run_id}/{partition.name}") as f:
            if self.form == "parquet":
                source = pq.ParquetFile(f)
                there = set(source.schema_arrow.names)
                batches = source.iter_batches(columns=[n for n in wanted.names if n in there])
            else:
                batches = pj.open_json(f, parse_options=pj.ParseOptions(explicit_schema=wanted))
            for batch in batches:
                columns = [batch.column(x.name).cast(x.type) if x.name in batch.schema.names else pa.nulls(batch.num_rows, x.type) for x in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)
