"""A sink and source for records in batches, as a Python data source named ``tessella_records``.

    df.write.format("tessella_records").option("path", folder).mode("append").save()
    spark.read.format("tessella_records").option("path", folder).load()

Rows need ``batch`` and ``idempotency_key``; all their other columns are the
record. A task writes Parquet files of its rows under a name of its own; what
it wrote counts only once the job commits, which renames one manifest into
place. A job that fails, in a task or in the driver, deletes its files and
leaves no manifest, and a task that runs twice, or is slow to end when its
job has failed, leaves a file that no manifest names. A batch that a later job writes again, under the same
idempotency key, replaces nothing: the first manifest that has the key counts,
so writing twice reads back once. ``mode("overwrite")`` forgets earlier manifests when it commits.

The folder is a URI that all machines reach. A task holds ROWS rows at once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "tessella_records"
ROWS = 10_000
KEY = "idempotency_key"


def _at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its file, or none, and which batches are in it."""

    file: str | None
    keys: list[str]


class RecordWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        self.job = uuid.uuid4().hex
        if not {"batch", KEY} <= set(schema.fieldNames()):
            raise ValueError(f"records need the columns batch and {KEY}")

    def write(self, iterator: Iterator) -> Written:
        fs, folder = _at(f"{self.path}/data/{self.job}")
        fs.create_dir(folder)
        name, keys, out = f"{folder}/{uuid.uuid4().hex}.parquet", set(), None
        made = to_arrow_schema(self.schema)
        try:
            while rows := list(islice(iterator, ROWS)):
                table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], made)
                keys.update(table.column(KEY).to_pylist())
                out = out or pq.ParquetWriter(name, made, filesystem=fs)
                out.write_table(table)
        finally:
            if out:
                out.close()
        return Written(name if out else None, sorted(keys))

    def commit(self, messages: list[Written | None]) -> None:
        """Names the job's files, and the batches that no earlier manifest has, in one step."""
        fs, folder = _at(f"{self.path}/manifests")
        fs.create_dir(folder)
        known = set() if self.overwrite else {k for m in manifests(self.path) for k in m["keys"]}
        keys = sorted({k for m in messages if m for k in m.keys} - known)
        made = {"at": time.time_ns(), "job": self.job, "forget": self.overwrite, "keys": keys, "files": [m.file for m in messages if m and m.file]}
        draft = f"{folder}/.{self.job}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(made).encode())
        fs.move(draft, f"{folder}/{made['at']:020d}-{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _at(f"{self.path}/data/{self.job}")
        if fs.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(folder)


def manifests(path: str) -> list[dict]:
    """Committed manifests in their order, from the last overwriting one on."""
    fs, folder = _at(f"{path.rstrip('/')}/manifests")
    found = []
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with fs.open_input_file(info.path) as f:
                made = json.loads(f.read())
            found = [made] if made["forget"] else [*found, made]
    return found


@dataclass
class Part(InputPartition):
    file: str
    job: str


class RecordReader(DataSourceReader):
    """One partition per committed file; of each only the batches that its job was the first to commit."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.made = manifests(path)

    def partitions(self) -> list[Part]:
        return [Part(f, m["job"]) for m in self.made for f in m["files"]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition or not getattr(partition, "file", None):
            return
        fs, _ = _at(self.path)
        taken: set[str] = set()
        for m in self.made:
            own = set(m["keys"]) - taken
            if m["job"] == partition.job:
                break
            taken |= set(m["keys"])
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(ROWS):
                yield batch.filter(pa.compute.is_in(batch.column(KEY), pa.array(sorted(own), pa.string())))


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, _ = _at(self.options["path"])
        for m in manifests(self.options["path"]):
            for file in m["files"]:
                with fs.open_input_file(file) as f:
                    return from_arrow_schema(pq.read_schema(f))
        raise ValueError(f"no records are committed under {self.options['path']}")

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, overwrite)

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Records)
